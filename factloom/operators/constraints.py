"""Declarative constraints compiled to joins.

``patterns``: ``(a:Label|Label)-[e:rel|rel]->(b:Label)`` or ``(a:Label)``. ``filters`` and ``conditions`` are Spark
SQL expressions over the variables (structs of the node or edge); a match that passes all filters and fails the
conjunction of the conditions is a conflict of its edges and nodes. Two edge variables never bind one edge.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NODE = r"\(\s*(\w+)\s*(?::\s*([\w|]+))?\s*\)"
_EDGE = re.compile(rf"{_NODE}\s*-\[\s*(\w+)\s*:\s*([\w|]+)\s*\]->\s*{_NODE}$")
_ALONE = re.compile(rf"{_NODE}$")


@dataclass(frozen=True)
class Constraint:
    patterns: tuple[str, ...]
    filters: tuple[str, ...] = ()
    conditions: tuple[str, ...] = ()


@dataclass
class _Bound:
    labels: dict[str, set[str]] = field(default_factory=dict)
    edges: list[tuple[str, tuple[str, ...], str, str]] = field(default_factory=list)


def load(text: str) -> list[Constraint]:
    """The constraints of a TOML workload."""
    return [Constraint(tuple(c["patterns"]), tuple(c.get("filters", ())), tuple(c.get("conditions", ()))) for c in tomllib.loads(text).get("constraints", [])]


def _read(patterns: tuple[str, ...]) -> _Bound:
    bound = _Bound()

    def node(name: str, labels: str | None) -> None:
        own = bound.labels.setdefault(name, set())
        if labels:
            own.update(labels.split("|"))

    for p in patterns:
        p = p.strip()
        if m := _EDGE.match(p):
            node(m[1], m[2])
            node(m[5], m[6])
            bound.edges.append((m[3], tuple(m[4].split("|")), m[1], m[5]))
        elif m := _ALONE.match(p):
            node(m[1], m[2])
        else:
            raise ValueError(f"not a pattern: {p}")
    return bound


def matches(c: Constraint, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a conflict: each variable as a struct column."""
    bound, rows, have = _read(c.patterns), None, set()
    key = F.concat_ws("|", "s", "p", "o")
    for edge, relations, a, b in bound.edges:
        own = facts.where(F.col("p").isin(*relations)).select(F.struct("s", "p", "o", key.alias("key")).alias(edge), F.col("s").alias(f"_{a}"), F.col("o").alias(f"_{b}") if a != b else F.col("o").alias(f"_{b}2"))
        if a == b:
            own = own.where(F.col(f"_{b}") == F.col(f"_{b}2")).drop(f"_{b}2")
        shared = sorted({f"_{a}", f"_{b}"} & have)
        if rows is not None and not shared:
            raise ValueError("patterns must share a variable with those before them")
        rows = own if rows is None else rows.join(own, shared)
        have |= {f"_{a}", f"_{b}"}
    for name, labels in bound.labels.items():
        own = nodes.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in sorted(labels)]))) if labels else nodes
        own = own.select(F.col("id").alias(f"_{name}"), F.struct(*[F.col(x) for x in nodes.columns]).alias(name))
        rows = own if rows is None else rows.join(own, f"_{name}")
    names = [e for e, *_ in bound.edges]
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            rows = rows.where(F.col(f"{x}.key") != F.col(f"{y}.key"))
    for f in c.filters:
        rows = rows.where(F.coalesce(F.expr(f), F.lit(False)))
    if c.conditions:
        holds = F.lit(True)
        for f in c.conditions:
            holds = holds & F.coalesce(F.expr(f), F.lit(False))
        rows = rows.where(~holds)
    return rows.select(*names, *bound.labels)


def conflicts(c: Constraint, facts: DataFrame, nodes: DataFrame, edge_weight: int = 2, node_weight: str = "1000000") -> DataFrame:
    """conflict_id, element_id, element_type, weight: one hyperedge a match, holding each edge and each node; symmetric matches are one."""
    bound = _read(c.patterns)
    parts = [F.struct(F.col(f"{e}.key").alias("element_id"), F.lit("edge").alias("element_type"), F.lit(edge_weight).cast("long").alias("weight")) for e, *_ in bound.edges]
    parts += [F.struct(F.col(f"{n}.id").alias("element_id"), F.lit("node").alias("element_type"), F.expr(node_weight).cast("long").alias("weight")) for n in bound.labels]
    members = F.array_sort(F.array_distinct(F.array(*parts)))
    rows = matches(c, facts, nodes).select(members.alias("_m")).select(F.sha2(F.to_json("_m"), 256).alias("conflict_id"), "_m").distinct()
    return rows.select("conflict_id", F.inline("_m"))
