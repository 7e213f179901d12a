"""Seeded damages of a graph, each a function (facts, nodes) -> (facts, nodes, events).

Facts: id (null for injected ones), s, p, o. Nodes: id and properties. Events have the columns of ``EVENT``
that the damage fills. Node values are damaged first, then nodes merged and split, then edges.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom._cut import cut, large
from factloom.functions import scalars
from factloom.operators import laws, sampling

_TEXT = ("damage", "s", "p", "o", "node", "arm", "cycle_with", "truth_fact", "truth_date", "injected_date", "truth_label", "injected_label", "property", "truth_value", "injected_value", "kept", "absorbed", "twin")
EVENT = T.StructType([*[T.StructField(n, T.StringType()) for n in _TEXT], *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("visible_by_law", "moved_facts")]])
RANKS = {"ANACHRONISM": 0, "WRONG_VALUE": 0, "WRONG_LABEL": 0, "MERGE": 1, "SPLIT": 1}
KINDS = (*RANKS, "SPURIOUS_EDGE", "CYCLE", "CYCLE_BLIND", "MISSING", "RIVAL", "DUPLICATE")
MERGE_DEGREES, SPLIT_DEGREES = (1, 6), (2, 8)
TRIES, SOURCE_TRIES = 20, 30


@dataclass(frozen=True)
class Damage:
    denominator: str
    kind: str
    rate: str


def parse(texts: Iterable[str]) -> list[Damage]:
    """``denominator:KIND=rate``; an unknown kind is refused."""
    out = []
    for t in texts:
        head, rate = t.split("=", 1)
        denominator, kind = head.split(":", 1)
        if kind not in KINDS:
            raise ValueError(f"unknown damage {kind}")
        scalars.rate(rate)
        out.append(Damage(denominator, kind, rate))
    return out


def events(df: DataFrame) -> DataFrame:
    """The given columns as events, the others null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])


def _triple() -> Column:
    return F.concat_ws("|", "s", "p", "o")


def _sound(facts: DataFrame, faults: DataFrame) -> DataFrame:
    bad = faults.where(F.col("fact").isNotNull()).select(F.col("fact").alias("id")).distinct()
    return facts.where(F.col("id").isNotNull()).join(bad, "id", "left_anti")


def missing(facts, nodes, faults, relation: str, rate: str, seed: str):
    pool = _sound(facts.where(F.col("p") == relation), faults)
    gone = cut(sampling.sample(pool, _triple(), scalars.share_count(rate, pool.count()), seed), "missing")
    kept = facts.join(gone.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return kept, nodes, events(gone.select(F.lit("MISSING").alias("damage"), "s", "p", "o", F.col("id").alias("truth_fact")))


def _injected(facts, new) -> DataFrame:
    return facts.unionByName(new.select(F.lit(None).cast("string").alias("id"), "s", "p", "o"))


def spurious(facts, nodes, faults, relation: str, rate: str, seed: str, visible: str | None = None, family: str = "acts"):
    """False edges between sound nodes; of ``n`` exactly ``round(visible * n)`` break a law.

    Candidates pair each node's hash rank with ranks drawn for it: ``TRIES`` draws a node, never all pairs.
    """
    n = scalars.share_count(rate, facts.where(F.col("p") == relation).count())
    if not n:
        return facts, nodes, events(facts.limit(0).select("s"))
    pool = nodes.where((F.coalesce("date_document_status", F.lit("ok")) == "ok") & ~F.coalesce("gap", F.lit(False))).select("id")
    ranked = cut(sampling.sequential_ids(pool.withColumn("_h", sampling.hashed(seed, F.col("id"))), ["_h", "id"], "%d", "_k").select("id", F.col("_k").cast("long")), "ranks")
    size = ranked.count()
    draws = ranked.select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(TRIES))).alias("_d"))
    pick = F.pmod(F.conv(F.substring(sampling.hashed(seed, F.concat_ws("|", "s", "_d")), 1, 15), 16, 10).cast("long"), F.lit(size)) + 1
    pairs = draws.withColumn("_k", pick).join(ranked.select("_k", F.col("id").alias("o")), "_k").select("s", F.lit(relation).alias("p"), "o").where("s <> o").distinct()
    pairs = pairs.join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    judged = laws.violations(pairs, nodes, family, two_edge=False)
    two = _would_pair(pairs, facts, family)
    judged = cut(judged.join(two, ["s", "p", "o"], "left").select("s", "p", "o", F.array_compact(F.concat(F.array(F.col("_two")), "laws")).alias("laws")), "spurious")
    key, seen = _triple(), F.size("laws") > 0
    if visible is None:
        chosen = sampling.sample(judged, key, n, seed)
    else:
        n_seen = scalars.share_count(visible, n)
        chosen = sampling.sample(judged.where(seen), key, n_seen, seed).unionByName(sampling.sample(judged.where(~seen), key, n - n_seen, seed))
    chosen = cut(chosen, "spurious")
    if chosen.count() < n:
        raise RuntimeError("too few candidate edges for the quota")
    found = chosen.select(F.lit("SPURIOUS_EDGE").alias("damage"), "s", "p", "o", F.col("laws").alias("visible_by_law"))
    return _injected(facts, chosen), nodes, events(found)


def _would_pair(pairs: DataFrame, facts: DataFrame, family: str) -> DataFrame:
    """The two-edge law that a new edge would break with the edges that stand."""
    if family == "acts":
        back = facts.where(F.col("p") == "repeals").select(F.col("o").alias("s"), "p", F.col("s").alias("o")).distinct()
        return pairs.join(back, ["s", "p", "o"], "left_semi").withColumn("_two", F.lit("L4"))
    held = facts.where(F.col("p") == "sole_director_of").select("p", "o").distinct()
    return pairs.join(held, ["p", "o"], "left_semi").select("s", "p", "o").withColumn("_two", F.lit("I3"))


def cycle(facts, nodes, faults, relation: str, rate: str, seed: str, blind: bool = False):
    """Mirrors of true edges; the mirror breaks a one-edge law (informed) or none (blind)."""
    pool = _sound(facts.where(F.col("p") == relation), faults)
    back = facts.where(F.col("p") == relation).select(F.col("o").alias("s"), F.col("s").alias("o")).distinct()
    pool = pool.join(back, ["s", "o"], "left_anti").select("id", "s", "p", "o")
    mirror = laws.violations(pool.select(F.col("id").alias("true_id"), F.col("o").alias("s"), "p", F.col("s").alias("o")), nodes, two_edge=False)
    mirror = cut(mirror.where((F.size("laws") == 0) if blind else (F.size("laws") > 0)), "mirrors")
    chosen = cut(sampling.sample(mirror, _triple(), scalars.share_count(rate, mirror.count(), True), seed), "cycle")
    found = chosen.select(F.lit("SPURIOUS_EDGE").alias("damage"), "s", "p", "o", F.concat(F.array(F.lit("L4")), "laws").alias("visible_by_law"), F.lit("blind" if blind else "informed").alias("arm"), F.col("true_id").alias("cycle_with"))
    return _injected(facts, chosen), nodes, events(found)


def rival(facts, nodes, faults, relation: str, rate: str, seed: str, law: str = "I3"):
    """A second source for targets that have one, drawn from the relation's sources.

    The rate is of all such targets. A target tries up to ``SOURCE_TRIES`` different sources, from a place in hash order that
    follows its own hash; the first that is neither its source, nor itself, nor stands already is taken, and a target without one is left.
    """
    own = facts.where(F.col("p") == relation)
    single = own.where(F.col("id").isNotNull()).groupBy("o").agg(F.count(F.lit(1)).alias("_n"), F.min("s").alias("true_s"), F.min("id").alias("true_id")).where("_n = 1")
    targets = cut(sampling.sample(single, F.col("o"), scalars.share_count(rate, single.count(), True), seed), "targets")
    sources = own.select("s").distinct().withColumn("_h", sampling.hashed(seed, F.col("s")))
    ranked = cut(sampling.sequential_ids(sources, ["_h", "s"], "%d", "_k").select("s", F.col("_k").cast("long")), "sources")
    size = ranked.count()
    begin = F.conv(F.substring(sampling.hashed(seed, F.concat(F.lit("rival|"), "o")), 1, 13), 16, 10).cast("long")
    tries = targets.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(SOURCE_TRIES, size)))))).withColumn("_k", F.pmod(begin + F.col("_d"), F.lit(max(1, size))) + 1)
    drawn = tries.join(ranked, "_k").where((F.col("s") != F.col("true_s")) & (F.col("s") != F.col("o"))).join(own.select("s", "o").distinct(), ["s", "o"], "left_anti")
    chosen = cut(drawn.groupBy("o", "true_id").agg(F.min_by("s", "_d").alias("s")).select("s", F.lit(relation).alias("p"), "o", "true_id"), "rival")
    found = chosen.select(F.lit("SPURIOUS_EDGE").alias("damage"), "s", "p", "o", F.array(F.lit(law)).alias("visible_by_law"), F.lit("blind").alias("arm"), F.col("true_id").alias("cycle_with"))
    return _injected(facts, chosen), nodes, events(found)


def _replace(nodes: DataFrame, changed: DataFrame, column: str) -> DataFrame:
    """``changed``: node, new."""
    value = changed.select(F.col("node").alias("id"), F.col("new").alias("_new"), F.lit(True).alias("_hit"))
    rows = nodes if column in nodes.columns else nodes.withColumn(column, F.lit(None).cast("string"))
    return rows.join(value, "id", "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit").select(*rows.columns)


def anachronism(facts, nodes, faults, _den: str, rate: str, seed: str):
    pool = nodes.where((F.col("date_document_status") == "ok") & scalars.iso_date(F.col("date_document")).isNotNull())
    chosen = sampling.sample(pool, F.col("id"), scalars.share_count(rate, pool.count()), seed)
    chosen = cut(chosen.select(F.col("id").alias("node"), F.col("date_document").alias("old"), scalars.next_year(F.col("date_document")).alias("new")), "anachronism")
    found = chosen.select(F.lit("ANACHRONISM").alias("damage"), "node", F.col("old").alias("truth_date"), F.col("new").alias("injected_date"))
    return facts, _replace(nodes, chosen, "date_document"), events(found)


def wrong_label(facts, nodes, faults, _den: str, rate: str, seed: str):
    """One of the seven other types, by hash."""
    pool = nodes.withColumn("_true", scalars.type_label(F.col("celex"))).where(F.col("_true").isNotNull())
    others = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in sorted(scalars.TYPES.values())]), F.array("_true")))
    at = F.pmod(F.conv(F.substring(sampling.hashed(seed, F.concat(F.lit("label|"), "id")), 1, 8), 16, 10).cast("long"), F.lit(len(scalars.TYPES) - 1)).cast("int") + 1
    chosen = sampling.sample(pool, F.col("id"), scalars.share_count(rate, pool.count()), seed)
    chosen = cut(chosen.select(F.col("id").alias("node"), F.col("_true").alias("old"), F.element_at(others, at).alias("new")), "label")
    found = chosen.select(F.lit("WRONG_LABEL").alias("damage"), "node", F.col("old").alias("truth_label"), F.col("new").alias("injected_label"), F.array(F.lit("L6")).alias("visible_by_law"))
    return facts, _replace(nodes, chosen, "type_label"), events(found)


def wrong_value(facts, nodes, faults, _den: str, rate: str, seed: str):
    pool = nodes.where(F.coalesce("celex", F.lit("")) != "")
    chosen = sampling.sample(pool, F.col("id"), scalars.share_count(rate, pool.count()), seed)
    chosen = cut(chosen.select(F.col("id").alias("node"), F.col("celex").alias("old"), scalars.bumped(F.col("celex")).alias("new")), "value")
    found = chosen.select(F.lit("WRONG_VALUE").alias("damage"), "node", F.lit("celex").alias("property"), F.col("old").alias("truth_value"), F.col("new").alias("injected_value"))
    return facts, _replace(nodes, chosen, "celex"), events(found)


def degrees(facts: DataFrame) -> DataFrame:
    """Edges at each node; a self-loop counts twice."""
    return facts.select(F.explode(F.array("s", "o")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def merge(facts, nodes, faults, _den: str, rate: str, seed: str):
    """Pairs of nodes become one; a rewritten edge that equals a true one keeps the true id."""
    pool = degrees(facts).where(F.col("degree").between(*MERGE_DEGREES)).join(nodes.select("id"), "id", "left_semi")
    n = scalars.share_count(rate, pool.count()) // 2
    chosen = cut(sampling.sample(pool, F.col("id"), 2 * n, seed).select("id", sampling.hashed(seed, F.col("id")).alias("_h")), "merge")
    ranked = sampling.sequential_ids(chosen, ["_h", "id"], "%d", "_k").select("id", (F.col("_k").cast("long") - 1).alias("_k"))
    pair = cut(ranked.groupBy(F.expr("_k div 2").alias("_pair")).agg(F.min_by("id", "_k").alias("kept"), F.max_by("id", "_k").alias("absorbed")).select("kept", "absorbed"), "pairs")
    to = pair.select(F.col("absorbed"), F.col("kept"))
    rows = facts.join(to.select(F.col("absorbed").alias("s"), F.col("kept").alias("_s")), "s", "left").join(to.select(F.col("absorbed").alias("o"), F.col("kept").alias("_o")), "o", "left")
    moved = rows.where(F.col("_s").isNotNull() | F.col("_o").isNotNull())
    touched = moved.select("id", F.explode(F.array_compact(F.array(F.when(F.col("_s").isNotNull(), F.col("s")), F.when(F.col("_o").isNotNull(), F.col("o"))))).alias("absorbed"))
    ids = touched.groupBy("absorbed").agg(F.array_sort(F.collect_list("id")).alias("moved_facts"))
    new = rows.select("id", F.coalesce("_s", "s").alias("s"), "p", F.coalesce("_o", "o").alias("o"), (F.col("_s").isNotNull() | F.col("_o").isNotNull()).alias("_moved"))
    new = new.where(~F.col("_moved") | (F.col("s") != F.col("o")))
    kept = new.where(~F.col("_moved")).drop("_moved")
    rewritten = new.where("_moved").groupBy("s", "p", "o").agg(F.min("id").alias("id")).join(kept.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")
    found = pair.join(ids, "absorbed", "left").select(F.lit("MERGE").alias("damage"), "kept", "absorbed", F.coalesce("moved_facts", F.array().cast("array<string>")).alias("moved_facts"))
    return kept.select("id", "s", "p", "o").unionByName(rewritten.select("id", "s", "p", "o")), nodes.join(pair.select(F.col("absorbed").alias("id")), "id", "left_anti"), events(found)


def split(facts, nodes, faults, _den: str, rate: str, seed: str):
    """A twin takes every second edge of a node, in sort order."""
    pool = degrees(facts).where(F.col("degree").between(*SPLIT_DEGREES)).join(nodes.select("id"), "id", "left_semi")
    chosen = cut(sampling.sample(pool, F.col("id"), scalars.share_count(rate, pool.count()), seed).select(F.col("id").alias("node")), "split")
    ends = facts.withColumn("node", F.explode(F.array_distinct(F.array("s", "o")))).join(chosen, "node", "left_semi")
    second = F.row_number().over(Window.partitionBy("node").orderBy("s", "p", "o")) % 2 == 0  # at most eight rows a node
    moved = cut(ends.withColumn("_second", second).where("_second").select("node", "id", "s", "p", "o"), "moved")
    # An edge may leave at both ends, so the ends are gathered per edge.
    ways = moved.groupBy("s", "p", "o").agg(F.collect_set("node").alias("_nodes"))
    twin = lambda c: F.when(F.array_contains(F.col("_nodes"), F.col(c)), F.concat(F.col(c), F.lit("#split"))).otherwise(F.col(c))
    rows = facts.join(ways, ["s", "p", "o"], "left")
    rows = rows.select("id", F.coalesce(twin("s"), "s").alias("s"), "p", F.coalesce(twin("o"), "o").alias("o"))
    ids = moved.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("moved_facts"))
    found = chosen.join(ids, "node", "left").select(F.lit("SPLIT").alias("damage"), "node", F.concat("node", F.lit("#split")).alias("twin"), "moved_facts")
    twins = nodes.join(chosen.select(F.col("node").alias("id")), "id", "left_semi").withColumn("id", F.concat("id", F.lit("#split")))
    return rows, nodes.unionByName(twins), events(found)


def duplicate(facts, nodes):
    """A copy of the first true triple in sort order."""
    first = facts.where(F.col("id").isNotNull()).orderBy("s", "p", "o").limit(1)
    return _injected(facts, first), nodes, events(first.select(F.lit("DUPLICATE").alias("damage"), "s", "p", "o"))


_APPLY = {"MISSING": missing, "RIVAL": rival, "ANACHRONISM": anachronism, "WRONG_LABEL": wrong_label, "WRONG_VALUE": wrong_value, "MERGE": merge, "SPLIT": split}


def inject(facts: DataFrame, nodes: DataFrame, faults: DataFrame, damages: list[Damage], seed: str, visible: str | None = None, family: str = "acts", copy: bool = False):
    """Apply damages in rank order; each samples from the graph the one before left, so lineage is cut between them."""
    facts, nodes, journal = large(facts), large(nodes), None
    for k, d in enumerate(sorted(damages, key=lambda d: RANKS.get(d.kind, 2))):
        own, before = f"{seed}|{k}|{d.denominator}|{d.kind}", (facts, nodes)
        if d.kind == "SPURIOUS_EDGE":
            facts, nodes, found = spurious(facts, nodes, faults, d.denominator, d.rate, own, visible, family)
        elif d.kind in ("CYCLE", "CYCLE_BLIND"):
            facts, nodes, found = cycle(facts, nodes, faults, d.denominator, d.rate, own, d.kind == "CYCLE_BLIND")
        elif d.kind == "DUPLICATE":
            facts, nodes, found = duplicate(facts, nodes)
        else:
            facts, nodes, found = _APPLY[d.kind](facts, nodes, faults, d.denominator, d.rate, own)
        # What a damage leaves alone stands already.
        facts, nodes = facts if facts is before[0] else cut(facts, "facts"), nodes if nodes is before[1] else cut(nodes, "nodes")
        found = cut(found, "events")
        journal = found if journal is None else journal.unionByName(found)
    if copy:
        facts, nodes, found = duplicate(facts, nodes)
        journal = found if journal is None else journal.unionByName(found)
    if "type_label" not in nodes.columns:
        nodes = nodes.withColumn("type_label", F.lit(None).cast("string"))
    nodes = nodes.withColumn("type_label", F.coalesce("type_label", scalars.type_label(F.col("celex"))))
    return facts, nodes, journal


def journal_counts(journal: DataFrame) -> DataFrame:
    """kind, n; spurious edges apart by whether a law shows them."""
    seen = F.size(F.coalesce("visible_by_law", F.array().cast("array<string>"))) > 0
    kind = F.when(F.col("damage") == "SPURIOUS_EDGE", F.when(seen, "SPURIOUS_EDGE visible").otherwise("SPURIOUS_EDGE invisible")).otherwise(F.col("damage"))
    return journal.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
