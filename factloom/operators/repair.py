"""Candidates: witnesses, conflicts of constraints, minimum-weight deletions, label repair, read-back of marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom._cut import cut
from factloom._ship import ship
from factloom.functions import scalars
from factloom.operators import laws, sampling

EDGE_WEIGHT, SIGNAL_WEIGHT = 2, 3
#: Components of at most so many elements are searched for the least deletions, in at most so many steps.
EXACT, STEPS = 64, 50_000


def untouched(facts: DataFrame) -> DataFrame:
    return facts


def rule_only(facts: DataFrame, nodes: DataFrame, family: str = "acts") -> DataFrame:
    """Without every edge that is part of an edge law's violation."""
    return laws.violations(facts, nodes, family).where(F.size("laws") == 0).drop("laws")


def node_weights(nodes: DataFrame, facts: DataFrame, labels: Column) -> DataFrame:
    """id, weight = 2 x degree + labels + 1."""
    degree = facts.select(F.explode(F.array("s", "o")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
    return nodes.join(degree, "id", "left").select("id", (2 * F.coalesce("_d", F.lit(0)) + labels + 1).alias("weight"))


def greedy_pairs(conflicts: DataFrame) -> DataFrame:
    """The least element of each conflict by (weight, element, type); exact where conflicts share no element.

    ``conflicts``: conflict_id, element_id, element_type, weight.
    """
    best = F.min(F.struct("weight", "element_id", "element_type")).alias("_m")
    tied = conflicts.groupBy("conflict_id").agg(best, F.count(F.lit(1)).alias("_n"), F.collect_list("weight").alias("_w"))
    return tied.select("conflict_id", "_m.element_id", "_m.element_type", "_m.weight", (F.size(F.filter("_w", lambda w: w == F.array_min(F.col("_w")))) == 1).alias("optimum_unique"))


def components(conflicts: DataFrame, rounds: int = 64) -> DataFrame:
    """conflict_id, component: least conflict reachable over shared elements, by label propagation along elements and a jump to the label's own label, so that long chains settle in few rounds."""
    members = cut(conflicts.select("conflict_id", "element_id").distinct(), "members")
    label = members.select("conflict_id", F.col("conflict_id").alias("component")).distinct()
    for _ in range(rounds):
        least = members.join(label, "conflict_id").groupBy("element_id").agg(F.min("component").alias("_l"))
        new = cut(members.join(least, "element_id").groupBy("conflict_id").agg(F.min("_l").alias("component")), "component")
        up = new.select(F.col("conflict_id").alias("component"), F.col("component").alias("_up"))
        new = cut(new.join(up, "component").select("conflict_id", F.col("_up").alias("component")), "component")
        moved = new.join(label.withColumnRenamed("component", "_old"), "conflict_id").where(F.col("component") != F.col("_old"))
        done = moved.isEmpty()
        label = new
        if done:
            return label
    raise RuntimeError("components did not settle")


def least_hitting_set(groups: list[frozenset], weight: dict, steps: int = STEPS) -> tuple[frozenset, bool] | None:
    """The set of least weight (then of least names) that hits every group, and whether no other set is as light; None if the steps run out.

    Branch and bound: the open group with the fewest elements is hit by each of its elements in turn, later branches without the earlier ones.
    """
    best: list = [None, None, False]
    left = steps

    def go(taken: tuple, cost, banned: frozenset, open_groups: list[frozenset]) -> bool:
        nonlocal left
        left -= 1
        if left < 0:
            return False
        if best[0] is not None and cost > best[0]:
            return True
        if not open_groups:
            names = tuple(sorted(taken))
            if best[0] is None or cost < best[0]:
                best[:] = [cost, names, True]
            else:
                best[1], best[2] = min(best[1], names), False
            return True
        free = min((g - banned for g in open_groups), key=lambda g: (len(g), sorted(g)))
        for x in sorted(free, key=lambda x: (weight[x], x)):
            if not go((*taken, x), cost + weight[x], banned, [g for g in open_groups if x not in g]):
                return False
            banned = banned | {x}
        return True

    return (frozenset(best[1] or ()), best[2]) if go((), 0, frozenset(), list(dict.fromkeys(groups))) else None


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """The deletions of one small component; those of the greedy choice, not ``exact``, where the search is too long."""
    groups = [frozenset(g) for _, g in rows.sort_values("conflict_id").groupby("conflict_id")["element_id"]]
    weight = dict(zip(rows["element_id"], rows["weight"].tolist(), strict=True))
    found = least_hitting_set(groups, weight)
    if found is None:
        chosen: set = set()
        for g in groups:
            if not g & chosen:
                chosen.add(min(g, key=lambda e: (weight[e], e)))
        found = (frozenset(chosen), None)
    out = pd.DataFrame({"element_id": sorted(found[0])})
    return out.assign(component=rows["component"].iloc[0], exact=found[1] is not None, optimum_unique=found[1])[["component", "element_id", "exact", "optimum_unique"]]


def _greedy(own: DataFrame) -> DataFrame:
    """What taking conflicts in order, each unhit one giving its least element, would delete.

    In each round every conflict decides that no earlier undecided conflict could hit; the least one always can,
    and with hashed ids the number of rounds grows with the logarithm of the conflicts.
    """
    left, found = cut(own, "conflicts"), None
    while found is None or not left.isEmpty():
        picks = left.groupBy("component", "conflict_id").agg(F.min(F.struct("weight", "element_id")).alias("_m")).select("component", "conflict_id", F.col("_m.element_id").alias("element_id"))
        earliest = picks.groupBy("element_id").agg(F.min("conflict_id").alias("_first"))
        ready = left.join(earliest, "element_id").groupBy("conflict_id").agg(F.min("_first").alias("_first")).where(F.col("_first") == F.col("conflict_id")).select("conflict_id")
        chosen = cut(picks.join(ready, "conflict_id", "left_semi").select("component", "element_id").distinct(), "chosen")
        hit = left.join(chosen.select("element_id"), "element_id", "left_semi").select("conflict_id").distinct()
        left = cut(left.join(hit, "conflict_id", "left_anti"), "conflicts")
        found = chosen if found is None else found.unionByName(chosen)
    return found


def deletions(conflicts: DataFrame, exact: bool = False) -> DataFrame:
    """component, element_id, exact, optimum_unique: a hitting set of every component of conflicts, greedy in conflict order.

    With ``exact``, components of at most ``EXACT`` elements are searched for the least weight; ``exact`` marks those where the search
    ended, and ``optimum_unique`` (null elsewhere) those without another set as light.
    """
    own = conflicts.join(components(conflicts), "conflict_id").select("component", "conflict_id", "element_id", "weight").distinct()
    marked = lambda rows: rows.select("component", "element_id", F.lit(False).alias("exact"), F.lit(None).cast("boolean").alias("optimum_unique"))
    if not exact:
        return marked(_greedy(own))
    ship(conflicts.sparkSession)
    own = cut(own, "components")
    sizes = cut(own.groupBy("component").agg(F.count_distinct("element_id").alias("_n"), F.count_distinct("conflict_id").alias("_c")), "sizes")
    # A conflict by itself needs no search.
    alone = greedy_pairs(own.join(sizes.where("_c = 1"), "component", "left_semi").withColumn("element_type", F.lit("")))
    alone = alone.select(F.col("conflict_id").alias("component"), "element_id", F.lit(True).alias("exact"), "optimum_unique")
    several = sizes.where("_c > 1")
    small = several.where(F.col("_n") <= EXACT).select("component")
    solved = own.join(small, "component", "left_semi").groupBy("component").applyInPandas(_solve, "component string, element_id string, exact boolean, optimum_unique boolean")
    large = several.where(F.col("_n") > EXACT).select("component")
    return alone.unionByName(solved).unionByName(marked(_greedy(own.join(large, "component", "left_semi"))))


def all_but_heaviest(edges: DataFrame) -> DataFrame:
    """s, p, o to delete so that every target keeps one source of a relation: the heaviest, of equals the last by name.

    What a constraint of one source asks of all pairs of sources, without making the pairs: in a group where any two exclude
    each other, the least deletions are all but the heaviest. ``edges``: s, p, o, weight.
    """
    kept = edges.groupBy("p", "o").agg(F.max(F.struct("weight", "s")).alias("_k")).select("p", "o", F.col("_k.s").alias("s"))
    return edges.select("s", "p", "o").join(kept, ["s", "p", "o"], "left_anti")


def exported(facts: DataFrame, nodes: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) for a graph store: edges with the key ``e:<k>:s|p|o`` (k: their place in sort order) and ``conf``, nodes with the key ``n:id`` and the type of their key."""
    conf = F.coalesce(F.col(weight), F.lit(EDGE_WEIGHT)) if weight else F.lit(EDGE_WEIGHT)
    ranked = sampling.sequential_ids(facts.withColumn("conf", conf), ["s", "p", "o"], "%d", "_k")
    edges = ranked.select("s", "p", "o", "conf", F.concat(F.lit("e:"), (F.col("_k").cast("long") - 1).cast("string"), F.lit(":"), edge_key()).alias("key"))
    return edges, nodes.withColumn("key", F.concat(F.lit("n:"), "id")).withColumn("celex_type", scalars.type_label(F.col("celex")))


def stored(df: DataFrame, path: str) -> None:
    """Replace what stands at the path."""
    df.write.mode("overwrite").parquet(path)


def edge_key() -> Column:
    return F.concat_ws("|", "s", "p", "o")


def mutual_conflicts(facts: DataFrame, relation: str = "repeals") -> DataFrame:
    """Two-edge conflicts of mutual edges, one for each unordered pair."""
    two = laws.mutual(facts, relation, loops=False)
    pair = F.concat_ws("|", F.least("s", "o"), "p", F.greatest("s", "o"))
    return two.select(pair.alias("conflict_id"), edge_key().alias("element_id"), F.lit("edge").alias("element_type"), F.lit(EDGE_WEIGHT).alias("weight"))


def signalled(conflicts: DataFrame, true_edges: DataFrame, accuracy: float, seed: str) -> DataFrame:
    """Weights of a signal that prefers the true edge of a conflict with probability ``accuracy``."""
    truth = true_edges.select(edge_key().alias("element_id"), F.lit(True).alias("_true"))
    right = sampling.chance(seed, F.col("conflict_id"), accuracy)
    rows = conflicts.join(truth, "element_id", "left").withColumn("_true", F.coalesce("_true", F.lit(False)))
    return rows.withColumn("weight", F.when(F.col("_true") == right, F.lit(SIGNAL_WEIGHT)).otherwise(F.col("weight"))).drop("_true")


def rivals(journal: DataFrame, arm: str) -> DataFrame:
    """false and true edge of each mirrored pair of an arm."""
    own = journal.where((F.col("damage") == "SPURIOUS_EDGE") & (F.col("arm") == arm))
    return own.select(F.struct("s", "p", "o").alias("false_edge"), F.struct(F.col("o").alias("s"), F.col("p"), F.col("s").alias("o")).alias("true_edge"))


def without(facts: DataFrame, nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph less marked edges (s, p, o) and marked nodes (id) with their edges."""
    kept = facts.join(edges.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")
    ids = gone.select("id").distinct()
    for end in ("s", "o"):
        kept = kept.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return kept.select(*facts.columns), nodes.join(ids, "id", "left_anti")


def label_repair(nodes: DataFrame) -> DataFrame:
    """Nodes without the labels that their key contradicts."""
    bad = laws.label_violations(nodes).select("id", "wrong")
    return nodes.join(bad, "id", "left").withColumn("labels", F.when(F.col("wrong").isNotNull(), F.array_except("labels", "wrong")).otherwise(F.col("labels"))).drop("wrong")


def second_witness(nodes: DataFrame) -> DataFrame:
    """The type set to what the key says."""
    return nodes.withColumn("type_label", F.coalesce(scalars.type_label(F.col("celex")), "type_label"))


def first_known_label(labels: Column) -> Column:
    return F.try_element_at(F.filter(labels, lambda x: x.isin(*scalars.TYPES.values())), F.lit(1))


def read_back(facts: DataFrame, nodes: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, nodes, deleted nodes) after marks: kind ∈ edge (s, p, o), node (id), label (id, label)."""
    gone = marks.where(F.col("kind") == "node").select("id")
    kept, left = without(facts, nodes, marks.where(F.col("kind") == "edge"), gone)
    dropped = marks.where(F.col("kind") == "label").groupBy("id").agg(F.collect_set("label").alias("_gone"))
    left = left.join(dropped, "id", "left").withColumn("labels", F.array_except("labels", F.coalesce("_gone", F.array().cast("array<string>")))).drop("_gone")
    return kept, left.withColumn("type_label", first_known_label(F.col("labels"))), gone


def apply_journal(facts: DataFrame, journal: DataFrame) -> DataFrame:
    """Injected edges added, removed ones taken out."""
    gone = journal.where(F.col("damage") == "MISSING").select("s", "p", "o")
    new = journal.where(F.col("damage") == "SPURIOUS_EDGE").select("s", "p", "o")
    return facts.select("s", "p", "o").join(gone, ["s", "p", "o"], "left_anti").unionByName(new)


def undo_journal(facts: DataFrame, journal: DataFrame) -> DataFrame:
    """Injected edges taken out; removed ones are not restored."""
    new = journal.where(F.col("damage") == "SPURIOUS_EDGE").select("s", "p", "o")
    return facts.join(new, ["s", "p", "o"], "left_anti")


