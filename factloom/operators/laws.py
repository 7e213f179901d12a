"""Laws of a graph of facts: one-edge, two-edge and node laws as columns over joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom._cut import large
from factloom.functions import scalars

CUTOFF = "2025-07-01"
EDGE_LAWS = {"acts": ("L4", "L1", "L2", "L3"), "registry": ("I1", "I3")}


#: What the laws of a family read of a node.
READS = {"acts": ("id", "celex", "gap", "date_document", "date_document_status", "date_end_of_validity"), "registry": ("id", "labels", "name")}


def with_ends(facts: DataFrame, nodes: DataFrame, reads: tuple[str, ...] | None = None) -> DataFrame:
    """Facts with both end nodes as structs ``_s`` and ``_o`` (null where a node is missing), of the columns ``reads`` alone."""
    cols = [F.col(c) for c in nodes.columns if reads is None or c in reads]
    left = large(nodes.select(F.col("id").alias("s"), F.struct(*cols).alias("_s")))
    right = large(nodes.select(F.col("id").alias("o"), F.struct(*cols).alias("_o")))
    return facts.join(left, "s", "left").join(right, "o", "left")


def _dated(end: Column) -> Column:
    return F.coalesce(end["date_document_status"] == "ok", F.lit(False))


def order_law(relations: tuple[str, ...] = ("repeals", "amends")) -> Column:
    """L1: the acting document is older than what it acts on."""
    s, o = F.col("_s"), F.col("_o")
    earlier = scalars.iso_date(s["date_document"]) < scalars.iso_date(o["date_document"])
    return F.col("p").isin(*relations) & _dated(s) & _dated(o) & F.coalesce(earlier, F.lit(False))


def expiry_law() -> Column:
    """L2: it acts on a document dated after its own end of validity."""
    s, o = F.col("_s"), F.col("_o")
    later = scalars.iso_date(o["date_document"]) > scalars.iso_date(s["date_end_of_validity"])
    return (F.col("p") == "amends") & _dated(o) & F.coalesce(later, F.lit(False))


def identifier_law(relation: str = "based_on") -> Column:
    """L3: the target is missing, or has no key and is no known gap."""
    o = F.col("_o")
    bare = (F.coalesce(o["celex"], F.lit("")) == "") & ~F.coalesce(o["gap"], F.lit(False))
    return (F.col("p") == relation) & (o["id"].isNull() | bare)


def name_law(relation: str = "same_name_as", labels: tuple[str, ...] = ("Officer", "Entity")) -> Column:
    """I1: both ends carry a label of the pair and non-empty names that differ."""
    allowed = F.array(*[F.lit(x) for x in labels])
    s, o = F.col("_s"), F.col("_o")
    has = lambda e: F.coalesce(F.arrays_overlap(e["labels"], allowed), F.lit(False)) & (F.coalesce(e["name"], F.lit("")) != "")
    return (F.col("p") == relation) & has(s) & has(o) & (s["name"] != o["name"])


def mutual(facts: DataFrame, relation: str = "repeals", loops: bool = True) -> DataFrame:
    """L4: triples whose reverse stands too. A self-loop is its own reverse unless ``loops`` is false."""
    own = facts.where(F.col("p") == relation)
    own = own if loops else own.where(F.col("s") != F.col("o"))
    back = own.select(F.col("o").alias("s"), F.col("p"), F.col("s").alias("o")).distinct()
    return own.select("s", "p", "o").distinct().join(large(back), ["s", "p", "o"], "left_semi")


def rivals_for_target(facts: DataFrame, relation: str = "sole_director_of") -> DataFrame:
    """I3: triples whose target has another source."""
    sources = facts.where(F.col("p") == relation).groupBy("o").agg(F.min("s").alias("_a"), F.max("s").alias("_b")).where(F.col("_a") != F.col("_b")).select("o")
    return facts.where(F.col("p") == relation).select("s", "p", "o").distinct().join(sources, "o", "left_semi").select("s", "p", "o")


def label_violations(nodes: DataFrame) -> DataFrame:
    """L6: labels that name a type other than the one of the key."""
    want = scalars.type_label(F.col("celex"))
    known = F.array(*[F.lit(v) for v in scalars.TYPES.values()])
    wrong = F.filter("labels", lambda x: F.array_contains(known, x) & (x != want))
    found = F.when(want.isNotNull(), wrong)
    return nodes.select("id", want.alias("wanted"), found.alias("wrong")).where(F.size("wrong") > 0)


def inactive_violations(nodes: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """I2: an entity that went inactive by the cutoff and still says Active."""
    when = scalars.timestamp_date(F.col("inactivation_date"))
    return nodes.where(F.array_contains("labels", "Entity") & (when <= F.lit(cutoff).cast("date")) & (F.col("status") == "Active")).select("id")


def violations(facts: DataFrame, nodes: DataFrame, family: str = "acts", two_edge: bool = True) -> DataFrame:
    """Facts with ``laws``: the ids of the laws each breaks, in the order of the family."""
    if family == "acts":
        ends = with_ends(_mutual_marked(facts) if two_edge else facts, _law_values(nodes))
        s, o = F.col("_s"), F.col("_o")
        flags = {
            "L1": F.col("p").isin("repeals", "amends") & F.coalesce(s["ok"] < o["ok"], F.lit(False)),
            "L2": (F.col("p") == "amends") & F.coalesce(o["ok"] > s["until"], F.lit(False)),
            "L3": (F.col("p") == "based_on") & F.coalesce(o["bare"], F.lit(True)),
        }
        if two_edge:
            flags["L4"] = F.col("_two")
    else:
        ends, flags = with_ends(facts, nodes, READS[family]), {"I1": name_law()}
        if two_edge:
            ends = ends.join(large(rivals_for_target(facts).distinct().withColumn("_two", F.lit(True))), ["s", "p", "o"], "left")
            flags["I3"] = F.coalesce("_two", F.lit(False))
    order = [x for x in EDGE_LAWS[family] if x in flags]
    laws = F.array_compact(F.array(*[F.when(flags[x], F.lit(x)) for x in order]))
    return ends.select(*facts.columns, laws.alias("laws"))


def _law_values(nodes: DataFrame) -> DataFrame:
    """id, ok, until, bare: what L1 to L3 read of an act, read once a node and short: its date if that is sound, its end of validity, whether it has no key and is no gap."""
    date = F.when(F.col("date_document_status") == "ok", scalars.iso_date(F.col("date_document")))
    bare = (F.coalesce("celex", F.lit("")) == "") & ~F.coalesce("gap", F.lit(False))
    return nodes.select("id", date.alias("ok"), scalars.iso_date(F.col("date_end_of_validity")).alias("until"), (F.col("id").isNotNull() & bare).alias("bare"))


def _mutual_marked(facts: DataFrame, relation: str = "repeals") -> DataFrame:
    """Facts with ``_two``: whether the reverse of the triple stands too (L4). Only facts of the relation are shuffled, by the pair of their ends."""
    own = F.coalesce(F.col("p") == relation, F.lit(False)) & F.col("s").isNotNull() & F.col("o").isNotNull()
    pair = Window.partitionBy(F.least("s", "o"), F.greatest("s", "o"))
    two = F.max(F.col("s") <= F.col("o")).over(pair) & F.max(F.col("s") >= F.col("o")).over(pair)
    return facts.where(own).withColumn("_two", two).unionByName(facts.where(~own).withColumn("_two", F.lit(False)))


def order_census(facts: DataFrame, nodes: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """p, n, broken of L1; only facts of the relations and the dates of nodes travel."""
    ends = with_ends(facts.where(F.col("p").isin(*relations)), nodes, ("id", "date_document", "date_document_status"))
    return ends.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(order_law(relations)).alias("broken"))


def path_ends(facts: DataFrame, start: str, steps: tuple[str, ...], depth: int) -> DataFrame:
    """Targets reached from the targets of ``start`` by one to ``depth`` edges of ``steps`` (a bounded quantified path)."""
    edges = facts.where(F.col("p").isin(*steps)).select(F.col("s").alias("at"), F.col("o").alias("next")).distinct()
    front = facts.where(F.col("p") == start).select(F.col("s").alias("source"), F.col("o").alias("at")).distinct()
    reached = None
    for k in range(depth):
        front = front.join(edges, "at").select("source", F.col("next").alias("at")).distinct()
        level = front.select("source", F.col("at").alias("target"), F.lit(k + 1).alias("steps"))
        reached = level if reached is None else reached.unionByName(level)
    return reached.groupBy("source", "target").agg(F.min("steps").alias("steps"))


def unique_source(facts: DataFrame, relation: str) -> DataFrame:
    """The same as ``rivals_for_target`` by a window, for facts already dealt by target."""
    w = Window.partitionBy("p", "o")
    own = facts.where(F.col("p") == relation)
    return own.withColumn("_a", F.min("s").over(w)).withColumn("_b", F.max("s").over(w)).where(F.col("_a") != F.col("_b")).drop("_a", "_b")
