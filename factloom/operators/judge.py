"""The judge: status of every fact, of everything extra, per relation and per damage. Relations are never pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import canon

TRIPLE = ["s", "p", "o"]


def bound(expected: str | None, found: str | None, what: str) -> None:
    """Refuse a candidate of another truth or journal."""
    if found is not None and expected != found:
        raise ValueError(f"the candidate answers another {what}")


def copies(candidate: DataFrame) -> DataFrame:
    return candidate.groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("copies"))


def fact_status(truth: DataFrame, candidate: DataFrame, faults: DataFrame, abstained: DataFrame) -> DataFrame:
    """fact_id, s, p, o, status, kind, known_fault, duplicate.

    ``faults``: fact, kind, seq (the last kind of a fact counts).
    """
    fault = faults.where(F.col("fact").isNotNull()).groupBy("fact").agg(F.max_by("kind", "seq").alias("kind"))
    rows = (
        truth.select(F.col("id").alias("fact_id"), *TRIPLE)
        .join(copies(candidate), TRIPLE, "left")
        .join(abstained.select(*TRIPLE).distinct().withColumn("_abstained", F.lit(True)), TRIPLE, "left")
        .join(fault.withColumnRenamed("fact", "fact_id"), "fact_id", "left")
    )
    seen = F.when(F.col("copies") > 0, "found").when(F.col("_abstained"), "abstained").otherwise("missed")
    gone = F.when(F.col("kind") == "law_violation", "removed").otherwise("corrected")
    known = F.col("kind").isNotNull()
    return rows.select(
        "fact_id",
        *TRIPLE,
        F.when(known, "known_fault").otherwise(seen).alias("status"),
        "kind",
        F.when(known, F.when(seen == "missed", gone).otherwise(seen)).alias("known_fault"),
        F.when(~known & (F.col("copies") > 1), F.col("copies") - 1).otherwise(F.lit(0)).alias("duplicate"),
    )


def extra_status(truth: DataFrame, candidate: DataFrame, nodes: DataFrame, gaps: DataFrame, world: DataFrame) -> DataFrame:
    """s, p, o, status, copies of what the truth does not hold; the order of the tests is fixed."""
    extra = copies(candidate).join(truth.select(*TRIPLE).distinct(), TRIPLE, "left_anti")
    known = nodes.select("id", F.lit(True).alias("_has"), F.lit(False).alias("_gap")).unionByName(gaps.select(F.col("node").alias("id"), F.lit(False).alias("_has"), F.lit(True).alias("_gap")))
    known = known.groupBy("id").agg(F.max("_has").alias("_has"), F.max("_gap").alias("_gap"))
    for end in ("s", "o"):
        extra = extra.join(known.select(F.col("id").alias(end), F.when(F.col("_has"), True).alias(f"_has_{end}"), F.when(F.col("_gap"), True).alias(f"_gap_{end}")), end, "left")
    extra = extra.join(world.select("p", "closed"), "p", "left")
    status = (
        F.when(F.col("closed").isNull(), "out_of_coverage")
        .when(F.col("_has_s").isNull() | F.col("_has_o").isNull(), "unresolved")
        .when(F.col("_gap_s").isNotNull() | F.col("_gap_o").isNotNull(), "out_of_coverage")
        .when(~F.col("closed"), "out_of_coverage")
        .otherwise("false")
    )
    return extra.select(*TRIPLE, status.alias("status"), "copies", F.col("closed").isNotNull().alias("counted"))


def dimensions(status: DataFrame, extra: DataFrame, world: DataFrame) -> DataFrame:
    """One row a relation of the world, with every count behind its ratios."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    known = F.col("status") == "known_fault"
    own = status.groupBy("p").agg(
        n(~known).alias("n_truth"),
        n(F.col("status") == "found").alias("found"),
        n(F.col("status") == "abstained").alias("abstained"),
        n(F.col("status") == "missed").alias("missed"),
        n(known).alias("known_fault"),
        F.sum("duplicate").alias("duplicate"),
    )
    more = extra.where("counted").groupBy("p").agg(
        F.sum(F.when(F.col("status") == "false", F.col("copies")).otherwise(0)).alias("false_facts"),
        n(F.col("status") == "unresolved").alias("unresolved"),
        n(F.col("status") == "out_of_coverage").alias("out_of_coverage"),
    )
    out = world.select("p", "closed").join(own, "p", "left").join(more, "p", "left")
    counts = ("n_truth", "found", "abstained", "missed", "known_fault", "duplicate", "false_facts", "unresolved", "out_of_coverage")
    return out.select("p", "closed", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def ratios(dims: DataFrame) -> DataFrame:
    """p, metric, num, den; precision only where the relation is closed."""
    rows = F.array(
        F.struct(F.lit("precision").alias("metric"), F.when(F.col("closed"), F.col("found")).alias("num"), F.when(F.col("closed"), F.col("found") + F.col("duplicate") + F.col("false_facts")).alias("den")),
        F.struct(F.lit("recall").alias("metric"), F.col("found").alias("num"), F.col("n_truth").alias("den")),
        F.struct(F.lit("silence").alias("metric"), F.col("abstained").alias("num"), F.col("n_truth").alias("den")),
    )
    return dims.select("p", F.inline(rows))


def stated_recall(status: DataFrame, stated: DataFrame) -> DataFrame:
    """Recall on facts that a text states, the histogram of the overlay, and what is missed and not stated."""
    rows = status.where(F.col("status") != "known_fault").join(stated.select("fact_id", "stated"), "fact_id", "left").withColumn("stated", F.coalesce("stated", F.lit("unknown")))
    yes, no, found, missed = F.col("stated") == "yes", F.col("stated") == "no", F.col("status") == "found", F.col("status") == "missed"
    counts = [F.count_if(F.col("stated") == x).alias(f"stated_{x}") for x in ("yes", "no", "unclear", "unknown")]
    return rows.groupBy("p").agg(F.count_if(yes & found).alias("num"), F.count_if(yes).alias("den"), *counts, F.count_if(missed & no).alias("missed_and_not_stated"))


def anachronisms(truth_nodes: DataFrame, candidate_nodes: DataFrame, faults: DataFrame) -> DataFrame:
    """node, truth, candidate, shifted for every comparable date."""
    bad = faults.where(F.col("node").isNotNull()).select(F.col("node").alias("id")).distinct()
    own = truth_nodes.where(F.col("date_document_status") == "ok").join(bad, "id", "left_anti").select("id", F.col("date_document").alias("truth"))
    other = candidate_nodes.select("id", F.col("date_document").alias("candidate")).where(F.col("candidate").isNotNull())
    both = own.join(other, "id")
    return both.select(F.col("id").alias("node"), "truth", "candidate", (~scalars.iso_date(F.col("truth")).eqNullSafe(scalars.iso_date(F.col("candidate")))).alias("shifted"))


def collateral(status: DataFrame, deleted: DataFrame) -> DataFrame:
    """Missed facts with an end among the deleted nodes: two keyed joins rather than one with OR."""
    gone = deleted.select("id").distinct()
    rows = status.where(F.col("status") == "missed")
    for end in ("s", "o"):
        rows = rows.join(gone.select(F.col("id").alias(end)).withColumn(f"_{end}", F.lit(True)), end, "left")
    return rows.where(F.col("_s").isNotNull() | F.col("_o").isNotNull()).select("fact_id", *TRIPLE)


def buckets(events: DataFrame, candidate: DataFrame, candidate_nodes: DataFrame) -> DataFrame:
    """bucket, outcome, n: what became of each injected damage."""
    seen = copies(candidate)
    edge = events.where(F.col("damage").isin("SPURIOUS_EDGE", "MISSING")).join(seen, TRIPLE, "left")
    here = F.col("copies").isNotNull()
    visible = F.size(F.coalesce("visible_by_law", F.array().cast("array<string>"))) > 0
    edge = edge.select(
        F.when(F.col("damage") == "MISSING", "MISSING").otherwise(F.when(visible, "SPURIOUS_EDGE visible").otherwise("SPURIOUS_EDGE invisible")).alias("bucket"),
        F.when(F.col("damage") == "MISSING", here).otherwise(~here).alias("caught"),
    )
    nodes = candidate_nodes.select(F.col("id").alias("node"), "date_document", "celex", "type_label", F.lit(True).alias("_here"))
    value = events.where(F.col("damage").isin("ANACHRONISM", "WRONG_VALUE", "WRONG_LABEL", "SPLIT")).join(nodes, "node", "left")
    caught = (
        F.when(F.col("damage") == "ANACHRONISM", F.col("date_document").eqNullSafe(F.col("truth_date")))
        .when(F.col("damage") == "WRONG_VALUE", F.col("celex").eqNullSafe(F.col("truth_value")))
        .when(F.col("damage") == "WRONG_LABEL", F.col("_here").isNull() | ~F.col("type_label").eqNullSafe(F.col("injected_label")))
        .otherwise(F.lit(False))
    )
    value = value.select(F.col("damage").alias("bucket"), caught.alias("caught"))
    merged = events.where(F.col("damage") == "MERGE").join(nodes.select(F.col("node").alias("absorbed"), "_here"), "absorbed", "left").select(F.lit("MERGE").alias("bucket"), F.col("_here").isNotNull().alias("caught"))
    return edge.unionByName(value).unionByName(merged).groupBy("bucket", F.when(F.col("caught"), "caught").otherwise("missed").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def arms(events: DataFrame, status: DataFrame, candidate: DataFrame) -> DataFrame:
    """arm, and how many true edges are kept or broken and false edges deleted or kept."""
    rows = events.where(F.col("arm").isNotNull()).join(copies(candidate), TRIPLE, "left").select("arm", F.col("cycle_with").alias("fact_id"), F.col("copies").isNull().alias("deleted"))
    rows = rows.join(status.select("fact_id", (F.col("status") == "found").alias("kept")), "fact_id", "left")
    return rows.groupBy("arm").agg(F.count_if("kept").alias("true_kept"), F.count_if(~F.coalesce("kept", F.lit(False))).alias("true_broken"), F.count_if("deleted").alias("false_deleted"), F.count_if(~F.col("deleted")).alias("false_kept"))


def wrongly_broken(status: DataFrame, events: DataFrame) -> DataFrame:
    """Missed facts that no damage removed or moved."""
    removed = events.where(F.col("damage") == "MISSING").select(*TRIPLE).distinct()
    moved = events.select(F.explode("moved_facts").alias("fact_id")).where(F.col("fact_id").isNotNull()).distinct()
    return status.where(F.col("status") == "missed").join(removed, TRIPLE, "left_anti").join(moved, "fact_id", "left_anti")


def nodes_dimension(shifts: DataFrame, candidate_nodes: DataFrame) -> DataFrame:
    """One row: metric, num, den, value of the anachronism of nodes; undefined in words where the candidate has no nodes."""
    has = not candidate_nodes.isEmpty()
    rows = shifts.agg(F.count_if("shifted").alias("num"), F.count(F.lit(1)).alias("den")).select(F.lit("anachronism").alias("metric"), *[(F.col(c) if has else F.lit(None).cast("long")).alias(c) for c in ("num", "den")])
    return rows.withColumn("value", scalars.ratio_value(F.col("num"), F.col("den")) if has else F.lit("undefined (candidate has no nodes)"))


def known_violations_removed(status: DataFrame) -> DataFrame:
    """One row: the faults by a law that the candidate does not hold."""
    return status.agg(F.count_if((F.col("kind") == "law_violation") & (F.col("known_fault") == "removed")).alias("known_violations_removed"))


def twins(events: DataFrame, candidate_nodes: DataFrame) -> DataFrame:
    """outcome, n: twins of splits deleted and kept, and the true facts that they took."""
    own = events.where(F.col("damage") == "SPLIT").select("twin", F.size(F.array_compact(F.coalesce("moved_facts", F.array().cast("array<string>")))).alias("_m"))
    here = candidate_nodes.select(F.col("id").alias("twin")).distinct().withColumn("_here", F.lit(True))
    rows = own.join(here, "twin", "left")
    counts = rows.agg(F.count_if(F.col("_here").isNull()).alias("_d"), F.count_if("_here").alias("_k"), F.coalesce(F.sum("_m"), F.lit(0)).alias("_m"))
    pairs = F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(c).cast("long").alias("n")) for n, c in (("deleted", "_d"), ("kept", "_k"), ("true facts it took, not restored", "_m"))])
    return counts.select(F.inline(pairs))


def ordered(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in order for a sink: facts by fact_id, extra by p, s, o, anachronisms by node."""
    return rows.orderBy(*by)


def verdict(head: dict, parts: dict[str, DataFrame]) -> dict:
    """A record that names truth, candidate and journal (``head``), with the row count and digest of each part, and its own hash.

    The digests come from hashes of rows, so neither the order nor the partitions of candidate or truth change the record.
    """
    record = dict(head)
    for name, rows in sorted(parts.items()):
        found = canon.dataset_digest(rows).head()
        record[name] = {"n": found["n"], "digest": found["digest"]}
    return canon.sealed(record)
