"""Human audit: drawing the sample, majority votes, rates and agreement, per relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import sampling


def draw(facts: DataFrame, quotas: dict[str, int], shared: int, auditors: tuple[str, ...], seed: str, unreadable: DataFrame | None = None) -> DataFrame:
    """Facts of each relation up to its quota, ``shared`` of them for everyone, the rest dealt in turn.

    Facts whose subject is ``unreadable`` (id) are replaced by the next of their relation in hash order; the others keep their place in the sample.
    """
    readable = facts if unreadable is None else facts.join(unreadable.select(F.col("id").alias("s")).distinct(), "s", "left_anti").select(*facts.columns)
    pool = sampling.by_stratum(readable, "p", F.col("id"), quotas, seed)
    common = sampling.sample(pool, F.col("id"), shared, f"{seed}|shared").withColumn("shared", F.lit(True))
    rest = pool.join(common.select("id"), "id", "left_anti").withColumn("shared", F.lit(False))
    everyone = common.withColumn("auditor", F.explode(F.array(*[F.lit(a) for a in auditors])))
    return everyone.unionByName(sampling.dealt(rest, F.col("id"), auditors, seed))


def majority(answers: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """fact_id, verdict: the answer of more than half, ``disagreement`` without one, ``unanswered`` without votes.

    A correction first replaces every vote of a fact that has votes.
    """
    votes = answers.select("fact_id", "answer")
    if corrections is not None:
        fixed = corrections.select("fact_id", F.col("to").alias("_to"))
        votes = votes.join(fixed, "fact_id", "left").select("fact_id", F.when(F.col("answer").isNotNull(), F.coalesce("_to", "answer")).alias("answer"))
    counts = votes.groupBy("fact_id", "answer").agg(F.count("answer").alias("_n"))
    total = counts.groupBy("fact_id").agg(F.sum("_n").alias("_total"), F.max(F.struct("_n", "answer")).alias("_top"))
    verdict = F.when(F.col("_total") == 0, "unanswered").when(2 * F.col("_top._n") > F.col("_total"), F.col("_top.answer")).otherwise("disagreement")
    return total.select("fact_id", verdict.alias("verdict"))


def rates(verdicts: DataFrame, facts: DataFrame) -> DataFrame:
    """p, yes, no, unreadable, disagreement, unanswered and the error ratio no / (yes + no)."""
    rows = facts.select(F.col("id").alias("fact_id"), "p").join(verdicts, "fact_id")
    n = lambda x: F.count_if(F.col("verdict") == x)
    return rows.groupBy("p").agg(n("oui").alias("yes"), n("non").alias("no"), n("illisible").alias("unreadable"), n("disagreement").alias("disagreement"), n("unanswered").alias("unanswered"), n("non").alias("error_num"), F.count_if(F.col("verdict").isin("oui", "non")).alias("error_den"))


def agreement(answers: DataFrame) -> DataFrame:
    """fact_id, state of facts put to several auditors: unanimous, split or not enough answers."""
    rows = answers.groupBy("fact_id").agg(F.count("answer").alias("_n"), F.count_distinct("answer").alias("_d"))
    return rows.select("fact_id", F.when(F.col("_n") < 2, "not enough answers").when(F.col("_d") == 1, "unanimous").otherwise("split").alias("state"))


def category_rates(categories: DataFrame, facts: DataFrame) -> DataFrame:
    return facts.select(F.col("id").alias("fact_id"), "p").join(categories, "fact_id").groupBy("p", "category").agg(F.count(F.lit(1)).alias("n"))


def extract_pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Facts without a located extract so far."""
    return wanted.join(done.where(F.col("located")).select("fact_id"), "fact_id", "left_anti")
