"""Seeded sampling without order: rows are ranked by a hash of seed and key.

A sample of ``n`` takes the ``n`` least hashes. The rank of the boundary is found from counts of
65,536 hash ranges, so only the rows of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom._cut import cut


def hashed(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), key), 256)


def sample(df: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """The ``n`` rows of least hash (all if there are fewer); rows of equal keys are told apart by nothing."""
    rows = df.withColumn("_h", hashed(seed, key)).withColumn("_range", F.substring("_h", 1, 4))
    left, edge = n, None
    for r in sorted(rows.groupBy("_range").count().toLocalIterator()):  # at most 65,536 rows
        if r[1] > left:
            edge = r[0]
            break
        left -= r[1]
    if edge is None:
        return rows.drop("_h", "_range") if left >= 0 and n > 0 else df.limit(0)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_h"))
    last = rows.where(F.col("_range") == edge).withColumn("_k", rank).where(F.col("_k") <= left)
    return rows.where(F.col("_range") < edge).unionByName(last.drop("_k")).drop("_h", "_range")


def by_stratum(df: DataFrame, stratum: str, key: Column, quotas: dict[str, int], seed: str) -> DataFrame:
    """The rows of least hash of each stratum, up to its quota."""
    parts = [sample(df.where(F.col(stratum) == s), key, n, seed) for s, n in sorted(quotas.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dealt(df: DataFrame, key: Column, names: tuple[str, ...], seed: str, out: str = "auditor") -> DataFrame:
    """Rows of a (small) sample dealt in turn to ``names`` in hash order."""
    rank = F.row_number().over(Window.orderBy(hashed(seed, key), key)) - 1
    return df.withColumn(out, F.element_at(F.array(*[F.lit(x) for x in names]), (rank % len(names) + 1).cast("int")))


def chance(seed: str, key: Column, p: float) -> Column:
    """True with probability ``p``, by 52 bits of the hash."""
    return F.conv(F.substring(hashed(seed, key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) < F.lit(p)


def sequential_ids(df: DataFrame, order: list[str], form: str, out: str = "id") -> DataFrame:
    """Gapless ids in sort order (``form`` as ``f-%06d``): range partitions, each with an offset from the counts."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts, at = [], 0
    for r in sorted(ranged.groupBy("_part").count().collect()):  # one row a partition
        counts.append((r[0], at))
        at += r[1]
    base = df.sparkSession.createDataFrame(counts, "_part int, _base long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_rank", rank).join(F.broadcast(base), "_part").withColumn(out, F.format_string(form, F.col("_base") + F.col("_rank"))).drop("_part", "_base", "_rank")


def small_truth(facts: DataFrame, must: DataFrame, stratum: str, each: int, n: int, seed: str) -> DataFrame:
    """A sample of ``n`` facts that holds the facts ``must`` (id), then ``each`` more of every stratum, then any others by hash."""
    key = F.col("id")
    held = cut(facts.join(must.select("id").distinct(), "id", "left_semi"), "must")
    rest = facts.join(held.select("id"), "id", "left_anti")
    quotas = {r[0]: each for r in facts.select(stratum).distinct().toLocalIterator()}  # one row a stratum
    if quotas:
        held = cut(held.select(*facts.columns).unionByName(by_stratum(rest, stratum, key, quotas, f"{seed}|each").select(*facts.columns)), "each")
    left = facts.join(held.select("id"), "id", "left_anti").select(*facts.columns)
    return held.unionByName(sample(left, key, max(0, n - held.count()), f"{seed}|fill").select(*facts.columns))
