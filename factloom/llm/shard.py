"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups sorted by size enter the fullest bin that still takes them, found in a balanced tree
(a treap over (room, bin)). Groups of one size are interchangeable and stay in the same
bin as long as it takes them, so the packing runs on the histogram of group sizes: the driver
sees one row for each distinct size (with a total of T bytes at most sqrt(2 T) of them) and returns, for
each size, ranges of ranks with their bin. Ranks and slots are counted in salted parts whose small
counts give the offsets, so no task holds all groups of a size or all rows of a shard. Rows of the largest groups (a thousandth
of all rows or more) learn their shard by a broadcast, so no group gathers in one task. Texts are
reduced to a digest in the scan and never shuffled.

``pack`` opens as many bins of a fixed capacity as needed. ``shard`` finds the smallest
capacity for which best fit needs no more than ``shards`` bins, which makes their sizes near equal.

Defined cases: a null text has size 1 (no bytes) and is a group of its own row; rows with equal
texts share a shard unless the group alone exceeds a shard's capacity: only then it is dealt
by a hash of doc_id into parts, each indivisible; repeated rows are separate rows in one
shard; an empty table gives no rows; a very long text that exceeds a shard's capacity is a shard's only large group; bins of
equal room are taken by number; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._common import fresh, join_groups, materialise, row_key

SHARDS = 8
PARTS = 64


class Treap:
    """A balanced tree of (room, bin): insert, and take the least element not below a room."""

    def __init__(self) -> None:
        self.key: list[tuple[int, int]] = []
        self.rank: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.root, self.seed = -1, 0x9E3779B97F4A7C15

    def _node(self, key: tuple[int, int]) -> int:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        self.key.append(key)
        self.rank.append(self.seed >> 20)
        self.left.append(-1)
        self.right.append(-1)
        return len(self.key) - 1

    def _split(self, t: int, key: tuple[int, int]) -> tuple[int, int]:
        """Nodes below ``key``, and the others."""
        if t < 0:
            return -1, -1
        if self.key[t] < key:
            a, b = self._split(self.right[t], key)
            self.right[t] = a
            return t, b
        a, b = self._split(self.left[t], key)
        self.left[t] = b
        return a, t

    def _merge(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        if self.rank[a] > self.rank[b]:
            self.right[a] = self._merge(self.right[a], b)
            return a
        self.left[b] = self._merge(a, self.left[b])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, self._node(key)), b)

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with at least ``room``."""
        a, b = self._split(self.root, (room, -1))
        if b < 0:
            self.root = a
            return None
        t = b
        while self.left[t] >= 0:
            t = self.left[t]
        key = self.key[t]
        mid, rest = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, rest)
        return key


def best_fit(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best-fit-decreasing over (size, count): (size, first rank, end rank, bin); None if more than ``most`` bins are needed.

    A size above the capacity gets bins of its own.
    """
    tree, bins, plan = Treap(), 0, []
    if most is not None:
        for b in range(most):
            tree.insert((capacity, b))
        bins = most
    for size, count in sorted(histogram, reverse=True):
        done = 0
        while done < count:
            got = tree.take(size)
            if got is None:
                if most is not None:
                    return None
                got = (max(capacity, size), bins)
                bins += 1
            room, b = got
            n = min(count - done, room // size if size else count - done)
            plan.append((size, done, done + n, b))
            done += n
            tree.insert((room - n * size, b))
    return plan


def tightest(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The plan of the smallest capacity (within a 4096th) for which best fit needs no more than ``shards`` bins."""
    total = sum(s * c for s, c in histogram)
    low = max([-(-total // shards), *(s for s, _ in histogram)], default=1)
    if (plan := best_fit(histogram, low, shards)) is not None:
        return plan
    high = low + max(s for s, _ in histogram)
    while (plan := best_fit(histogram, high, shards)) is None:
        high *= 2
    while high - low > max(1, low >> 12):
        mid = (low + high) // 2
        if (tried := best_fit(histogram, mid, shards)) is None:
            low = mid
        else:
            high, plan = mid, tried
    return plan


def ranked(df: DataFrame, by: list[str], order: list, out: str, parts: int = PARTS) -> DataFrame:
    """A gapless rank from 0 within ``by``; counted in parts by a hash of the order columns, of which only the counts meet.

    ``order`` names the columns that fix the rank; rows equal in all of them are alike.
    """
    part, start = fresh(df, "_part"), fresh(df, "_start")
    df = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = df.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(part)
    starts = counts.select(*by, part, (F.sum("_n").over(w) - F.col("_n")).alias(start))
    within = Window.partitionBy(*by, part).orderBy(*order)
    return (
        df.withColumn(out, F.row_number().over(within).cast("long") - 1)
        .join(starts, [*by, part])
        .withColumn(out, F.col(out) + F.col(start))
        .drop(part, start)
    )


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, text_key (the group), law, shard, slot for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    base = materialise(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNull(), row_key(F.lit("null"), F.col("doc_id"))).otherwise(row_key(F.lit("text"), text)).alias("text_key"),
        ),
        "shard-rows",
    )
    total = base.agg(F.sum("size")).head()[0]
    if total is None:
        total = 0
    cap = -(-total // shards)
    # Fewer than ``shards`` groups can exceed a share of 1/shards of all bytes.
    whole = base.groupBy("text_key").agg(F.sum("size").alias("_bytes"))
    large = [r[0] for r in whole.where(F.col("_bytes") > F.lit(cap)).select("text_key").take(shards)]
    split = F.col("text_key").isin([bytes(k) for k in large]) if large else F.lit(False)
    base = base.withColumn("_piece", F.when(split, F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).otherwise(F.lit(0)))
    groups = materialise(base.groupBy("text_key", "_piece").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")), "shard-groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("_bytes").count().toLocalIterator()]
    ranges: dict[int, list[tuple[int, int]]] = {}
    for size, first, _, b in tightest(histogram, shards) if histogram else []:
        ranges.setdefault(size, []).append((first, b))
    plan = spark.createDataFrame(
        [(s, r) for s, r in ranges.items()], "_bytes long, _ranges array<struct<first: long, bin: int>>"
    )
    placed = ranked(groups, ["_bytes"], ["text_key", "_piece"], "_rank").join(plan, "_bytes")
    upto = F.filter("_ranges", lambda r: r["first"] <= F.col("_rank"))
    placed = materialise(placed.select("text_key", "_piece", F.element_at(upto, -1)["bin"].alias("shard"), "_rows"), "shard-placed")
    rows = join_groups(base, placed, ["text_key", "_piece"], "_rows", base.count()).drop("_piece")
    rows = ranked(rows, ["shard"], ["doc_id", "text_key"], "slot", parts=PARTS * 4)
    return rows.withColumn("law", F.lit("bytes"))
