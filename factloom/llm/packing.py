"""Hierarchical multi-length packing.

Each document becomes its token ids and an end id. Whole windows of ``context`` tokens are
sequences of their own; the rest of a document is routed to the smallest of several context tiers
that takes it. Tiers are packed from the longest down: a window opens with its largest piece, its gap is filled
with the largest pieces of shorter tiers that fit, and where none fits a piece is cut to fill it. A
shorter tier's window is only closed when it is exactly full; what is left goes into windows of full length. Windows
are then dealt in turn to step groups, so that groups hold the same mix of fillings.

The plan works on the histogram of lengths (at most ``context`` rows): pieces of one length
are interchangeable, so a pattern of lengths is repeated as often as its scarcest length allows, and
what a pattern takes is a range of ranks. Documents get their rank within a length from counts in salted parts, whose number
follows the rows, so that a length that many documents share is no single task; the driver sees the histogram alone (``context`` rows).
Texts are tokenised once; their ids, not the texts, are dealt by length and part.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each on their
own; an empty table gives no pieces; every id lies in exactly one piece; a very long text is whole windows and a rest; documents of
one length are ranked by doc_id and ids; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm._common import map_arrow, materialise

CONTEXT = 1024
TIERS = (1024, 512, 256, 128)
PARTS, PART_ROWS = 64, 250_000
SLACK = 8
END = 0
STEP = 8


class Pool:
    """Pieces by length, as ranges of ranks: (documents' length class, first rank, end rank, start in the rest)."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        self.n: dict[int, int] = {}
        self.sizes: list[int] = []
        for size, count in sorted(histogram.items()):
            self.add(size, (size, 0, count, 0))

    def add(self, size: int, part: tuple[int, int, int, int]) -> None:
        if size not in self.n:
            insort(self.sizes, size)
        self.ranges.setdefault(size, []).append(part)
        self.n[size] = self.n.get(size, 0) + part[2] - part[1]

    def take(self, size: int, k: int) -> list[tuple[int, int, int, int]]:
        self.n[size] -= k
        got, ranges = [], self.ranges[size]
        while k:
            c, a, b, s = ranges.pop()
            if b - a > k:
                ranges.append((c, a + k, b, s))
                b = a + k
            got.append((c, a, b, s))
            k -= b - a
        if not self.n[size]:
            del self.n[size], self.ranges[size]
            self.sizes.remove(size)
        return got

    def upto(self, most: int) -> int | None:
        """The largest length that is at most ``most``."""
        k = bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else None

    def above(self, least: int) -> int | None:
        """The smallest length above ``least`` that leaves a piece worth having, else any above it."""
        for add in (32, 0):
            k = bisect_right(self.sizes, least + add)
            if k < len(self.sizes):
                return self.sizes[k]
        return None


def plan(histogram: dict[int, int], context: int = CONTEXT, tiers: tuple[int, ...] = TIERS, slack: int = SLACK):
    """(segments, number of windows); a segment: (class, first rank, end rank, start, length, window of the first rank, offset, tier)."""
    pool, out, windows, waiting = Pool(histogram), [], 0, []

    def place(slots: list[tuple[int, int]], k: int, tier: int) -> None:
        nonlocal windows
        offset = 0
        for size, used in slots:
            at = windows
            for c, a, b, s in pool.take(size, k):
                out.append((c, a, b, s, used, at, offset, tier))
                at += b - a
                if used < size:
                    pool.add(size - used, (c, a, b, s + used))
            offset += used
        windows += k

    def close(tier: int, lead: int) -> bool:
        """Fill windows that open with ``lead``; False if they can't be filled exactly and must be."""
        slots, gap, held = [(lead, lead)], tier - lead, {lead: 1}
        while gap:
            size = pool.upto(min(gap, tier))
            while size is not None and held.get(size, 0) >= pool.n[size]:
                size = pool.upto(size - 1)
            used = size
            if size is None:
                if gap <= slack and tier == context:
                    break
                size = pool.above(gap)
                while size is not None and held.get(size, 0) >= pool.n[size]:
                    k = bisect_right(pool.sizes, size)
                    size = pool.sizes[k] if k < len(pool.sizes) else None
                used = gap
                if size is None:
                    if tier == context:
                        break
                    return False
            slots.append((size, used))
            held[size] = held.get(size, 0) + 1
            gap -= used
        k = min(pool.n[s] // n for s, n in held.items())
        place(slots, k, tier)
        return True

    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        while (lead := pool.upto(tier)) is not None and lead > below:
            if not close(tier, lead):
                c = pool.take(lead, pool.n[lead])
                waiting += [(lead, part) for part in c]
    for size, part in waiting:
        pool.add(size, part)
    while (lead := pool.upto(context)) is not None:
        close(context, lead)
    return out, windows


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, n (ids with the end id) and ids (little-endian, 2 or 4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        last = np.array([end], encode.width)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                ids = [np.concatenate([encode(t.as_py() or ""), last]) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                    names=["doc_id", "n", "ids"],
                )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, ids binary")


def pack(docs: DataFrame, path: str | None = None, context: int = CONTEXT, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, tier, step_group."""
    spark = docs.sparkSession
    path = path or tokens.default_path()
    width = tokens.encoder(path).width
    ids = materialise(tokenised(docs, path), "tokens")
    part = F.pmod(F.xxhash64("doc_id", "n"), F.lit(max(PARTS, ids.count() // PART_ROWS))).cast("int")
    ids = ids.select("*", (F.col("n") % context).cast("int").alias("_rest"), F.expr(f"n div {context}").alias("_full"), part.alias("_part"))
    counts = materialise(ids.groupBy("_rest", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_full").alias("_f")), "packing-counts")
    totals = sorted((r[0], r[1], r[2]) for r in counts.groupBy("_rest").agg(F.sum("_n"), F.sum("_f")).coalesce(1).toLocalIterator())  # at most context rows
    histogram = {rest: n for rest, n, _ in totals if rest}
    full, before = 0, []
    for rest, _, f in totals:
        before.append((rest, full))
        full += f
    segments, windows = plan(histogram, context, tiers)
    groups = max(1, -(-(full + windows) // STEP))
    parts = Window.partitionBy("_rest").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = counts.join(F.broadcast(spark.createDataFrame(before, "_rest int, _full0 long")), "_rest")
    start = start.select("_rest", "_part", (F.sum("_n").over(parts) - F.col("_n")).alias("_rank0"), (F.sum("_f").over(parts) - F.col("_f") + F.col("_full0")).alias("_full0"))
    w = Window.partitionBy("_rest", "_part").orderBy("doc_id", F.xxhash64("ids"))
    ranked = (
        ids.withColumn("_rank", F.row_number().over(w).cast("long") - 1)
        .withColumn("_before", F.sum("_full").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_full"))
        .join(start, ["_rest", "_part"])
        .select("doc_id", "n", "ids", "_rest", (F.col("_rank") + F.col("_rank0")).alias("_rank"), (F.col("_before") + F.col("_full0")).alias("_first"))
    )
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return map_arrow(ranked, _cutter(spark.sparkContext.broadcast(segments), full, groups, context, width), schema)


def _lookup(segments: list[tuple]) -> dict[int, tuple[list[int], list[list[tuple]]]]:
    """For each class: rank boundaries, and the segments that hold from each boundary on."""
    by: dict[int, list[tuple]] = {}
    for s in segments:
        by.setdefault(s[0], []).append(s)
    found = {}
    for c, own in by.items():
        edges = sorted({e for s in own for e in s[1:3]})
        at = {e: k for k, e in enumerate(edges)}
        held: list[list[tuple]] = [[] for _ in edges]
        for s in own:
            for k in range(at[s[1]], at[s[2]]):
                held[k].append(s)
        found[c] = (edges, [sorted(h, key=lambda s: s[3]) for h in held])
    return found


def _cutter(segments, full: int, groups: int, context: int, width: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _lookup(segments.value)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, n, raw, rest, rank, first in zip(*(batch.column(k) for k in range(6)), strict=True):
                ids = np.frombuffer(raw.as_py(), width).astype("<u4")
                doc, n, rest, rank, first = (x.as_py() for x in (doc, n, rest, rank, first))
                held += n
                for k in range(n // context):
                    s = first + k
                    out.append((doc, k * context, context, ids[k * context : (k + 1) * context].tobytes(), n, s, 0, context, s % groups))
                if rest:
                    edges, own = table[rest]
                    for _, a, _, start, length, window, offset, tier in own[bisect_right(edges, rank) - 1]:
                        s, at = full + window + rank - a, n - rest + start
                        out.append((doc, at, length, ids[at : at + length].tobytes(), n, s, offset, tier, s % groups))
                if held > 1 << 20:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
