"""Training-order materialisation of token sequences in fixed-stride binary shards.

One pass tokenises the documents of a task into a stream (each document's ids and an end id) and cuts it
into sequences of ``length`` ids; only a task's last one is padded. The sequences are written to a table, and the counts
of its tasks (one number each) give every sequence a dense number below the number of all sequences, N.
A keyed Feistel network on the next even number of bits, walked along its cycle until it falls below N, permutes these
numbers: the image is the sequence's global slot. A shard holds a fixed number of consecutive slots, so slot ``s`` stands
in shard ``s div capacity`` at ``(s mod capacity) * stride``, which a reader computes without an index; the inverse
permutation leads from a slot back to the sequence's number. Shards are range partitions, each sorted and
written as one file of fixed stride, read forward from any slot. They are shuffled and written in ``WAVES`` turns, each a range of shards
whose shuffle is dropped before the next one's, so that the disk holds the table, the shards and a part of the shuffle only.

The number of shards follows N. A task that runs again writes the same bytes and moves them over the first
(each file is written under a name of its own and renamed).

Defined cases: a null or empty text is the end id alone; repeated rows are written each; an
empty table writes no shard and gives no rows; pieces of one document in several sequences are listed in each; a very long
text is a stretch of sequences; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import _store, tokens
from factloom.llm._common import arrow_column, map_arrow, materialise, scratch

LENGTH = 1024
SHARD_BYTES = 64 << 20
LEAST_SHARDS = 12
ROUNDS = 6
END = 0
#: Turns in which the shards are written; each reads the table of sequences once.
WAVES = 3
#: Whether Spark drops the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Feistel:
    """A keyed permutation of ``range(size)``."""

    def __init__(self, size: int, key: bytes, rounds: int = ROUNDS) -> None:
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        digest = hashlib.sha256(key).digest()
        self.keys = [int.from_bytes(hashlib.sha256(digest + bytes([r])).digest()[:8], "little") for r in range(rounds)]

    def _round(self, right: int, key: int) -> int:
        x = (right ^ key) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 31)) & self.mask

    def __call__(self, i: int) -> int:
        while True:
            left, right = i >> self.half, i & self.mask
            for k in self.keys:
                left, right = right, left ^ self._round(right, k)
            i = (left << self.half) | right
            if i < self.size:
                return i

    def many(self, numbers: np.ndarray) -> np.ndarray:
        """The images of an array, all walked together."""
        out, left_over = numbers.astype(np.uint64), np.arange(len(numbers))
        mask, half = np.uint64(self.mask), np.uint64(self.half)
        while len(left_over):
            x = out[left_over]
            left, right = x >> half, x & mask
            for k in self.keys:
                y = right ^ np.uint64(k)
                y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((y ^ (y >> np.uint64(31))) & mask)
            out[left_over] = (left << half) | right
            left_over = left_over[out[left_over] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def back(self, i: int) -> int:
        while True:
            left, right = i >> self.half, i & self.mask
            for k in reversed(self.keys):
                left, right = right ^ self._round(left, k), left
            i = (left << self.half) | right
            if i < self.size:
                return i


def _sequences(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(path)
        last = np.array([end], encode.width)
        task, made = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        owners: list[tuple[int | None, int, int]] = []  # (doc_id, first id in the document, ids) held
        size = 0

        def emit(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, owners, size, made
            if not size:
                return
            stream = np.concatenate(held)
            n = -(-size // length) if final else size // length
            rows: list[tuple] = []
            who, at = 0, 0
            for k in range(n):
                part, docs, starts, left = stream[k * length : (k + 1) * length], [], [], length
                while left and who < len(owners):
                    doc, first, count = owners[who]
                    take = min(left, count - at)
                    docs.append(doc)
                    starts.append(first + at)
                    left -= take
                    at += take
                    if at == count:
                        who, at = who + 1, 0
                padded = part if len(part) == length else np.concatenate([part, np.full(length - len(part), end, encode.width)])
                rows.append((task, made, len(part), docs, starts, padded.tobytes()))
                made += 1
            held = [stream[n * length :]] if n * length < size else []
            owners = [(owners[who][0], owners[who][1] + at, owners[who][2] - at), *owners[who + 1 :]] if who < len(owners) else []
            size = max(0, size - n * length)
            for a in range(0, len(rows), 1024):
                cols = list(zip(*rows[a : a + 1024], strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["task", "made", "n_ids", "doc_ids", "starts", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), last])
                held.append(ids)
                owners.append((doc.as_py(), 0, len(ids)))
                size += len(ids)
                if size > 1 << 20:
                    yield from emit(False)
        yield from emit(True)

    return run


def _write(folder: str, capacity: int):
    """Files of consecutive slots; rows come sorted by shard and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        out, shard, index = None, None, 0
        for batch in batches:
            index_of, offsets, crc = [], [], []
            for s, slot, raw in zip(batch.column(0), batch.column(1), batch.column(5), strict=True):
                s, raw = s.as_py(), raw.as_py()
                if s != shard:
                    if out is not None:
                        out.close()
                    out, shard, index = _store.Writer(folder, f"shard-{s:06d}.bin"), s, 0
                if slot.as_py() != s * capacity + index:
                    raise ValueError("slots of a shard follow each other")
                offsets.append(out.write(raw))
                index_of.append(index)
                crc.append(zlib.crc32(raw))
                index += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(index_of, pa.int64()), pa.array(offsets, pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "slot", "n_ids", "doc_ids", "starts", "index", "offset", "ids_crc32"],
            )
        if out is not None:
            out.close()

    return run


def _dropped(spark: SparkSession, run):
    """What ``run`` returns; shuffles of the queries in it end with them."""
    old = spark.conf.get(DROPPED, None)
    spark.conf.set(DROPPED, "true")
    try:
        return run()
    finally:
        spark.conf.unset(DROPPED) if old is None else spark.conf.set(DROPPED, old)


def write_in_training_order(docs: DataFrame, folder: str | None = None, key: bytes = b"epoch-0", path: str | None = None, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; one row per sequence: slot, shard, index, offset, stride, capacity, n_ids, doc_ids, starts, ids_crc32."""
    spark = docs.sparkSession
    path = path or tokens.default_path()
    folder = folder or scratch(spark, "order")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stride = length * tokens.encoder(path).width.itemsize
    cut = materialise(map_arrow(rows, _sequences(path, length, END), "task int, made long, n_ids long, doc_ids array<long>, starts array<long>, ids binary"), "order-sequences")
    base, total = [], 0
    for task, n in sorted((r[0], r[1]) for r in cut.groupBy("task").count().toLocalIterator()):  # one row a task
        base.append((task, total))
        total += n
    order = Feistel(max(1, total), key)
    capacity = max(1, min(shard_bytes // stride, -(-total // LEAST_SHARDS)))

    def slots(batches: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        for (number,) in batches:
            yield pa.array(order.many(number.to_numpy(zero_copy_only=False)), pa.int64())

    numbered = cut.join(F.broadcast(spark.createDataFrame(base, "task int, _base long")), "task")
    numbered = numbered.withColumn("slot", arrow_column(spark, slots, "long", F.col("_base") + F.col("made")))
    numbered = numbered.select(F.expr(f"cast(slot div {capacity} as int)").alias("shard"), "slot", "n_ids", "doc_ids", "starts", "ids")
    _store.make(folder)
    shards = max(1, -(-total // capacity))
    wave, index = -(-shards // WAVES), None
    for first in range(0, shards, wave):
        n = min(wave, shards - first)
        written = (
            numbered.where(F.col("shard").between(first, first + n - 1))
            .repartitionById(n, F.col("shard") - first)
            .sortWithinPartitions("shard", "slot")
            .mapInArrow(_write(folder, capacity), "shard int, slot long, n_ids long, doc_ids array<long>, starts array<long>, index long, offset long, ids_crc32 long")
        )
        rows = _dropped(spark, lambda written=written: materialise(written, "order-index"))
        index = rows if index is None else index.unionByName(rows)
    return index.select("slot", "shard", "index", "offset", F.lit(stride).cast("long").alias("stride"), F.lit(capacity).cast("long").alias("capacity"), "n_ids", "doc_ids", "starts", "ids_crc32")


def read_sequence(folder: str, shard: int, index: int, length: int = LENGTH, width: type = np.uint16) -> np.ndarray:
    """The ids of one sequence by a single range read."""
    stride = length * np.dtype(width).itemsize
    reader = _store.Reader(folder)
    try:
        return np.frombuffer(reader.read(f"shard-{shard:06d}.bin", index * stride, stride), width)
    finally:
        reader.close()
