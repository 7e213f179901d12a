"""Exact substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Each window's minimiser is the
least hash of its ``gram``-word subsequences. Consecutive windows that share their minimiser form a
super-k-mer: one packed string (the words joined by a space) that travels to the bucket of the
minimiser. Equal windows have equal minimisers, so they meet in one bucket, where sorting counts them
exactly: windows are sorted by a 64-bit hash, and neighbours are then compared byte by byte.

Skew. Before they travel, equal strings of one chunk of input are folded: their windows stand
twice, so every copy but one is settled on the spot and one is sent, marked as repeated. A first pass
finds the word sequences that are more frequent than a bucket's share (a task reports those whose
local share reaches half that, so none is missed and no list exceeds 4 x buckets); they are
taken as minimisers last, which keeps text beside a common passage out of that passage's bucket. The
number of buckets follows the bytes of the input, so a bucket has a fixed expected size. A bucket that chunks without number
send one passage to folds its equal strings again whenever they reach ``HELD_BYTES``, and what is settled travels by its row, not
through a bucket. Packed strings are compressed per bucket. Covered ranges and the rows (compressed batches) then meet once, dealt by a row
key: a part's ranges come first, and its rows stream past them.

Defined cases: a null or empty text, or one of white space only, has no words and nothing is removed;
fewer than ``window`` words have no window; a window that recurs inside its own document counts
(overlapping occurrences too); repeated rows remove each other's windows; windows are judged on the
input, not on what is left; a very long text is one chunk by itself; the result's columns get underscores where names clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._common import fresh, map_arrow, materialise, row_key

WINDOW = 35
GRAM = 4
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
HELD_BYTES = 32 << 20
#: At most this many word sequences are minimisers last (8 bytes each in the broadcast).
HEAVY = 1 << 21
PART_BYTES = 32 << 20

_MEET = "part int, kind int, payload binary"
_SENT = "bucket int, settled boolean, key binary, payload binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLOCK = 1 << 19
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        odd = 0x9E3779B97F4A7C15
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (np.uint64(odd), np.uint64(pow(odd, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a text whose words are joined by one space."""
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(text)]])


def word_hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums over the bytes of a block of words."""
    raw, out, a = np.frombuffer(text, np.uint8), np.zeros(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + _BLOCK, "right")))
        low, high = int(start[a]), int(end[b - 1])
        power, inverse = _power(max(_BLOCK, high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=total[1:])
        out[a:b] = (total[end[a:b] - low] - total[start[a:b] - low]) * inverse[start[a:b] - low]
        a = b
    return _mix(out)


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive words."""
    n = len(h) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return _mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[bytes], bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, text, start and end of its words, first word of each row and the end), at least ``size`` bytes of text at a time; rows without words are left out."""
    keys, docs, counts, held = [], [], [], 0

    def chunk() -> tuple[list[bytes], bytes, np.ndarray, np.ndarray, np.ndarray]:
        text = b" ".join(docs)
        return keys, text, *word_bounds(text), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    for batch in batches:
        for k, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            t = t.as_py()
            words = t.split() if t else None
            if not words:
                continue
            keys.append(k.as_py())
            docs.append(b" ".join(words))
            counts.append(len(words))
            held += len(t)
            if held >= size:
                yield chunk()
                keys, docs, counts, held = [], [], [], 0
    if keys:
        yield chunk()


def _survey(window: int, gram: int, share: float):
    """The sequences frequent in this task, and a row of null with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = {}, 0
        for _, text, start, end, _ in _chunks(batches, CHUNK_BYTES):
            g = gram_hashes(word_hashes(text, start, end), gram)
            total += len(g)
            # Lossy counting: what a chunk has once is dropped where it can't reach the share.
            value, n = np.unique(g, return_counts=True)
            keep = n >= max(2, int(share * len(g)))
            for v, c in zip(value[keep].tolist(), n[keep].tolist(), strict=True):
                seen[v] = seen.get(v, 0) + c
        often = [(v, c) for v, c in seen.items() if c >= share * total]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *(v - (1 << 64) if v >> 63 else v for v, _ in often)], pa.int64()), pa.array([0, *(c for _, c in often)], pa.int64()), pa.array([total] + [0] * len(often), pa.int64())],
            names=["gram", "n", "total"],
        )

    return run


def superkmers(h: np.ndarray, edge: np.ndarray, window: int, gram: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, minimiser) of the super-k-mers of a chunk; ``edge``: word offsets of its documents."""
    g = gram_hashes(h, gram)
    order = g >> np.uint64(1)
    if len(heavy) and len(g):
        at = np.minimum(np.searchsorted(heavy, g), len(heavy) - 1)
        order = order | ((heavy[at] == g).astype(np.uint64) << np.uint64(63))
    least = sliding_min(order, window - gram + 1)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), least
    doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    ok = doc[: len(least)] == doc[window - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    stop = np.flatnonzero(np.concatenate([(new | ~ok)[1:], [True]]) & ok) + 1
    return first, stop - first + window - 1, least[first]


def _dump(keys: np.ndarray, first: np.ndarray, size: np.ndarray, multi: np.ndarray, strings: list[bytes]) -> bytes:
    import zstandard

    raw = len(first).to_bytes(4, "little") + first.astype(np.int32).tobytes() + size.astype(np.int32).tobytes() + multi.astype(np.uint8).tobytes() + keys.tobytes() + b" ".join(strings)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _load(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    first = np.frombuffer(raw, np.int32, n, 4)
    size = np.frombuffer(raw, np.int32, n, 4 + 4 * n)
    multi = np.frombuffer(raw, np.uint8, n, 4 + 8 * n)
    keys = np.frombuffer(raw, "V16", n, 4 + 9 * n)
    return keys, first, size, multi, raw[4 + 25 * n :]


def _merged(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranges merged where they touch, as start, stop, start, stop..."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return np.stack([start[new], reach[last]], 1).astype(np.int32).ravel()


def _sender(window: int, gram: int, buckets: int, heavy_list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.frombuffer(heavy_list.value, np.uint64)
        for keys, text, start, end, edge in _chunks(batches, CHUNK_BYTES):
            first, size, minimiser = superkmers(word_hashes(text, start, end), edge, window, gram, heavy)
            if not len(first):
                continue
            of = np.searchsorted(edge, first, "right") - 1
            strings = [text[a:b] for a, b in zip(start[first].tolist(), end[first + size - 1].tolist(), strict=True)]
            where: dict[bytes, int] = {}
            leader = np.fromiter((where.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
            copies = np.bincount(leader, minlength=len(strings))
            out: list[tuple[int, bool, bytes | None, bytes]] = []
            again = copies[leader] > 1
            if again.any():
                for d in np.unique(of[again]):
                    a, b = np.searchsorted(of, [d, d + 1])
                    pick = a + np.flatnonzero(again[a:b])
                    local = first[pick] - edge[d]
                    out.append((int.from_bytes(keys[d][8:], "little") % buckets, True, keys[d], _merged(local, local + size[pick]).tobytes()))
            sent = np.flatnonzero(leader == np.arange(len(leader)))
            bucket = (minimiser[sent] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            table = np.array(keys, dtype="V16")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                i = sent[a:b]
                out.append((int(bucket[a]), False, None, _dump(table[of[i]], first[i] - edge[of[i]], size[i], copies[i] > 1, [strings[j] for j in i])))
            for a in range(0, len(out), 2000):
                part = out[a : a + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part]), pa.array([x[2] for x in part], pa.binary()), pa.array([x[3] for x in part], pa.binary())],
                    names=["bucket", "settled", "key", "payload"],
                )

    return run


def repeated(text: bytes, size: np.ndarray, multi: np.ndarray, window: int) -> np.ndarray:
    """For strings of ``size`` words each, joined by spaces, whether each window stands twice (flat over all their windows)."""
    start, end = word_bounds(text)
    word = word_hashes(text, start, end)
    n_windows = size.astype(np.int64) - window + 1
    of = np.repeat(np.arange(len(size)), n_windows)
    at = np.arange(len(of)) + np.repeat(np.arange(len(size)) * (window - 1), n_windows)
    power, inverse = _power(len(word) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(word * power[: len(word)])])
    h = _mix((total[at + window] - total[at]) * inverse[at])
    order = np.argsort(h, kind="stable")
    hs = h[order]
    head = np.concatenate([[True], hs[1:] != hs[:-1]])
    group = np.cumsum(head) - 1
    count = np.bincount(group)
    alike = count[group] > 1
    twice = np.zeros(len(h), bool)
    twice[order] = alike
    # Equal hashes are compared byte by byte with the first of their group.
    check = np.flatnonzero(alike)
    lead = order[np.flatnonzero(head)[group[check]]]
    wrong: set[int] = set()
    begin, stop = start[at].tolist(), end[at + window - 1].tolist()
    for w, v, g in zip(order[check].tolist(), lead.tolist(), group[check].tolist(), strict=True):
        if w != v and text[begin[w] : stop[w]] != text[begin[v] : stop[v]]:
            wrong.add(g)
    for g in wrong:  # two sequences with one hash
        seen: dict[bytes, list[int]] = {}
        for w in order[np.flatnonzero(group == g)].tolist():
            seen.setdefault(text[begin[w] : stop[w]], []).append(w)
        for same in seen.values():
            twice[same] = len(same) > 1
    return twice | multi[of].astype(bool)


def _counter(window: int, parts: int):
    def settle(loaded: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        keys, first, size, multi = (np.concatenate([p[k] for p in loaded]) for k in range(4))
        twice = repeated(b" ".join(p[4] for p in loaded), size, multi, window)
        n_windows = size.astype(np.int64) - window + 1
        of = np.repeat(np.arange(len(size)), n_windows)
        pick = np.flatnonzero(twice & (multi[of] == 0))  # the copies of a marked string are settled
        if not len(pick):
            return
        start = first[of[pick]].astype(np.int64) + pick - np.concatenate([[0], np.cumsum(n_windows)])[:-1][of[pick]]
        halves = np.frombuffer(keys[of[pick]].tobytes(), np.uint64).reshape(-1, 2)
        _, code = np.unique(halves, axis=0, return_inverse=True)
        code = code.ravel()
        order = np.argsort(code, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1, [len(order)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            i = order[a:b]
            yield keys[of[pick[i[0]]]].tobytes(), _merged(start[i], start[i] + window).tobytes()

    def rows(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        part = [int.from_bytes(k[:8], "little") % parts for k, _ in found]
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([0] * len(found), pa.int32()), pa.array([k + v for k, v in found], pa.binary())], names=["part", "kind", "payload"])

    def folded(loaded: list[tuple]) -> tuple[tuple, list[tuple[bytes, bytes]]]:
        """Equal strings as one, marked as repeated, and the ranges of the others."""
        keys, first, size, multi = (np.concatenate([p[k] for p in loaded]) for k in range(4))
        text = b" ".join(p[4] for p in loaded)
        start, end = word_bounds(text)
        edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        strings = [text[a:b] for a, b in zip(start[edge[:-1]].tolist(), end[edge[1:] - 1].tolist(), strict=True)]
        where: dict[bytes, int] = {}
        leader = np.fromiter((where.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
        again = np.bincount(leader, minlength=len(strings)) > 1
        kept = leader == np.arange(len(leader))
        # A marked string has its own range settled where it was marked; one marked here and now has not.
        done = again[leader] & (multi == 0)
        ranges = [(keys[i].tobytes(), np.array([first[i], first[i] + size[i]], np.int32).tobytes()) for i in np.flatnonzero(done).tolist()]
        marked = np.maximum(multi, again)
        np.maximum.at(marked, leader, multi)
        return (keys[kept], first[kept], size[kept], marked[kept].astype(np.uint8), b" ".join(strings[i] for i in np.flatnonzero(kept).tolist())), ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, settled, held, limit = None, [], [], 0, HELD_BYTES
        for batch in batches:
            for b, done, key, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                if b.as_py() != bucket:
                    if found := list(settle(blobs)) if blobs else []:
                        yield rows(found)
                    bucket, blobs, held, limit = b.as_py(), [], 0, HELD_BYTES
                if done.as_py():
                    settled.append((key.as_py(), payload.as_py()))
                    continue
                blobs.append(_load(payload.as_py()))
                held += len(blobs[-1][4])
                if held > limit:
                    one, ranges = folded(blobs)
                    blobs, held, settled = [one], len(one[4]), settled + ranges
                    limit = max(HELD_BYTES, 2 * held)
            if settled:
                yield rows(settled)
                settled = []
        if found := list(settle(blobs)) if blobs else []:
            yield rows(found)

    return run


def _batcher(key: str, parts: int):
    """Rows as compressed Arrow batches, one for each part that a batch of the scan has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.array([int.from_bytes(k.as_py()[:8], "little") % parts for k in batch.column(batch.schema.get_field_index(key))])
            order = np.argsort(part, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]])
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(batch.take(pa.array(order[a:b])))
                out.append((int(part[order[a]]), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([1] * len(out), pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["part", "kind", "payload"])

    return run


def _remover(names: list[str], key: str, kept: str, n_words: str, n_removed: str):
    """Rows of a part against the ranges that came before them."""

    def one(raw: bytes | None, ranges: list[bytes]) -> tuple[bytes, int, int]:
        words = (raw or b"").split()
        if not ranges or not words:
            return b" ".join(words), len(words), 0
        depth = np.zeros(len(words) + 1, np.int64)
        pairs = np.frombuffer(b"".join(ranges), np.int32).reshape(-1, 2)
        np.add.at(depth, pairs[:, 0], 1)
        np.add.at(depth, pairs[:, 1], -1)
        left = [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not d]
        return b" ".join(left), len(words), len(words) - len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranges = None, {}
        for batch in batches:
            for p, kind, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                if p.as_py() != part:
                    part, ranges = p.as_py(), {}
                value = payload.as_py()
                if not kind.as_py():
                    ranges.setdefault(value[:16], set()).add(value[16:])
                    continue
                for rows in pa.ipc.open_stream(value):
                    at = rows.schema.get_field_index
                    found = [one(t.as_py(), list(ranges.get(k.as_py(), ()))) for t, k in zip(rows.column(at("text")).cast(pa.binary()), rows.column(at(key)), strict=True)]
                    text, total, gone = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(at(c)) for c in names), pa.array(text, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                        names=[*names, kept, n_words, n_removed],
                    )

    return run


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with kept_text (kept words joined by a space), n_words and n_removed."""
    spark = docs.sparkSession
    gram = min(gram, window)
    kept, n_words, n_removed = (fresh(docs, n) for n in ("kept_text", "n_words", "n_removed"))
    key = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.where(F.length("text") > 0).select(key.alias("key"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(12, -(-size * 4 // bucket_bytes))
    share = max(1 / (4 * buckets), 1 / HEAVY)
    survey = map_arrow(rows, _survey(window, gram, share), "gram long, n long, total long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    survey = materialise(survey, "frequent-grams")
    total = survey.where("gram is null").head()
    floor = 2 * share * (total["total"] if total else 0)
    heavy = np.array(sorted(r[0] % (1 << 64) for r in survey.where(F.col("gram").isNotNull() & (F.col("n") >= floor) & (F.col("n") > 64)).select("gram").toLocalIterator()), np.uint64)
    sent = map_arrow(rows, _sender(window, gram, buckets, spark.sparkContext.broadcast(heavy.tobytes())), _SENT)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks, parts = max(least, buckets // 4), max(least, -(-size // PART_BYTES))
    found = map_arrow(
        sent.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket"), _counter(window, parts), _MEET
    )
    names, own = docs.columns, fresh(docs, "_key")
    batches = map_arrow(docs.withColumn(own, key), _batcher(own, parts), _MEET)
    met = found.unionByName(batches).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    schema = T.StructType([*docs.schema.fields, T.StructField(kept, T.StringType()), T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])
    return map_arrow(met, _remover(names, own, kept, n_words, n_removed), schema)
