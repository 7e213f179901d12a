"""MinHash near-deduplication by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive normalised words (A-Z lower-cased, words as in the decontamination).
Its weight in a document is ``(1 + ln tf) * (1 + strength * idf)``: the idf, ``ln(1 + N / df)`` divided by its
largest value, damps common passages; ``strength`` is small, so that a large group of copies, whose own
passages are common for that reason, keeps its similarity near the plain one. Document frequencies of all
documents are counted in a hashed table of fixed size, which is what is broadcast.

Improved consistent weighted sampling draws (shingle, level) pairs, two documents agreeing in one with the
probability of their weighted Jaccard similarity. Samples are banded. In each band's bucket, members meet
one another in order of their digest: a member is compared by signature with the bucket's leaders, gives at most ``links``
candidate pairs, and becomes a leader unless it is very close to one, so pairs stay linear in the
rows. What this first pass leaves is then settled: in every bucket that still holds several classes, each member is
compared with all members of other classes, and every candidate pair whose ends are still apart is verified inside the
bucket, which gives off only the links that join classes. There a second estimate, over 256 ranges of hashes, rules out pairs well below the
threshold, so that a family of texts around one shared passage gives no pairs. A bucket above ``large`` members is replaced by its intersections with the other bands in the first pass only.
To settle, a bucket of more than two blocks of text is cut into blocks of ``block_bytes``, and each block is compared with each
other one, in a task's turn of its own, unless both hold one and the same class; so a task holds the shingles of two blocks at most,
whatever the bucket. Candidates are verified by the exact weighted Jaccard similarity
of the whole texts, at first the best of each text, then those whose ends are still in different classes. Classes are
connected components of verified links, found by hooking to the least neighbour and contracting, and in one task once
``JOINED_EDGES`` edges or fewer are left.

Equal texts form one node from the start: only one representative of a text goes into bands, whatever the number of copies.

Defined cases: a null text is a class of its own row; a text without a word only equals itself; fewer than
five words are one shingle; the class id is the least doc_id of the class (null if it has none); repeated
rows are copies of each other; a very long text is sketched and compared whole, and is a block by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._common import fresh, map_arrow, materialise, row_key
from factloom.llm.decontaminate import words
from factloom.llm.substring_dedup import _mix, gram_hashes, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 9, 3
STRENGTH = 0.2
TABLE = 1 << 20
CHUNK_BYTES = 1 << 20
#: Text of a block of a bucket; a member counts as ``MEMBER_BYTES`` at least, which bounds the members of a block.
BLOCK_BYTES, MEMBER_BYTES = 8 << 20, 800
#: Weighted sets that are kept for the next pairs, in bytes, and sketches that are kept for copies.
KEPT_BYTES, KEPT_SKETCHES = 16 << 20, 5_000
BROADCAST_ROWS = 500_000
#: Edges that one task joins; more are contracted by rounds first.
JOINED_EDGES = 500_000
PROFILE = 256
#: Below the similarity by what weights (a factor of 1.2 in the odds) and three deviations of a profile's estimate can make up.
PROFILE_SLACK = 0.11


def shingles(texts: list[bytes | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles of texts, by document."""
    norm, counts = [], []
    for t in texts:
        w = words(t)
        norm.append(b" ".join(w))
        counts.append(len(w))
    have = [i for i, c in enumerate(counts) if c]
    if not have:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = b" ".join(norm[i] for i in have)
    h = word_hashes(text, *word_bounds(text))
    size = np.array([counts[i] for i in have])
    edge = np.concatenate([[0], np.cumsum(size)])
    long = np.maximum(size - n + 1, 1)
    doc = np.repeat(np.arange(len(have)), long)
    at = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(long)[:-1]]), long) + edge[doc]
    g = np.zeros(len(doc), np.uint64)
    full = size[doc] >= n
    grams = gram_hashes(h, n)
    g[full] = grams[at[full]]
    for k in np.flatnonzero(size < n):
        x = gram_hashes(h[edge[k] : edge[k + 1]], int(size[k]))
        g[np.flatnonzero(doc == k)] = _mix(x + np.uint64(size[k]))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return np.array(have)[doc[first]], g[first], np.diff(np.concatenate([first, [len(g)]]))


def weights(h: np.ndarray, tf: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * table[(h & np.uint64(len(table) - 1)).astype(np.int64)]


def idf_table(df: np.ndarray, n: int, strength: float) -> np.ndarray:
    """1 + strength x idf for each entry of the hashed table, with an idf of 1 for what stands in no document."""
    return 1 + strength * np.log1p(n / np.maximum(df, 1)) / np.log1p(max(n, 1))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted (hash, weight) sets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    low = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.float32(2.0**-24)
    return ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * scale, ((x & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale


def samples(doc: np.ndarray, h: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """``k`` consistent weighted samples of each document (documents in order, each with a shingle): documents x k hashes."""
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([cut, [len(doc)]]))
    log_w = np.log(w).astype(np.float32)
    out = np.zeros((len(cut), k), np.uint64)
    for i in range(k):
        seed = np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64))
        x = _mix(h ^ seed)
        u1, u2 = _uniform(x)
        y = x * np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(32)
        u3, u4 = _uniform(y * np.uint64(0xD6E8FEB86659FD93))
        beta, _ = _uniform((y ^ seed) * np.uint64(0xC2B2AE3D27D4EB4F))
        r = -np.log(u1 * u2)
        t = np.floor(log_w / r + beta)
        cost = np.log(-np.log(u3 * u4)) - r * (t - beta) - r
        least = np.minimum.reduceat(cost, cut)
        hit = np.flatnonzero(cost == np.repeat(least, size))
        pick = hit[np.searchsorted(hit, cut)]
        out[:, i] = _mix(h[pick] + _mix(t[pick].astype(np.int64).astype(np.uint64) + seed))
    return out


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    return np.stack([gram_hashes(np.ascontiguousarray(s[i, b * rows : (b + 1) * rows]) + np.uint64(b), rows)[0] for i in range(len(s)) for b in range(bands)]).reshape(len(s), bands) if len(s) else np.zeros((0, bands), np.uint64)


def profiles(doc: np.ndarray, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """A ``PROFILE``-byte profile of each document (documents in order, hashes sorted within): the least hash of each range of
    hashes as a byte from 1 (0: none). A document that repeats more than a fiftieth of its shingles has an empty profile, since
    repetition parts the plain similarity from the weighted one.
    """
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    at = np.cumsum(new) - 1
    out = np.zeros((int(at[-1]) + 1, PROFILE), np.uint8)
    part = (h >> np.uint64(64 - PROFILE.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(new | np.concatenate([[True], part[1:] != part[:-1]]))
    out[at[first], part[first]] = _mix(h[first]) % np.uint64(255) + np.uint64(1)
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(doc)]]))
    out[np.bincount(at, tf > 1) * 50 > size] = 0
    return out


def may_agree(profile: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which of ``others`` have an estimated plain similarity of at least ``least``, or no profile to tell by."""
    either = ((others != 0) | (profile != 0)).sum(1)
    same = ((others == profile) & (profile != 0)).sum(1)
    return (same >= least * either) | ~others.any(1) | ~profile.any()


def _text_chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes | None]]]:
    held, start, texts = 0, 0, []
    for i, t in enumerate(batch.column(column).cast(pa.binary())):
        t = t.as_py()
        texts.append(t)
        held += len(t or b"")
        if held >= CHUNK_BYTES:
            yield start, texts
            held, start, texts = 0, i + 1, []
    if texts:
        yield start, texts


def frequencies(docs: DataFrame, table: int = TABLE) -> tuple[np.ndarray, int]:
    """Hashed document frequencies of shingles over all documents, and the number of documents."""
    part = min(table, 1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(table, np.int64), 0
        for batch in batches:
            for _, texts in _text_chunks(batch, 0):
                _, h, _ = shingles(texts)
                df += np.bincount((h & np.uint64(table - 1)).astype(np.int64), minlength=table)
                n += len(texts)
        if n:
            pieces = [df[a : a + part].astype(np.int32).tobytes() for a in range(0, table, part)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], names=["piece", "n", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for p, m, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                p = p.as_py()
                total[p] = total.get(p, 0) + np.frombuffer(raw.as_py(), np.int32).astype(np.int64)
                n[p] = n.get(p, 0) + m.as_py()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n[p] for p in total], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "n", "df"])

    schema = "piece int, n long, df binary"
    pieces = map_arrow(map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, schema).repartition(16, "piece"), add, schema)
    df, n = np.zeros(table, np.int64), 0
    for r in pieces.coalesce(16).toLocalIterator():  # table / part rows, whatever the input, and a job for each partition
        df[r["piece"] * part : (r["piece"] + 1) * part] = np.frombuffer(r["df"], np.int64)
        n = r["n"]
    return df, n


def _sketch(table, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            node, size = batch.column(0).to_pylist(), [max(MEMBER_BYTES, len(t.as_py() or b"")) for t in batch.column(2).cast(pa.binary())]
            out: list[tuple] = [(None, None)] * batch.num_rows
            for start, texts in _text_chunks(batch, 2):
                if len(known) > KEPT_SKETCHES:
                    known.clear()  # before it is seen which texts of the chunk are new
                fresh_ones = [i for i in range(len(texts)) if node[start + i] is not None and node[start + i] not in known]
                fresh_ones = list({node[start + i]: i for i in fresh_ones}.values())
                doc, h, tf = shingles([texts[i] for i in fresh_ones])
                if len(doc):
                    s = samples(doc, h, weights(h, tf, table.value), bands * rows)
                    keys, profile = band_keys(s, bands, rows).astype(np.int64), profiles(doc, h, tf)
                    for j, d in enumerate(doc[np.concatenate([[True], doc[1:] != doc[:-1]])].tolist()):
                        known[node[start + fresh_ones[d]]] = (keys[j].tolist(), s[j].astype(np.uint32).tobytes() + profile[j].tobytes())
                for i in range(len(texts)):
                    out[start + i] = known.get(node[start + i], (None, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.binary()), pa.array(size, pa.int64())], names=["node", "doc_id", "bands", "signature", "bytes"]
            )

    return run


def _pairs(least: float, close: float, links: int):
    """Candidate pairs of each bucket; rows come sorted by bucket and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, marks, n = None, [], None, 0
        for batch in batches:
            out = []
            for b, node, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                b, node, sign = b.as_py(), node.as_py(), np.frombuffer(raw.as_py()[:-PROFILE], np.uint32)
                if b != bucket:
                    bucket, nodes, n = b, [node], 1
                    marks = np.zeros((4, len(sign)), np.uint32)
                    marks[0] = sign
                    continue
                alike = (marks[:n] == sign).mean(1)
                best = np.argsort(-alike, kind="stable")[:links]
                out += [(nodes[i], node, float(alike[i])) for i in best.tolist() if alike[i] >= least and nodes[i] != node]
                if alike.max() < close:
                    if n == len(marks):
                        marks = np.concatenate([marks, np.zeros_like(marks)])
                    marks[n] = sign
                    nodes.append(node)
                    n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.float64())], names=["a", "b", "alike"])

    return run


class _Bucket:
    """The members of one bucket so far, in order of their first class."""

    def __init__(self, width: int) -> None:
        self.nodes, self.firsts, self.n, self.start = [], [], 0, 0
        self.marks, self.shapes = np.zeros((4, width), np.uint32), np.zeros((4, PROFILE), np.uint8)

    def add(self, first: bytes, node: bytes, sign: np.ndarray, shape: np.ndarray, least: float, plain: float) -> np.ndarray:
        """The members of earlier classes that the node may be alike, the likest first; the node then joins."""
        if self.n and first != self.firsts[-1]:
            self.start = self.n
        alike = (self.marks[: self.start] == sign).mean(1)
        able = np.flatnonzero(alike >= least)
        able = able[may_agree(shape, self.shapes[able], plain)]
        able = able[np.argsort(-alike[able], kind="stable")]
        if self.n == len(self.marks):
            self.marks, self.shapes = np.concatenate([self.marks, np.zeros_like(self.marks)]), np.concatenate([self.shapes, np.zeros_like(self.shapes)])
        self.marks[self.n], self.shapes[self.n] = sign, shape
        self.nodes.append(node)
        self.firsts.append(first)
        self.n += 1
        return able


def _members(batch: pa.RecordBatch) -> Iterator[tuple]:
    for b, first, node, raw in zip(*(batch.column(k) for k in range(4)), strict=True):
        raw = raw.as_py()
        yield b.as_py(), first.as_py(), node.as_py(), np.frombuffer(raw[:-PROFILE], np.uint32), np.frombuffer(raw[-PROFILE:], np.uint8)


def _undecided(least: float, plain: float):
    """The members of each bucket, once each, that may be alike a member of another class; rows come sorted by bucket, class and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own, flagged = None, None, set()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket] * len(flagged), pa.int64()), pa.array([own.nodes[i] for i in sorted(flagged)], pa.binary())], names=["bucket", "node"])

        for batch in batches:
            for b, first, node, sign, shape in _members(batch):
                if b != bucket:
                    if flagged:
                        yield rows()
                    bucket, own, flagged = b, _Bucket(len(sign)), set()
                able = own.add(first, node, sign, shape, least, plain)
                if len(able):
                    flagged.add(own.n - 1)
                    flagged.update(able.tolist())
        if flagged:
            yield rows()

    return run


def _settle(table, similarity_least: float, least: float, plain: float):
    """Links that join classes inside each bucket: every candidate pair whose ends are still apart is verified, and a link joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own, sets, parent = None, None, [], {}

        def find(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            out = []
            for (b, first, node, sign, shape), text in zip(_members(batch), batch.column(4).cast(pa.binary()), strict=True):
                if b != bucket:
                    bucket, own, sets, parent = b, _Bucket(len(sign)), [], {}
                _, h, tf = shingles([text.as_py()])
                sets.append((h, weights(h, tf, table.value)))
                parent.setdefault(first, first)
                for i in own.add(first, node, sign, shape, least, plain).tolist():
                    x, y = find(own.firsts[i]), find(first)
                    if x != y and (s := similarity(sets[i], sets[-1])) >= similarity_least:
                        parent[y] = x
                        out.append((own.nodes[i], node, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.float64())], names=["a", "b", "similarity"])

    return run


def bucketed(reps: DataFrame, large: int) -> DataFrame:
    """(bucket, node, signature): each node in each of its buckets, with a bucket above ``large`` parted by the other bands."""
    rows = reps.where(F.col("bands").isNotNull()).select("node", "signature", "bands", F.posexplode("bands").alias("band", "bucket"))
    hot = materialise(rows.groupBy("bucket").count().where(F.col("count") > large).select("bucket"), "hot-buckets")
    if hot.isEmpty():
        return rows.select("bucket", "node", "signature")
    both = rows.join(hot, "bucket", "left_semi").select(
        F.explode(F.transform("bands", lambda other: F.when(other != F.col("bucket"), F.xxhash64(F.least(other, F.col("bucket")), F.greatest(other, F.col("bucket")))))).alias("bucket"), "node", "signature"
    )
    cool = rows.join(hot, "bucket", "left_anti").select("bucket", "node", "signature")
    return cool.unionByName(both.where(F.col("bucket").isNotNull()))


def blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(bucket, first, node, signature), a bucket of more than two blocks by two blocks at a time, so that any two members of different classes meet.

    ``rows`` also has ``bytes``. A block has about ``block_bytes``: a part of one class, or several small classes whole.
    """
    sizes = rows.groupBy("bucket", "first").agg(F.sum("bytes").alias("_n"))
    hot = materialise(sizes.groupBy("bucket").agg(F.sum("_n").alias("_all")).where(F.col("_all") > 2 * block_bytes).select("bucket"), "hot-buckets")
    if hot.isEmpty():
        return rows.select("bucket", "first", "node", "signature")
    sizes = sizes.join(hot, "bucket", "left_semi")
    small = sizes.where(F.col("_n") < block_bytes).groupBy("bucket").agg(F.ceil(F.sum("_n") / block_bytes).alias("_small"))
    alone = F.when(F.col("_n") >= block_bytes, F.col("first"))
    part = F.when(F.col("_n") >= block_bytes, F.xxhash64("first", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / block_bytes)))).otherwise(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("first"), F.col("_small"))))
    placed = rows.join(sizes.join(small, "bucket", "left"), ["bucket", "first"]).select("bucket", "first", "node", "signature", part.alias("_block"), alone.alias("_alone"))
    placed = materialise(placed, "hot-blocks")
    one = placed.select("bucket", F.col("_block").alias("_a"), F.col("_alone").alias("_x")).distinct()
    two = one.select("bucket", F.col("_a").alias("_b"), F.col("_x").alias("_y"))
    pairs = one.join(two, "bucket").where((F.col("_a") <= F.col("_b")) & ~F.coalesce(F.col("_x") == F.col("_y"), F.lit(False)))
    pairs = pairs.select("bucket", F.xxhash64("bucket", "_a", "_b").alias("_pair"), F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_block"))
    cut = placed.join(pairs, ["bucket", "_block"]).select(F.col("_pair").alias("bucket"), "first", "node", "signature")
    return rows.join(hot, "bucket", "left_anti").select("bucket", "first", "node", "signature").unionByName(cut)


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def candidates(flat: DataFrame, tasks: int, least: float, close: float, links: int) -> DataFrame:
    """Distinct pairs (a, b, alike) of nodes that share a bucket."""
    found = map_arrow(flat.repartition(tasks, "bucket").sortWithinPartitions("bucket", "node"), _pairs(least, close, links), "a binary, b binary, alike double")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("alike").alias("alike"))


def settled(reps: DataFrame, block_bytes: int, tasks: int, links: DataFrame, roots: DataFrame, docs: DataFrame, table, similarity_least: float, least: float) -> tuple[DataFrame, DataFrame]:
    """(links, roots) once no bucket holds an unverified candidate pair across classes.

    Pairs are verified where their bucket is, so that what leaves a bucket is at most one link fewer than its classes.
    """
    plain = similarity_least - PROFILE_SLACK
    own = reps.where(F.col("bands").isNotNull()).join(roots.select("node", F.col("root").alias("first")), "node", "left")
    own = own.select(F.explode("bands").alias("bucket"), F.coalesce("first", "node").alias("first"), "node", "signature", "bytes")
    several = own.groupBy("bucket").agg(F.min("first").alias("_a"), F.max("first").alias("_b")).where(F.col("_a") != F.col("_b")).select("bucket")
    rows = materialise(own.join(several, "bucket", "left_semi"), "several-classes")
    rows, order = blocks(rows, block_bytes), ("bucket", "first", "node")
    open_ones = materialise(map_arrow(rows.repartition(tasks, "bucket").sortWithinPartitions(*order), _undecided(least, plain), "bucket long, node binary"), "undecided")
    if open_ones.isEmpty():
        return links, roots
    rows = rows.join(open_ones, ["bucket", "node"], "left_semi").join(_texts(docs, open_ones.select("node").distinct()), "node").select(*order, "signature", "text")
    more = map_arrow(rows.repartition(tasks, "bucket").sortWithinPartitions(*order), _settle(table, similarity_least, least, plain), "a binary, b binary, similarity double")
    more = materialise(more.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity")), "links")
    links = links.unionByName(more)
    return links, components(links)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes. A bounded set of digests is broadcast; a larger one is joined by a shuffle."""
    nodes = materialise(nodes, "ends")
    texts = docs.select(_node(docs).alias("node"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, "node", "left_semi")
    return texts.groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, table, least: float) -> DataFrame:
    """The pairs whose texts have a weighted Jaccard similarity of at least ``least``."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(docs, ends)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("_tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def weighted(key: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if key not in kept:
                if held > KEPT_BYTES:
                    kept.clear()
                    held = 0
                _, h, tf = shingles([text])
                kept[key] = (h, weights(h, tf, table.value))
                held += 16 * len(h)
            return kept[key]

        for batch in batches:
            found = [similarity(weighted(a.as_py(), x.as_py()), weighted(b.as_py(), y.as_py())) for a, b, x, y in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return map_arrow(both.select("a", "b", "_ta", "_tb"), run, "a binary, b binary, similarity double").where(F.col("similarity") >= least)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for every end of the edges of one task, the root being the least node of the component."""
    columns = [[], []]
    for batch in batches:
        for k in range(2):
            columns[k].append(batch.column(k).cast(pa.binary()))
    ends = pa.concat_arrays([*columns[0], *columns[1], pa.array([], pa.binary())]).dictionary_encode()
    order = pc.array_sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    a, b = rank[ends.indices.to_numpy()].reshape(2, -1).tolist()
    parent = list(range(len(order)))
    for x, y in zip(a, b, strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # a parent is never above its node
        parent[x] = parent[parent[x]]
    nodes = ends.dictionary.take(pa.array(order))
    for at in range(0, len(order), 1 << 15):
        yield pa.RecordBatch.from_arrays([nodes[at : at + (1 << 15)], nodes.take(pa.array(parent[at : at + (1 << 15)], pa.int64()))], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every end of an edge: hook each node to its least neighbour, contract, repeat until one task can join the rest.

    A round is a dozen of small jobs, which all pass through the driver.
    """
    edges = materialise(edges.select("a", "b"), "edges")
    labels = None
    for _ in range(rounds):
        n = edges.count()
        if n and n <= JOINED_EDGES:
            last = map_arrow(edges.coalesce(1), _join, "node binary, root binary")
            if labels is not None:
                last = labels.join(last.select(F.col("node").alias("root"), F.col("root").alias("_m")), "root", "left").select("node", F.coalesce("_m", "root").alias("root"))
            return materialise(last, "labels")
        if not n:
            break
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "hooks")
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            step = hook.select(F.col("a").alias("root"), F.col("m").alias("_m"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("_m", "root").alias("root"))
        labels = materialise(labels, "labels")
        to_a, to_b = hook.select("a", F.col("m").alias("_a")), hook.select(F.col("a").alias("b"), F.col("m").alias("_b"))
        edges = edges.join(to_a, "a").join(to_b, "b").where(F.col("_a") != F.col("_b"))
        edges = materialise(edges.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _node(docs: DataFrame):
    return F.when(F.col("text").isNotNull(), row_key(F.lit("text"), F.col("text").cast("string")))


def near_duplicates(docs: DataFrame, similarity_least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, strength: float = STRENGTH, large: int = 20_000, close: float = 0.9, links: int = 3, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, node, class_node, class_id, n_links; the verified links: a, b, similarity by node)."""
    spark = docs.sparkSession
    df, n = frequencies(docs)
    table = spark.sparkContext.broadcast(idf_table(df, n, strength))
    keyed = docs.select(_node(docs).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialise(map_arrow(keyed, _sketch(table, bands, rows), "node binary, doc_id long, bands array<long>, signature binary, bytes long"), "sketch")
    reps = sketch.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("bands", "signature", "bytes")).alias("_s")).select("node", "doc_id", "_s.*")
    # A pair of similarity s agrees in s of the samples; 0.25 below is beyond three deviations.
    least = similarity_least - 0.25
    tasks = _tasks(reps)
    pairs = materialise(candidates(bucketed(reps, large), tasks, least, close, links), "pairs")
    best = pairs.groupBy("b").agg(F.max(F.struct("alike", "a")).alias("_x")).select(F.col("_x.a").alias("a"), "b")
    edges = materialise(verified(best, docs, table, similarity_least), "links")
    roots = components(edges)
    left = pairs.join(best, ["a", "b"], "left_anti")
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    left = left.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")
    more = materialise(verified(materialise(left, "pairs-left"), docs, table, similarity_least), "links")
    links_found = edges.unionByName(more)
    links_found, roots = settled(reps, block_bytes, tasks, links_found, components(links_found), docs, table, similarity_least, least)
    degree = links_found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = reps.select("node", "doc_id").join(roots, "node", "left").join(degree, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("class_node"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = classes.groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
    classes = materialise(classes.join(ids, "class_node").select("node", "class_node", "class_id", "n_links"), "classes")
    members = sketch.select("doc_id", "node").join(classes, "node", "left").select(
        "doc_id", "node", "class_node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return members, links_found


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class (the one with the least doc_id; all of null text stay), with its own columns."""
    members, _ = near_duplicates(docs, **options)
    members = materialise(members.where(F.col("node").isNotNull()).select("doc_id", "node", "class_node"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    kept = members.groupBy("class_node").agg(F.min(order).alias("_k")).select(F.col("_k.node").alias("_node"), F.col("_k.doc_id").alias("_doc"))
    gone = members.select(F.col("node").alias("_node"), F.col("doc_id").alias("_doc")).groupBy("_node", "_doc").agg(F.count(F.lit(1)).alias("_n"))
    kept = kept.withColumn("_kept", F.lit(True))
    state = gone.join(kept, (gone["_node"] == kept["_node"]) & gone["_doc"].eqNullSafe(kept["_doc"]), "left").select(gone["_node"], gone["_doc"], "_n", "_kept")
    # Rows to leave, and rows that stand several times with one doc_id and text.
    state = materialise(state.where(F.col("_kept").isNull() | (F.col("_n") > 1)).select(row_key(F.hex("_node"), F.col("_doc")).alias("_key"), F.coalesce("_kept", F.lit(False)).alias("_kept")), "state")
    key, flag = fresh(docs, "_key"), fresh(docs, "_kept")
    state = state.select(F.col("_key").alias(key), F.col("_kept").alias(flag))
    state = F.broadcast(state) if state.count() <= BROADCAST_ROWS else state
    rows = docs.withColumn(key, F.when(F.col("text").isNotNull(), row_key(F.hex(_node(docs)), F.col("doc_id").cast("long"))))
    rows = rows.join(state, key, "left")
    once = rows.where(F.col(flag).isNull()).select(*docs.columns)
    return once.unionByName(rows.where(F.col(flag)).dropDuplicates([key]).select(*docs.columns))
