"""Benchmark decontamination with one Aho-Corasick automaton.

Normalisation: A-Z are lower-cased, words are runs of ``[0-9a-z]`` and characters beyond
ASCII, and one space stands between words. A pattern is a window of ``window`` consecutive
words of a benchmark item with a space at either end, so that it only matches whole words; an
item with fewer words is one pattern. All patterns form one automaton, which reads each
normalised text once. Matches are carried back to word numbers and to code-point offsets of the
original text.

The benchmark is the stated query set. Its windows are streamed to the driver and broadcast
in blocks of at most ``block_bytes``; a benchmark of one block (the usual case) is one scan, a
larger one a chain of scans in the same task, one automaton each, so no broadcast grows beyond
the block size. The documents are never shuffled, and only their text goes to Python, a few megabytes at a time.

Defined cases: a null or empty text has no words and no hits; a benchmark item whose text is
null or has no word has no window; an item whose id is null marks words, but is not listed; an item
id that stands on several rows counts once; repeated documents are separate rows; an empty
benchmark leaves every document clean; a text of any length is scanned whole; other columns pass through
unread.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._common import arrow_column, fresh

WINDOW = 10
BLOCK_BYTES = 4 << 20

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_HITS = T.ArrayType(
    T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("item", T.StringType())])
)
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", _HITS),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def words(text: str | bytes | None) -> list[bytes]:
    """The normalised words, as UTF-8."""
    if not text:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_TABLE).split()


def windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The patterns of one item."""
    w = words(text)
    n = min(len(w), window)
    return [b" " + b" ".join(w[i : i + n]) + b" " for i in range(len(w) - n + 1)] if n else []


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    block: dict[bytes, list[str]] = {}
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        for p in windows(r["t"], window):
            ids = block.get(p)
            if ids is None:
                ids = block[p] = []
                size += len(p)
            if r["i"] is not None and r["i"] not in ids:
                ids.append(r["i"])
        if size > block_bytes:
            yield block
            block, size = {}, 0
    yield block


_built: dict[str, object] = {}


def automaton(block: dict[bytes, list[str]], key: str | None = None):
    """The automaton of a block, kept for the life of the worker under a key that no other block has."""
    import ahocorasick

    if key is not None and key in _built:
        return _built[key]
    found = ahocorasick.Automaton()
    for p, ids in block.items():
        found.add_word(p.decode("latin-1"), (len(p), tuple(ids)))
    if block:
        found.make_automaton()
    if key is not None:
        if len(_built) >= 4:
            _built.pop(next(iter(_built)))
        _built[key] = found
    return found


def scan(text: bytes | None, auto) -> tuple[int, list[tuple[int, int, str | None]]]:
    """The number of words, and (first word, last word, item) of each match."""
    w = words(text)
    if not w or not len(auto):
        return len(w), []
    norm = b" " + b" ".join(w) + b" "
    raw = [(end - size + 1, end, ids) for end, (size, ids) in auto.iter(norm.decode("latin-1"))]
    if not raw:
        return len(w), []
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    first = np.searchsorted(gaps, [r[0] for r in raw])
    last = np.searchsorted(gaps, [r[1] for r in raw]) - 1
    return len(w), [(int(a), int(b), i) for a, b, r in zip(first, last, raw, strict=True) for i in (r[2] or (None,))]


def resolve(text: bytes, hits: list[tuple[int, int, str | None]]) -> tuple[int, list[str], list[tuple[int, int]]]:
    """Words hit, the sorted item ids, and merged spans in code points of the original."""
    if not hits:
        return 0, [], []
    flat = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    code = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    n, spans, reach = 0, [], -1
    for a, b in sorted({(h[0], h[1]) for h in hits}):
        if a > reach:
            spans.append([a, b])
            n += b - a + 1
        elif b > reach:
            spans[-1][1] = b
            n += b - reach
        reach = max(reach, b)
    return n, sorted({h[2] for h in hits if h[2] is not None}), [(int(code[starts[a]]), int(code[ends[b]])) for a, b in spans]


def find(docs: DataFrame, benchmark: DataFrame, out: str = "found", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (all its columns, with ``text``) and a struct column ``out``: n_words, hits (by word), n_hit, item_ids, spans.

    A column that is already named ``out`` raises ValueError.
    """
    if out in docs.columns:
        raise ValueError(f"documents already have a column {out}")
    acc, df = fresh(docs, "_hits"), docs
    text, before = F.col("text").cast("string"), F.lit(None).cast(_HITS)
    for block, final in _with_last(_blocks(benchmark, window, block_bytes)):
        df = df.withColumn(out if final else acc, arrow_column(docs.sparkSession, _scanner(_sent(docs.sparkSession, block), final), _FOUND if final else _HITS, text, before))
        before = F.col(acc)
    return df.drop(acc)


def _with_last(blocks: Iterator[dict]) -> Iterator[tuple[dict, bool]]:
    held = next(blocks)
    for block in blocks:
        yield held, False
        held = block
    yield held, True


def _sent(spark: SparkSession, block: dict[bytes, list[str]]):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def _scanner(block, final: bool):
    """Hits of one block added to those before; with the last block, what they come to."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_FOUND if final else _HITS)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        key, patterns = block.value
        auto = automaton(patterns, key)
        for texts, before in batches:
            out = []
            for t, old in zip(texts.cast(pa.binary()), before, strict=True):
                raw = t.as_py()
                n, hits = scan(raw, auto)
                if old.is_valid:
                    hits = [(h["first"], h["last"], h["item"]) for h in old.as_py()] + hits
                rows = [{"first": a, "last": b, "item": i} for a, b, i in hits]
                if final:
                    n_hit, ids, spans = resolve(raw or b"", hits)
                    out.append({"n_words": n, "hits": rows, "n_hit": n_hit, "item_ids": ids, "spans": [{"start": a, "end": b} for a, b in spans]})
                else:
                    out.append(rows)
            yield pa.array(out, kind)

    return run


def _clean(block):
    """Whether a text has no window of the block; the scan of a text ends at its first match."""

    def run(batches: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        key, patterns = block.value
        auto = automaton(patterns, key)
        for (texts,) in batches:
            yield pa.array([not has_match(t.as_py(), auto) for t in texts.cast(pa.binary())], pa.bool_())

    return run


def has_match(text: bytes | None, auto) -> bool:
    w = words(text)
    return bool(w) and len(auto) > 0 and next(auto.iter((b" " + b" ".join(w) + b" ").decode("latin-1")), None) is not None


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, with their own columns; only the text goes through Python, and only a flag comes back."""
    spark, kept = docs.sparkSession, docs
    for block in _blocks(benchmark, window, block_bytes):
        kept = kept.where(arrow_column(spark, _clean(_sent(spark, block)), "boolean", F.col("text").cast("string")))
    return kept
