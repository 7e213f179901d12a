"""Language identification of spans in mixed-language text.

A word is a run of letters. Its script (by Unicode range of its first letter) narrows the
candidates to the languages that training saw in that script; a word has a score per candidate, the
sum of log likelihoods of its character 1- to 4-grams (hashed into a fixed table). Viterbi decoding over the
words of a document with a switching penalty labels every word; runs of one label are the spans. The document's
language is the one with the most letters, its score the share of all letters that stand in its words of a script
with candidates.

The model is fitted on at most ``per_language`` documents a language in expectation (chosen by a hash of the
text, so copies count once); that bound is the only one. Model size is 4 x ``BUCKETS`` x languages,
whatever the input. Prediction sees the text alone, whole, in one narrow pass.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no span; nothing learned
makes every text ``und``; a word of a script without candidates is no evidence and joins its neighbours' span, so a text
of nothing else has the score 0; ties go to the language first in order; repeated rows are predicted each; a very long text is
scored in pieces cut between words and decoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._common import arrow_column, fresh, map_arrow

BUCKETS = 1 << 16
ORDERS = 4
PER_LANGUAGE = 4000
PENALTY = 8.0
CHUNK_CHARS = 1 << 20
PIECE_CHARS = 1 << 18
UNKNOWN = "und"

# First and last code point of Unicode script ranges.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)

_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, its lower case, its script (0: other)."""
    if not _tables:
        n = 0x110000
        letter, lower, script = np.zeros(n, bool), np.arange(n, dtype=np.uint32), np.zeros(n, np.int16)
        for c in range(n):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                letter[c] = True
                if len(low := s.lower()) == 1:
                    lower[c] = ord(low)
        names = list(dict.fromkeys(s for s, _, _ in SCRIPTS))
        for s, a, b in SCRIPTS:
            script[a : b + 1] = names.index(s) + 1
        _tables.extend([letter, lower, script])
    return _tables[0], _tables[1], _tables[2]


@dataclass
class Words:
    """Words of a chunk of documents."""

    start: np.ndarray  # code point in the chunk
    end: np.ndarray
    script: np.ndarray
    grams: list[np.ndarray]  # for each order the buckets
    of: list[np.ndarray]  # for each order the word of each gram


def split(text: str) -> Words:
    letter, lower, script = _letters()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 0x110000, code, 0)
    is_letter = letter[code]
    edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # The words' letters with one 0 before each word and one after the last.
    n, size = len(start), end - start
    flat = np.zeros(int(size.sum()) + n + 1, np.uint64)
    word = np.repeat(np.arange(n), size)
    at = np.arange(len(word)) + word + 1
    flat[at] = lower[code[is_letter]]
    owner = np.full(len(flat), n - 1)
    owner[at] = word
    owner[at[np.concatenate([[0], np.cumsum(size)[:-1]])] - 1 if n else []] = np.arange(n)
    zero = flat == 0
    grams, of = [], []
    h = flat.copy()
    for k in range(ORDERS):
        if k:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[k:]
        m = len(flat) - k
        if m <= 0:
            grams.append(np.zeros(0, np.int64))
            of.append(np.zeros(0, np.int64))
            continue
        ok = ~zero[:m] if k == 0 else np.ones(m, bool)
        for j in range(1, k):
            ok &= ~zero[j : j + m]
        if k:
            ok &= ~(zero[:m] & zero[k:]) if k == 1 else np.ones(m, bool)
        x = h[ok]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        grams.append(((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
        of.append(owner[:m][ok])
    return Words(start, end, script[code[start]] if n else np.zeros(0, np.int16), grams, of)


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  # orders x buckets x languages
    candidates: np.ndarray  # scripts x languages

    def known(self, w: Words) -> np.ndarray:
        """Whether the script of each word has a candidate."""
        return self.candidates[w.script].any(1)

    def scores(self, w: Words) -> np.ndarray:
        """Words x languages; a language that is no candidate for the script is far below."""
        out = np.zeros((len(w.start), len(self.languages)), np.float32)
        for k in range(ORDERS):
            if len(w.of[k]):
                cut = np.flatnonzero(np.concatenate([[True], np.diff(w.of[k]) != 0]))
                out[w.of[k][cut]] += np.add.reduceat(self.log[k][w.grams[k]], cut, axis=0)
        out /= ORDERS
        allowed = self.candidates[w.script]
        some = allowed.any(1)
        out[~some] = 0
        out[some] = np.where(allowed[some], out[some], out[some] - np.float32(1e4))
        return out


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word; ``counts``: words of each document. All documents advance together, word by word."""
    n, langs = scores.shape
    label = np.zeros(n, np.int64)
    if not n or langs < 2:
        return label
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    longest = int(counts[0])
    active = np.searchsorted(-counts, -np.arange(longest), "left")  # documents with more than t words
    value = scores[first[: active[0]]]
    stay = np.ones((n, langs), bool)
    source = np.zeros(n, np.int16)
    for t in range(1, longest):
        k = active[t]
        value = value[:k]
        at = first[:k] + t
        best = value.argmax(1)
        jump = (value[np.arange(k), best] - np.float32(penalty))[:, None]
        keep = value >= jump
        stay[at], source[at] = keep, best
        value = np.where(keep, value, jump) + scores[at]
        if t + 1 < longest and active[t + 1] < k:
            done = slice(active[t + 1], k)
            label[at[done]] = value[done].argmax(1)
    last = first[: active[longest - 1]] + longest - 1
    if longest == 1:
        label[last] = value.argmax(1)
    else:
        label[last] = value[: len(last)].argmax(1)
        ones = slice(active[1], active[0])
        label[first[ones]] = scores[first[ones]].argmax(1)
    for t in range(longest - 1, 0, -1):
        at = first[: active[t]] + t
        own = label[at]
        label[at - 1] = np.where(stay[at, own], own, source[at])
    return label


def _sample_counts(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(languages)}
        grams = np.zeros((len(languages), ORDERS, BUCKETS), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                w, i = split(text.as_py()), index[lang.as_py()]
                for k in range(ORDERS):
                    grams[i, k] += np.bincount(w.grams[k], minlength=BUCKETS)
                scripts[i] += np.bincount(w.script, minlength=len(SCRIPTS) + 1)
        rows = [(i, grams[i].astype(np.int32).tobytes(), scripts[i].tobytes()) for i in range(len(languages)) if scripts[i].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "grams", "scripts"]
        )

    return run


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, smoothing: float = 0.5) -> Model:
    """A model from rows with ``text`` and ``lang`` (rows with a null in either are left out)."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().coalesce(1).toLocalIterator()}  # one row a language, and a job for each partition
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((ORDERS, BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).dropDuplicates()
    grams = np.zeros((len(languages), ORDERS, BUCKETS), np.int64)
    scripts = np.zeros((len(languages), len(SCRIPTS) + 1), np.int64)
    # Counts are some MB a language and task, so tasks stay few where a shuffle has many partitions.
    found = map_arrow(chosen.repartition(4, F.xxhash64("text")).coalesce(4), _sample_counts(languages), "lang int, grams binary, scripts binary")
    for r in found.toLocalIterator():  # at most 4 rows a language
        grams[r["lang"]] += np.frombuffer(r["grams"], np.int32).reshape(ORDERS, BUCKETS)
        scripts[r["lang"]] += np.frombuffer(r["scripts"], np.int64)
    log = np.log((grams + smoothing) / (grams.sum(2, keepdims=True) + smoothing * BUCKETS))
    share_of = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(languages, np.ascontiguousarray(log.transpose(1, 2, 0)).astype(np.float32), np.ascontiguousarray((share_of >= 0.01).T))


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
_FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", _SPAN)])


def _pieces(texts: list[str | None], limit: int) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (text number, offset, part) of about ``limit`` characters; long texts are cut between words."""
    group, held = [], 0
    for i, t in enumerate(texts):
        a = 0
        while t is not None and a < len(t):
            b = min(len(t), a + limit)
            if b < len(t):
                while b > a and t[b - 1].isalpha():
                    b -= 1
                if b == a:  # one word longer than the limit
                    b = a + limit
                    while b < len(t) and t[b].isalpha():
                        b += 1
            group.append((i, a, t[a:b]))
            held += b - a
            a = b
            if held >= limit:
                yield group
                group, held = [], 0
    if group:
        yield group


def label_texts(model: Model, texts: list[str | None], penalty: float = PENALTY) -> list[dict]:
    """lang_pred, score and spans of each text; words are scored piece by piece and decoded together."""
    out: list[dict] = [{"lang_pred": UNKNOWN, "score": 0.0, "spans": []}] * len(texts)
    if not model.languages:
        return out
    found: list[tuple[np.ndarray, ...]] = []
    for group in _pieces(texts, max(1 << 14, PIECE_CHARS * 4 // max(4, len(model.languages)))):
        begin = np.concatenate([[0], np.cumsum([len(x[2]) + 1 for x in group])])
        w = split("\n".join(x[2] for x in group))
        part = np.searchsorted(begin, w.start, "right") - 1
        shift = np.array([x[1] for x in group]) - begin[:-1]
        found.append((np.array([x[0] for x in group])[part], w.start + shift[part], w.end + shift[part], model.known(w), model.scores(w)))
    if not found:
        return out
    doc, start, end, known, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    label = viterbi(scores, np.bincount(doc, minlength=len(texts)), penalty)
    letters, evident = np.zeros((2, len(texts), len(model.languages)), np.int64)
    np.add.at(letters, (doc, label), end - start)
    np.add.at(evident, (doc[known], label[known]), (end - start)[known])
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(label) != 0)])) if len(doc) else np.zeros(0, np.int64)
    stop = np.concatenate([cut[1:], [len(doc)]]) - 1
    spans: dict[int, list[dict]] = {}
    for a, b in zip(cut.tolist(), stop.tolist(), strict=True):
        spans.setdefault(int(doc[a]), []).append({"start": int(start[a]), "end": int(end[b]), "lang": model.languages[label[a]]})
    for d, own in spans.items():
        best = int(letters[d].argmax())
        out[d] = {"lang_pred": model.languages[best], "score": float(evident[d, best] / letters[d].sum()), "spans": own}
    return out


def identify(docs: DataFrame, model: Model, out: str = "language", penalty: float = PENALTY) -> DataFrame:
    """``docs`` and a struct column ``out``: lang_pred, score, spans. A column that is already named ``out`` raises ValueError."""
    if out in docs.columns:
        raise ValueError(f"documents already have a column {out}")
    return docs.withColumn(out, _labelled(docs.sparkSession, model, penalty, _FOUND))


def _labelled(spark, model: Model, penalty: float, kind: T.StructType):
    """The fields of ``kind`` for each text."""
    from pyspark.sql.pandas.types import to_arrow_type

    sent = spark.sparkContext.broadcast(model)
    arrow, limit = to_arrow_type(kind), max(1, CHUNK_CHARS * 4 // max(4, len(model.languages)))

    def run(batches: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        for (column,) in batches:
            texts, parts, held = [], [], 0
            for t in column:
                t = t.as_py()
                texts.append(t)
                held += len(t or "")
                if held >= limit:
                    parts.append(pa.array(label_texts(sent.value, texts, penalty), arrow))
                    texts, held = [], 0
            if texts:
                parts.append(pa.array(label_texts(sent.value, texts, penalty), arrow))
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return arrow_column(spark, run, kind, F.col("text").cast("string"))


def known(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The documents with a language and a score of at least ``least``, with their own columns."""
    out = fresh(docs, "language")
    found = docs.withColumn(out, _labelled(docs.sparkSession, model, PENALTY, T.StructType(_FOUND.fields[:2])))
    return found.where((F.col(out)["lang_pred"] != UNKNOWN) & (F.col(out)["score"] >= least)).select(*docs.columns)
