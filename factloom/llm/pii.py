"""Personal data, and the terms that give it away, with DataFrame functions only.

Base kinds (email, ip, card, phone) are found by regular expressions. Positions come from
``split``: the lengths of the pieces between the matches and of the matches, summed up in blocks, give every offset in code
points, and replacements are put together from pieces of the text, so that neither grows with the square of a long text.

Information-theoretic sanitisation. A protected entity is a base value; its terms are the words, numbers and mixed tokens (three
letters or digits or more) of the whole texts that hold it, outside base values. Over the whole corpus, counted by distinct text, a term t reveals an
entity e by ``log2(P(e | t) / P(e))`` bits, where ``P(e | t) = (texts with both + smooth x P(e)) / (texts with t + smooth)``:
few texts count as weaker evidence, but none are left out. A term is disclosing when P(e | t) is at least
``certain`` and that information, divided by its largest value ``-log2 P(e, t)``, is at least ``disclosure``. Disclosing
terms are spans of kind ``term`` wherever they stand, and are generalised like the base spans.

Counts are made per entity and term of the texts that hold entities, never between rows; the corpus is only counted for terms
that could still pass. The texts are scanned three times: for base values, for those terms, and for the result.

The patterns equal the plain ones in what they match, and never step back over a long run: a match can
only start where the run before it doesn't, or at the end of the last match.

Defined cases: a null or empty text has no spans; repeated rows and copies are one text to the counts and get
spans each; a match that fails its check is dropped without a retry; spans of different kinds may overlap; where spans start
together, the kinds stand as listed; an empty table has no terms; a very long text is taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.arrays import let, places, running
from factloom.llm._common import fresh, materialise, row_key

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SMOOTH = 1.0
CERTAIN = 0.5
DISCLOSURE = 0.8
TOKEN = r"[\p{L}\p{N}]"
CHUNK = 1024
#: Bytes of a broadcast table, keys and a fixed share a row counted in, and rows of a broadcast of hashes.
BROADCAST_BYTES = 32 << 20
BROADCAST_HASHES = 500_000
ROW_BYTES = 64

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests: a text with an address or a card number passes the first, one with a match of a kind passes that kind's own.
NUMBERS = r"[0-9](?:\.[0-9]++\.[0-9]|(?:[\x20-]?[0-9]){11})"
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}


def _valid(span: Column) -> Column:
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    part = lambda p: F.regexp_replace(p, "^0+", "")
    octets = F.forall(F.split(span["value"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.when(F.length(part(p)) <= 3, part(p)).try_cast("int"), F.lit(0)) <= 255))
    card = F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    kind = span["kind"]
    return F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True)


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _located(text: Column, pattern: Column, kind: Column) -> Column:
    """array<struct<start, end, kind, value>> of the matches."""
    return F.transform(places(text, pattern), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), kind.alias("kind"), m["value"].alias("value")))


_EMPTY = "array<struct<start:int,end:int,kind:string,value:string>>"


def _none() -> Column:
    return F.expr("array()").cast(_EMPTY)


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(PATTERNS[kind]).alias("pattern"), F.lit(HINTS[kind]).alias("hint")) for kind in KINDS])
    spans = F.transform(kinds, lambda k: F.when(F.rlike(text, k["hint"]), _located(text, k["pattern"], k["kind"])).otherwise(_none()))
    some = F.contains(text, F.lit("@")) | F.contains(text, F.lit("+")) | text.rlike(NUMBERS)
    return F.when(some, F.filter(F.flatten(spans), _valid)).otherwise(_none())


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), kind)


def in_order(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def disclosing(noted: DataFrame, holding, smooth: float, certain: float, disclosure: float) -> tuple[DataFrame, DataFrame] | None:
    """(disclosing terms: term; texts with a term that could disclose: _text, term), or None if no term could.

    ``noted``: _text (a text's key), and _entities and _terms of texts that hold entities; ``holding`` finds given terms in all texts.
    """
    near = materialise(noted.where(F.col("_entities").isNotNull()).dropDuplicates(["_text"]), "pii-near")
    own = near.select(F.explode("_entities").alias("_entity")).groupBy("_entity").agg(F.count(F.lit(1)).alias("_texts"))
    pairs = near.select("_terms", F.explode("_entities").alias("_entity")).select("_entity", F.explode("_terms").alias("_term"))
    both = pairs.groupBy("_entity", "_term").agg(F.count(F.lit(1)).alias("_both"))
    # A term stands in at least the texts where it is with any entity, so common words leave before the corpus is counted.
    least = near.select(F.explode("_terms").alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("_near"))
    total = float(noted.agg(F.count_distinct("_text").alias("n")).head()["n"] or 1)
    known = F.col("_texts") / total
    given = lambda n: (F.col("_both") + smooth * known) / (F.col(n) + smooth)
    # Both counts have one row for each term, so they are hashed, not sorted.
    both = both.join(least.hint("shuffle_hash"), "_term").where((F.col("_both") + smooth) / (F.col("_near") + smooth) >= certain)
    both = materialise(both.join(own, "_entity").where(given("_near") >= certain).drop("_near"), "pii-pairs")
    terms = materialise(both.select(F.col("_term").alias("term")).distinct(), "pii-terms")
    if terms.isEmpty():
        return None
    seen = materialise(holding(terms).select("_text", "term").distinct(), "pii-seen")
    holds = seen.groupBy(F.col("term").alias("_term")).agg(F.count(F.lit(1)).alias("_holds"))
    scored = both.join(holds.hint("shuffle_hash"), "_term")
    joint = F.least(given("_holds") * F.col("_holds") / total, F.lit(1.0 - 1e-9))
    bits = F.log2(given("_holds") / known)
    return scored.where((given("_holds") >= certain) & (bits / -F.log2(joint) >= disclosure)).select(F.col("_term").alias("term")).distinct(), seen


def _holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(_text, term) for every row of ``texts`` and each of ``terms`` in it; many terms go by a broadcast of hashes before they are joined."""
    rows = texts.where(F.col("text").isNotNull()).select("_text", F.explode(_terms(F.col("text"))).alias("term"))
    n, size = _measured(terms, F.octet_length("term"))
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(terms), "term")
    if n <= BROADCAST_HASHES:
        rows = rows.withColumn("_hash", F.xxhash64("term")).join(F.broadcast(terms.select(F.xxhash64("term").alias("_hash")).distinct()), "_hash", "left_semi").drop("_hash")
    return rows.join(terms.hint("shuffle_hash"), "term")


def _measured(df: DataFrame, payload: Column) -> tuple[int, int]:
    """Rows of ``df``, and its bytes: ``payload`` of each row and a fixed share."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(payload), F.lit(0)).alias("size")).head()
    return found["n"], found["size"] + ROW_BYTES * found["n"]


def _given(rows: DataFrame, held: DataFrame, key: str, has: str, copies: DataFrame) -> DataFrame:
    """``rows`` and the terms of their text (null: none). ``copies``: key and _n, the rows of each text.

    A small ``held`` is broadcast. Else only texts of a thousandth of all rows or more are, so that no text gathers its copies in one
    task: a thousand at most, which together are no longer than a thousand mean texts. Null texts take no part in the shuffle.
    """
    size = _measured(held, F.aggregate(has, F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + ROW_BYTES))[1]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(held), key, "left")
    total = copies.agg(F.sum("_n").alias("n")).head()["n"] or 0
    hot = materialise(copies.where(F.col("_n") * 1000 >= total).select(key).join(held, key, "left"), "pii-hot")
    known = rows.where(F.col(key).isNotNull())
    near = known.join(F.broadcast(hot), key)
    far = known.join(F.broadcast(hot.select(key)), key, "left_anti").join(held, key, "left")
    none = rows.where(F.col(key).isNull()).withColumn(has, F.lit(None).cast("array<string>"))
    return near.unionByName(far).unionByName(none)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN + "{3,}"), F.lit(0)))


def _noted(text: Column, key: Column, spans: Column) -> Column:
    """_text, _entities and _terms of a text (the last two null without entities)."""
    entities = F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    terms = _terms(_replaced(text, in_order(spans), lambda s: F.lit("\n")))
    has = F.size(spans) > 0
    return F.struct(key.alias("_text"), F.when(has, entities).alias("_entities"), F.when(has, terms).alias("_terms"))


def find(docs: DataFrame, out: str = "spans", smooth: float = SMOOTH, certain: float = CERTAIN, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` and ``out``: array<struct<start, end, kind, value>> in code points, base spans and terms.

    A column that is already named ``out`` raises ValueError.
    """
    if out in docs.columns:
        raise ValueError(f"documents already have a column {out}")
    text = F.col("text").cast("string")
    keyed = docs.select(F.when(F.col("text").isNotNull(), row_key(F.col("text"))).alias("_text"), text.alias("text"))
    spanned = keyed.select("_text", "text", base_spans(F.col("text")).alias("_spans"))
    noted = materialise(spanned.select(_noted(F.col("text"), F.col("_text"), F.col("_spans")).alias("_n")).select("_n.*"), "pii-noted")
    found = disclosing(noted, lambda terms: _holding(keyed, terms), smooth, certain, disclosure)
    if found is None:
        return docs.withColumn(out, in_order(base_spans(text)))
    key, has = fresh(docs, "_text"), fresh(docs, "_terms")
    terms, seen = found
    held = materialise(seen.join(terms, "term").groupBy(F.col("_text").alias(key)).agg(F.array_sort(F.collect_set("term")).alias(has)), "pii-held")
    if held.isEmpty():
        return docs.withColumn(out, in_order(base_spans(text)))
    copies = noted.where(F.col("_text").isNotNull()).groupBy(F.col("_text").alias(key)).agg(F.count(F.lit(1)).alias("_n"))
    rows = _given(docs.withColumn(key, F.when(F.col("text").isNotNull(), row_key(F.col("text")))), held, key, has, copies)
    # Terms hold letters and digits only, so they need no quoting.
    pattern = F.concat(F.lit(f"(?iu)(?<!{TOKEN})(?:"), F.array_join(has, "|"), F.lit(f")(?!{TOKEN})"))
    extra = F.when(F.col(has).isNotNull(), _located(text, pattern, F.lit(TERM))).otherwise(_none())
    return rows.withColumn(out, in_order(F.concat(base_spans(text), extra))).select(*docs.columns, out)


def _piece(chunks: Column, a: Column, b: Column) -> Column:
    """Code points ``a`` to ``b`` of a text cut into chunks of ``CHUNK``."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    inner = F.substring(F.get(chunks, first), a % CHUNK + 1, b - a)
    outer = F.concat(F.substring(F.get(chunks, first), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(chunks, last), F.lit(1), b - last * CHUNK))
    return F.when(b <= a, F.lit("")).when(first == last, inner).otherwise(outer)


def _replaced(text: Column, spans: Column, by) -> Column:
    """The text with each span (in order; overlapping ones as one) replaced."""
    chunked = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), spans.alias("spans"), F.length(text).alias("length"))

    def done(t):
        reach = running(F.transform(t["spans"], lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
        opening = F.filter(F.zip_with(t["spans"], reach, lambda s, r: F.struct(s.alias("span"), r.alias("reach"))), lambda x: x["span"]["start"] >= x["reach"])
        parts = F.transform(opening, lambda x: F.concat(_piece(t["chunks"], x["reach"], x["span"]["start"]), by(x["span"])))
        end = F.coalesce(F.array_max(F.transform(t["spans"], lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), _piece(t["chunks"], end, t["length"]))

    return let(chunked, done)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) generalised to its kind in angle brackets."""
    return F.when(F.size(spans) > 0, _replaced(text, spans, lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).otherwise(text)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The documents with personal data and disclosing terms generalised in ``text``."""
    out = fresh(docs, "spans")
    found = find(docs, out, **options)
    return found.withColumn("text", redacted(F.col("text"), F.col(out))).select(*docs.columns)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
