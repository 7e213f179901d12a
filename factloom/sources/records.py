"""Sources: N-Triples pages, gap lists, JSON records, text stores and the truth built from them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom._ship import ship
from factloom.functions import scalars
from factloom.operators import laws, sampling

# Fixed value: the grammar of a line, fields apart by a tab, closed by a blank and a full stop.
LINE = r'^<([^>]*)>\t<([^>]*)>\t(?:<([^>]*)>|"((?:[^"\\]++|\\.)*+)"(?:\^\^<[^>]*>|@[a-z-]+)?) \.$'
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)")
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "\\": "\\"}


def unescape(literal: str) -> str:
    """Escapes decoded in one pass from left to right."""
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[0]), literal)


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unescape(t) if t is not None else None)


def triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """s, p, o_uri, o_lit of the lines that are triples; the others are left out."""
    ship(lines.sparkSession)
    part = lambda k: F.regexp_extract(column, LINE, k)
    is_uri = F.col(column).rlike(r"^<[^>]*>\t<[^>]*>\t<")
    return lines.where(F.col(column).rlike(LINE)).select(part(1).alias("s"), part(2).alias("p"), F.when(is_uri, part(3)).alias("o_uri"), F.when(~is_uri, unescaped(part(4))).alias("o_lit"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a glob."""
    return triples(spark.read.text(path))


def _looked_up(table: dict[str, str], key: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(key)]


def relation_facts(found: DataFrame, relations: dict[str, str], prefix: str, short: str) -> DataFrame:
    """Distinct s, p, o of the triples whose predicate is one of ``relations``, with shortened ends."""
    end = lambda c: scalars.shortened(F.col(c), prefix, short)
    return found.where(F.col("p").isin(*relations) & F.col("o_uri").isNotNull()).select(end("s").alias("s"), _looked_up(relations, "p").alias("p"), end("o_uri").alias("o")).distinct()


def property_values(found: DataFrame, properties: dict[str, str], prefix: str, short: str, last_segment: tuple[str, ...] = ("types",)) -> DataFrame:
    """id, property, value of the triples whose predicate is one of ``properties``: the literal, else the link (of some properties its last segment)."""
    name = _looked_up(properties, "p")
    link = F.when(name.isin(*last_segment), F.element_at(F.split("o_uri", "/"), -1)).otherwise(F.col("o_uri"))
    return found.where(F.col("p").isin(*properties)).select(scalars.shortened(F.col("s"), prefix, short).alias("id"), name.alias("property"), F.coalesce("o_lit", link).alias("value"))


def multi_valued(values: DataFrame) -> DataFrame:
    """property, n: the nodes with several different values of it."""
    several = values.groupBy("id", "property").agg(F.count_distinct("value").alias("_n"))
    return several.where(F.col("_n") > 1).groupBy("property").agg(F.count(F.lit(1)).alias("n"))


def first_seen(rows: DataFrame, properties: list[str]) -> DataFrame:
    """id and properties of every end of an edge, as the row of least ``seq`` has them (s before o); labels with ``_`` first are dropped.

    ``rows``: s, o, seq, and structs ``s_node`` and ``o_node`` of the properties.
    """
    ends = F.array(*[F.struct("seq", F.lit(k).alias("side"), F.col(e).alias("id"), *[F.col(f"{e}_node")[x].alias(x) for x in properties]) for k, e in enumerate("so")])
    first = rows.select(F.inline(ends)).groupBy("id").agg(F.min(F.struct("seq", "side", *properties)).alias("_f")).select("id", *[F.col("_f")[x].alias(x) for x in properties])
    return first.withColumn("labels", F.array_sort(F.filter("labels", lambda x: ~x.startswith("_")))) if "labels" in properties else first


def merged_titles(titles: DataFrame, other: DataFrame) -> DataFrame:
    """id, title: the other source's title where it has one that is not empty."""
    both = titles.select("id", F.col("title").alias("_a")).join(other.select("id", F.col("title").alias("_b")), "id", "full")
    return both.select("id", F.coalesce(F.when(F.col("_b") != "", F.col("_b")), "_a").alias("title"))


def index_rows(rows: DataFrame, key: str, needed: str, seq: str) -> DataFrame:
    """The last row of each key, of the rows that have the key and ``needed``."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return latest_by_key(rows.where(full(key) & (F.size(needed) > 0 if dict(rows.dtypes)[needed].startswith("array") else full(needed))), key, seq)


def read_gaps(spark: SparkSession, path: str, prefix: str = "", short: str = "") -> DataFrame:
    """node ids of a list of links."""
    line = F.trim("value")
    return spark.read.text(path).where(line.startswith("http")).select((scalars.shortened(line, prefix, short) if prefix else line).alias("node")).distinct()


def read_record(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def titles(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first title of each wanted work; ``found``: s, p, o_lit, seq."""
    work = F.regexp_replace("s", r"\.\d+$", "")
    return found.where(F.col("p").endswith("#expression_title")).select(work.alias("id"), "o_lit", "seq").join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by("o_lit", "seq").alias("title"))


def latest_by_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(key, "_r.*")


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, text of the XML members of zip archives, without tables of contents."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = sorted(n for n in z.namelist() if n.endswith(".xml") and ".toc." not in n)
                    yield pd.DataFrame({"archive": p, "name": names, "text": [z.read(n).decode("utf-8", "replace") for n in names]}, columns=["archive", "name", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, text string")


def best_text(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """key, text, source: the source of least priority that has text; ``("", "none")`` without one."""
    w = Window.partitionBy("key").orderBy("priority", "source")
    best = candidates.where(F.col("text") != "").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("key", "text", "source")
    return keys.select("key").join(best, "key", "left").select("key", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"))


@dataclass
class Truth:
    nodes: DataFrame
    facts: DataFrame
    faults: DataFrame
    gaps: DataFrame
    reserves: DataFrame


def smallest_values(values: DataFrame) -> DataFrame:
    """id, property, value, all: the least of several values, with all of them."""
    every = F.array_sort(F.collect_set("value"))
    return values.groupBy("id", "property").agg(every.alias("all")).select("id", "property", F.element_at("all", 1).alias("value"), F.when(F.size("all") > 1, F.col("all")).alias("all"))


def build(edges: DataFrame, values: DataFrame, gaps: DataFrame, empty_target: str | None = None) -> Truth:
    """A frozen truth from edges (s, p, o), property values (id, property, value) and gaps (node).

    ``empty_target``: the id that stands for no target; its edges are faults of their own kind, which L3 does not report again.
    """
    facts = sampling.sequential_ids(edges.select("s", "p", "o").distinct(), ["p", "s", "o"], "f-%06d").withColumn("evidence_status", F.lit("declared"))
    ids = facts.select(F.explode(F.array("s", "o")).alias("id")).distinct()
    flat = smallest_values(values.join(ids, "id", "left_semi"))
    props = ("celex", "date_document", "date_entry_into_force", "date_end_of_validity", "in_force")
    wide = flat.groupBy("id").agg(
        *[F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in props],
        F.max(F.when(F.col("property") == "types", F.coalesce("all", F.array("value")))).alias("types"),
        F.map_from_entries(F.collect_list(F.when(F.col("all").isNotNull(), F.struct("property", "all")))).alias("all_values"),
    )
    lack = gaps.select(F.col("node").alias("id")).distinct().withColumn("gap", F.lit(True))
    nodes = ids.join(wide, "id", "left").join(lack, "id", "left").withColumn("in_force", scalars.truth_value(F.col("in_force")))
    nodes = nodes.withColumn("date_document_status", scalars.date_status(F.col("date_document"), F.col("celex"))).withColumn("labels", F.coalesce("types", F.array().cast("array<string>")))
    none = F.lit(None).cast("string")
    if empty_target is not None:
        nodes = nodes.withColumn("celex", F.when(F.col("id") == empty_target, "").otherwise(F.col("celex")))
    sentinel = nodes.where(F.col("date_document_status") == "sentinel").select(none.alias("fact"), F.col("id").alias("node"), F.lit("sentinel_date").alias("kind"), F.lit(0).alias("seq"))
    broken = laws.violations(facts, nodes).where(F.size("laws") > 0)
    bare = F.col("o").eqNullSafe(F.lit(empty_target)) if empty_target is not None else F.lit(False)
    empty = facts.where(bare).select(F.col("id").alias("fact"), none.alias("node"), F.lit("empty_target").alias("kind"), F.lit(1).alias("seq"))
    law = broken.where(F.size(F.when(bare, F.array_except("laws", F.array(F.lit("L3")))).otherwise(F.col("laws"))) > 0)
    law = law.select(F.col("id").alias("fact"), none.alias("node"), F.lit("law_violation").alias("kind"), F.lit(2).alias("seq"))
    reserves = nodes.where(F.col("date_document_status") == "inconsistent").select(F.col("id").alias("node"), F.lit("date_inconsistent_with_key").alias("kind"), F.col("date_document").alias("value"), "celex")
    seen = gaps.select("node").distinct().join(facts.select(F.col("o").alias("node"), "id"), "node", "left").groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("seen_as_target_in"))
    return Truth(nodes, facts, sentinel.unionByName(empty).unionByName(law), seen.withColumn("kind", F.lit("absent_from_source")), reserves)


def export_edges(rows: DataFrame) -> DataFrame:
    """Edges of a paged graph export: duplicates go, internal labels (``_``) are dropped."""
    return rows.dropDuplicates(["s", "p", "o"]).withColumn("labels", F.filter("labels", lambda x: ~x.startswith("_")))
