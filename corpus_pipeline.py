"""The corpus pipeline: five stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language, near_dedup, packing, pii
from factloom.llm._common import materialise, read


#: Least share of a document's letters that stands in words of its language, of a script that some learned language has.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null or empty text, no letter, or hardly any in a script that is known.

    Repeated rows are judged each and alike; ties go to the language first in order; a very long text is read whole; other columns
    pass through, whatever their names; an empty table stays empty.
    """
    return language.known(docs, language.fit(docs.select("text", "lang")), LEAST_SCORE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of the least doc_id, one row of it.

    Null texts all stay; an empty text only equals itself; texts of any length are compared whole; a null doc_id comes last.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, whatever their length; null and empty texts have none. Repeated rows go or stay together."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are generalised in the text; n_chars follows. No row goes; a null text stays null, an empty one empty."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences. A null or empty text is the end id alone; repeated rows are packed each; no documents give no pieces."""
    pieces = packing.pack(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Language scores, sampled signatures and token ids have no form in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
