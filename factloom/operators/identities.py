"""Author identities: every mention of a document, and the abbreviated ones resolved to page one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABBREVIATED = r"^\s*([A-ZÀ-Ý])\.\s*(?:[A-ZÀ-Ý]\.\s*)*([A-ZÀ-Ýa-zà-ÿ'’-]+)\s*$"


def initial(name: Column) -> Column:
    return F.upper(F.substring(F.trim(name), 1, 1))


def surname(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def reconciled(mentions: DataFrame, page_one: DataFrame) -> DataFrame:
    """document, mention, resolved: an abbreviation that only one page-one author fits becomes that author.

    ``mentions`` and ``page_one``: document, name.
    """
    short = F.regexp_extract("name", ABBREVIATED, 1)
    rows = mentions.select("document", F.col("name").alias("mention"), F.upper(short).alias("_i"), F.lower(F.regexp_extract("name", ABBREVIATED, 2)).alias("_s"))
    fits = page_one.select("document", initial(F.col("name")).alias("_i"), surname(F.col("name")).alias("_s"), "name").groupBy("document", "_i", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("_name"))
    rows = rows.join(fits, ["document", "_i", "_s"], "left")
    return rows.select("document", "mention", F.when((F.col("_i") != "") & (F.col("_n") == 1), F.col("_name")).otherwise(F.col("mention")).alias("resolved"), ((F.col("_i") != "") & (F.col("_n") >= 1)).alias("abbreviates"))


def splits(resolved: DataFrame, page_one: DataFrame) -> DataFrame:
    """Mentions left apart although an author of page one is the same person."""
    own = page_one.select("document", F.col("name").alias("resolved")).distinct()
    return resolved.where("abbreviates").join(own, ["document", "resolved"], "left_anti").select("document", "mention")


def assembled(mentions: DataFrame, page_one: DataFrame, with_filter: bool) -> tuple[DataFrame, DataFrame]:
    """(identities: one row; document, mention left apart) of mentions, resolved first or taken as they stand.

    Documents without an author on page one are left out.
    """
    held = mentions.join(page_one.select("document").distinct(), "document", "left_semi")
    found = reconciled(held, page_one)
    found = found if with_filter else found.withColumn("resolved", F.col("mention"))
    return identity_count(found), splits(found, page_one)


def identity_count(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count_distinct("resolved").alias("identities"))
