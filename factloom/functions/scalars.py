"""Scalar columns over keys, dates and ratios."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The letter of a document key and the type it stands for.
TYPES = {
    "R": "Regulation",
    "L": "Directive",
    "D": "Decision",
    "H": "Recommendation",
    "A": "Agreement",
    "Q": "RulesOfProcedure",
    "X": "OtherAct",
    "C": "Communication",
}
SENTINEL_YEAR = 1950
YEAR_GAP = 10
ISO = r"^\d{4}-\d{2}-\d{2}$"


def iso_date(text: Column) -> Column:
    """The date of a strict ``YYYY-MM-DD`` text; null if it is anything else."""
    return F.when(text.rlike(ISO), text.try_cast("date"))


def timestamp_date(text: Column) -> Column:
    """As ``iso_date``, of the first ten characters."""
    return iso_date(F.substring(text, 1, 10))


def key_year(key: Column) -> Column:
    return F.regexp_extract(key, r"^[0-9]([0-9]{4})[A-Z]", 1).try_cast("int")


def type_label(key: Column) -> Column:
    letter = F.regexp_extract(F.coalesce(key, F.lit("")), r"^\d\d{4}([A-Z])", 1)
    out = F.lit(None).cast("string")
    for k, v in TYPES.items():
        out = F.when(letter == k, F.lit(v)).otherwise(out)
    return out


def date_status(date: Column, key: Column) -> Column:
    """missing, sentinel, inconsistent or ok."""
    parsed = iso_date(date)
    far = F.abs(key_year(key) - F.year(parsed)) > YEAR_GAP
    return (
        F.when(F.coalesce(date, F.lit("")) == "", "missing")
        .when(parsed.isNull() | (F.year(parsed) < SENTINEL_YEAR), "sentinel")
        .when(F.coalesce(far, F.lit(False)), "inconsistent")
        .otherwise("ok")
    )


def truth_value(text: Column) -> Column:
    return F.lower(text).isin("true", "1")


def _key_parts(key: Column) -> tuple[Column, Column, Column, Column]:
    pattern = r"^(\d)(\d{4})([A-Z]{1,2})(\d{3,4})"
    part = [F.regexp_extract(F.coalesce(key, F.lit("")), pattern, k) for k in range(1, 5)]
    return part[0], part[1], part[2], part[3].try_cast("int").cast("string")


def _numbers(year: Column, number: Column) -> list[Column]:
    short = F.substring(year, 3, 2)
    return [F.concat_ws("/", number, year), F.concat_ws("/", year, number), F.concat_ws("/", number, short), F.concat_ws("/", short, number)]


def search_keys(key: Column) -> Column:
    """Printed numbers of a key for text search; none for treaties and agreements."""
    sector, year, _, number = _key_parts(key)
    none = F.array().cast("array<string>")
    return F.when((sector == "") | sector.isin("1", "2"), none).otherwise(F.array(*_numbers(year, number)))


def audit_keys(key: Column) -> Column:
    """Looser keys for a reader who confirms: articles of treaties, preparatory numbers, slashed variants."""
    sector, year, kind, number = _key_parts(key)
    four = _numbers(year, number)
    article = F.array(*[F.concat(F.lit(w), number) for w in ("article ", "art. ", "articles ")])
    draft = F.array(
        F.concat(F.lit("COM("), year, F.lit(") "), number), F.concat(F.lit("COM ("), year, F.lit(") "), number), F.concat(F.lit("("), year, F.lit(") "), number), four[0], four[1]
    )
    slashed = F.array(*four, F.concat(year, F.lit("/"), number, F.lit("/")), F.concat(F.substring(year, 3, 2), F.lit("/"), number, F.lit("/")))
    return (
        F.when(sector == "", F.array(key))
        .when(sector == "1", article)
        .when(sector == "2", F.array().cast("array<string>"))
        .when(sector == "5", draft)
        .when(kind.isin("L", "D"), slashed)
        .otherwise(F.array(*four))
    )


def document_link(key: Column, language: str = "EN", form: str = "TXT", base: str = "https://documents.example/legal-content") -> Column:
    return F.concat(F.lit(f"{base}/{language}/{form}/?uri=CELEX:"), key)


def shortened(uri: Column, prefix: str, short: str) -> Column:
    return F.when(uri.startswith(prefix), F.concat(F.lit(short), F.substring(uri, len(prefix) + 1, 1 << 20))).otherwise(uri)


def next_year(date: Column) -> Column:
    """The same day a year on (28 February for 29 February), as ISO text."""
    return F.date_format(F.add_months(iso_date(date), 12), "yyyy-MM-dd")


def bumped(value: Column) -> Column:
    """The last digit plus one modulo ten; ``X`` appended where the last character is no digit."""
    last = F.substring(value, -1, 1)
    digit = F.pmod(last.try_cast("int") + 1, F.lit(10)).cast("string")
    return F.when(last.rlike("^[0-9]$"), F.concat(F.regexp_replace(value, "[0-9]$", ""), digit)).otherwise(F.concat(value, F.lit("X")))


def rate(text: str) -> Fraction:
    """``"40"``, ``"1/2"`` or ``"0.10"`` exactly."""
    return Fraction(text)


def share_count(text: str, pool: int, absolute: bool = False) -> int:
    """``round(rate * pool)``, half to even; a whole number above one is a count where ``absolute``."""
    r = rate(text)
    return int(r) if absolute and r > 1 else round(r * pool)


def ratio_text(num: int, den: int) -> str:
    return f"{num / den:.4f}" if den else "undefined"


@F.pandas_udf(StringType())
def ratio_value(num: pd.Series, den: pd.Series) -> pd.Series:
    """``ratio_text`` of a column (Spark's own format rounds ties another way)."""
    return pd.Series([ratio_text(a, b) for a, b in zip(num, den, strict=True)], dtype="object")
