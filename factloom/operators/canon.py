"""Canonical JSON and content hashes: sorted keys, no white space, no floats."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _refuse(value: object) -> None:
    if isinstance(value, float):
        raise TypeError("no float in a hashed record")
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise TypeError("keys are strings")
            _refuse(v)
    elif isinstance(value, list | tuple):
        for v in value:
            _refuse(v)


def dumps(record: object) -> str:
    _refuse(record)
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(record: object) -> str:
    return hashlib.sha256(dumps(record).encode()).hexdigest()


def sealed(record: dict, key: str = "sha256") -> dict:
    """The record with the hash of all but that hash."""
    return {**record, key: digest({k: v for k, v in record.items() if k != key})}


def write(path: str, record: object) -> None:
    """A record for people to read: indented by one, with a new line at the end."""
    _refuse(record)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(record, out, ensure_ascii=False, indent=1)
        out.write("\n")


def row_json(df: DataFrame, out: str = "canonical") -> DataFrame:
    """The row as JSON with sorted keys; nulls stay."""
    return df.withColumn(out, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))


def dataset_digest(df: DataFrame) -> DataFrame:
    """One row: a hash that does not depend on the order of rows, summed from row hashes in 15-digit parts, and the row count."""
    rows = row_json(df).select(F.sha2("canonical", 256).alias("h"))
    part = lambda a: F.sum(F.conv(F.substring("h", a, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", *[part(a) for a in range(1, 65, 8)]), 256).alias("digest"))
