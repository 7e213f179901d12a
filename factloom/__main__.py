"""``python -m factloom QUERY DATA [--limit N]``: the rows of a query in the order of its columns, as canonical JSON lines; without a query, their names."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from factloom.operators import canon
from factloom.plans import queries


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__)
    parser.add_argument("query", nargs="?")
    parser.add_argument("data", nargs="?")
    parser.add_argument("--limit", type=int, default=20)
    given = parser.parse_args(arguments)
    known = queries.queries()
    if given.query is None or given.data is None:
        print("\n".join(sorted(known)))
        return 0
    if given.query not in known:
        parser.error(f"no query {given.query}")
    rows = known[given.query](SparkSession.builder.getOrCreate(), given.data)
    for line in canon.row_json(rows.orderBy(*rows.columns).limit(given.limit)).select("canonical").toLocalIterator():
        print(line[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
