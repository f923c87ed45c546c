"""Run registered queries next to their SQL on DuckDB and compare the rows.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citemill import build_session  # noqa: E402
from citemill.registry import load_all  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, name: str) -> str:
    """Empty when the rows are equal, else what differs."""
    registered = load_all()[name]
    frame = registered.run(spark, folder)
    mine = frame.collect()
    if registered.sql is None:
        return "" if mine else "no rows"
    relation = connection.sql(registered.sql)
    theirs = relation.fetchall()
    if sorted(frame.columns) != sorted(relation.columns):
        return f"columns {sorted(frame.columns)} / {sorted(relation.columns)}"
    left, right = rows_of(frame.columns, mine), rows_of(relation.columns, theirs)
    if left == right:
        types = dict(zip(relation.columns, relation.types))
        for field in frame.schema:
            pair = (field.dataType.simpleString(), str(types[field.name]).lower())
            if pair not in SAME_TYPES:
                print("   type", name, field.name, *pair)
        return ""
    missing, extra = list(set(right) - set(left))[:2], list(set(left) - set(right))[:2]
    return f"{len(left)} rows / {len(right)} rows; only mine {str(extra)[:600]}; only sql {str(missing)[:600]}"


SAME_TYPES = {
    ("bigint", "bigint"), ("int", "integer"), ("string", "varchar"), ("double", "double"),
    ("boolean", "boolean"), ("timestamp_ntz", "timestamp"),
}


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(load_all())
    spark = build_session("oracle-check", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")


if __name__ == "__main__":
    main()
