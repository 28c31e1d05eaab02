"""Compares a query's rows with those of its SQL in DuckDB, as bags."""

from __future__ import annotations

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differences(frame, sql: str) -> tuple[int, int, int]:
    """(rows, rows only Spark has, rows only DuckDB has)."""
    got = frame.toArrow()
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.register("got", got)
    con.execute(f"create temp table want as {sql}").fetchall()
    columns = sorted(got.schema.names)
    assert columns == sorted(r[0] for r in con.execute("describe want").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    count = lambda a, b: con.execute(f"select count(*) from (select {listed} from {a} except all select {listed} from {b})").fetchone()[0]
    return got.num_rows, count("got", "want"), count("want", "got")
