"""Runs registered queries beside their SQL twins and compares all values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if value is not None and type(value).__name__ == "Decimal":
        return float(value)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def difference(spark_df, con, sql) -> str | None:
    """None if equal, else a short description of the first difference."""
    got_columns, got = sorted_rows(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    want_columns, want = sorted_rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for a, b in zip(got, want):
        if a != b:
            bad = sum(x != y for x, y in zip(got, want))
            return f"{bad} rows differ, first {a} != {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry_points
    from disputeflow.session import build_session

    sf = sys.argv[1]
    chosen = sys.argv[2:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(f"/root/testdata/sf{sf}")
    oracle = entry_points.oracle_sql()
    for name, query in entry_points.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            rows = query(spark, f"/root/testdata/sf{sf}")
            if name in oracle:
                verdict = difference(rows, con, oracle[name]) or "ok"
            else:
                verdict = f"rows {rows.count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:7.2f}s  {verdict}", flush=True)
