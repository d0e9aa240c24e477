"""Compare registered queries with their oracle SQL: python -m workload.check <sf_dir> [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from workload.oracle import ORACLE
from workload.queries import QUERIES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return None
        return round(float(v), 9) if isinstance(v, float) else v

    return sorted((tuple(str(plain(v)) for v in row) for row in frame.astype(object).itertuples(index=False)))


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    started = time.time()
    found = QUERIES[name](spark, sf_dir)
    columns = found.columns
    got = pd.DataFrame([tuple(r) for r in found.collect()], columns=columns, dtype=object)
    took = time.time() - started
    if name not in ORACLE:
        return f"rows-only {len(got)} ({took:.1f}s)"
    result = con.execute(ORACLE[name])
    wanted = pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description], dtype=object)
    if sorted(columns) != sorted(wanted.columns):
        return f"COLUMNS {sorted(columns)} != {sorted(wanted.columns)}"
    a, b = _rows(got), _rows(wanted)
    if a == b:
        return f"ok {len(a)} rows ({took:.1f}s)"
    extra, missing = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"DIFF {len(a)} vs {len(b)} rows ({took:.1f}s)\n   {sorted(columns)}\n   got  {extra}\n   want {missing}"


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    for name in names:
        try:
            print(name, compare(spark, con, sf_dir, name), flush=True)
        except Exception as failure:  # noqa: BLE001
            print(name, "FAILED", str(failure)[:600], flush=True)


if __name__ == "__main__":
    main()
