"""Compare queries with their SQL on one folder of tables (development aid)."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from . import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)

    def cell(v):
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NA or v is pd.NaT:
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float):
            return repr(round(v, 6)) if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))


def main(directory: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{directory}/{name}.parquet'")
    bad = []
    for name in names or sorted(QUERIES):
        start = time.time()
        try:
            got = QUERIES[name](spark, directory).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            want = con.sql(ORACLES[name]).df()
            if sorted(got.columns) != sorted(want.columns):
                bad.append(name)
                print(f"COLS {name} {sorted(got.columns)} {sorted(want.columns)}", flush=True)
                continue
            a, b = canonical(got), canonical(want)
            if a == b:
                print(f"ok   {name} {len(a)} {took:.1f}s", flush=True)
            else:
                bad.append(name)
                only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
                print(f"DIFF {name} {len(a)} {len(b)}\n  spark {only_a}\n  duck  {only_b}", flush=True)
        except Exception as ex:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name} {str(ex)[:1500]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], [a for a in sys.argv[2:] if not a.startswith("-")])
