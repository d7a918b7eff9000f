"""Runs queries against their SQL: ``python tests/check_queries.py FOLDER [NAME ...]``."""

import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, difference  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    # a plain session: the queries must not lean on settings of ours
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            df = run(spark, folder)
            found = difference(df, sql[name], con) if name in sql else f"(no SQL) {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:700]}"
        ok = found is None or found.startswith("(no SQL)")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - begin:.2f}s {found or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
