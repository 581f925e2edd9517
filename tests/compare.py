"""Run every query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    keys = frame.map(lambda value: "" if value is None else str(value))
    return frame.loc[keys.sort_values(list(keys.columns)).index].reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = ordered(got), ordered(want)
    for column in got.columns:
        same = (got[column] == want[column]) | (got[column].isna() & want[column].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{column}: {int((~same).sum())} differ, first {got.loc[at].to_dict()} != {want.loc[at].to_dict()}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as spark_entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(spark_entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for name in names:
        started = time.time()
        try:
            got = spark_entry.queries()[name](spark, folder).toPandas()
            took = time.time() - started
            sql = spark_entry.oracle_sql().get(name)
            started = time.time()
            want = connection.execute(sql).fetchdf() if sql else got
            result = differences(got, want) or "same"
            print(name, result, f"rows={len(got)} spark={took:.2f}s duckdb={time.time() - started:.2f}s", flush=True)
        except Exception as error:
            print(name, "ERROR", type(error).__name__, str(error)[:1500], flush=True)
