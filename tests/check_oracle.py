"""Compare every query with its SQL on a data folder: python tests/check_oracle.py [folder] [names]"""

import pathlib
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
from __spark_entry__ import oracle_sql, queries  # noqa: E402


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if str(column.dtype).startswith("datetime"):
            column = column.astype("datetime64[us]")
        frame[name] = column.map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def connect(folder):
    con = duckdb.connect()
    for path in pathlib.Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder, name):
    """None if equal, else what differs; without SQL, the number of rows is returned as text."""
    got = queries()[name](spark, folder).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        return None if len(got) else "no rows"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    got, want = normal(got), normal(want)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = (got != want).any(axis=1)
    if bad.any():
        return f"{int(bad.sum())} rows differ\n{got[bad].head(3).to_dict('records')}\n{want[bad].head(3).to_dict('records')}"
    return None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    for name in names:
        begun = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {name} {time.time() - begun:.1f}s {problem or ''}", flush=True)
