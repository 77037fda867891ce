"""Runs queries beside their SQL in DuckDB and compares rows; also a command: compare.py FOLDER [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v: object) -> object:
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) == "NaT":
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)) or type(v).__name__ == "Decimal" and v == int(v):
        return int(v)
    return str(v)


def bag(rows: list[tuple], names: list[str]) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def differ(spark, folder: str, f, sql: str) -> str:  # noqa: ANN001
    """Nothing if the results agree, else what does not."""
    df = f(spark, folder)
    got, names = [tuple(r) for r in df.collect()], df.columns
    cur = connect(folder).execute(sql)
    want, cols = cur.fetchall(), [x[0] for x in cur.description]
    if sorted(names) != sorted(cols):
        return f"columns {sorted(names)} {sorted(cols)}"
    a, b = bag(got, names), bag(want, cols)
    return "" if a == b else f"rows {len(got)} {len(want)}; only here {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        began = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            said = differ(spark, sys.argv[1], entry.queries()[name], sql) if sql else f"{entry.queries()[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:300]}"
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
