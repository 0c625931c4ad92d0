"""Runs queries and their SQL twins side by side, as the driver does.

    python tests/oracle.py SF_DIR [NAME...]
"""

import glob
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None if equal, else what differs."""
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = canonical([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows; first of ours {ours[1][:2]}, of theirs {theirs[1][:2]}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(ours[1])} rows differ: {bad[:2]}" if bad else None


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, found, sql = connect(sys.argv[1]), entry.queries(), entry.oracle_sql()
    names = [n for n in found if not sys.argv[2:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in sys.argv[2:])]
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = found[n](spark, sys.argv[1])
            if n in sql:
                said = compare(df, con, sql[n]) or "equal"
            else:
                said = f"{len(df.collect())} rows, no SQL; {df.dtypes}"
        except Exception as e:
            said = f"ERROR {type(e).__name__} {str(e)[:700]}"
        failed += said != "equal" and "no SQL" not in said
        print(f"{n}: {said} ({time.time() - t:.1f} s)", flush=True)
    print(f"{len(names)} queries, {failed} failed")
