"""Compare every registered query with its SQL: python tests/oracle.py <sf_dir> [name ...]"""

import glob
import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from thingfleet.session import builder  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, str, datetime, date)):
        return v
    if isinstance(v, float):
        return v if math.isnan(v) else float(repr(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((x is not None, str(type(x)), str(x)) for x in t))


def compare(spark, con, name, sf_dir):
    """None when both agree, else what differs; with the number of rows and the seconds taken."""
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("no sql" if rows else "no rows"), len(rows), took
    ours = table(df.columns, rows)
    cur = con.execute(sql)
    theirs = table([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}", len(rows), took
    if len(ours[1]) != len(theirs[1]):
        a, b = set(ours[1]), set(theirs[1])
        return f"rows {len(ours[1])} != {len(theirs[1])}: {list(a - b)[:2]} / {list(b - a)[:2]}", len(rows), took
    for a, b in zip(*(ours[1], theirs[1])):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}", len(rows), took
    return None, len(rows), took


if __name__ == "__main__":
    sf = sys.argv[1]
    spark = (
        builder("oracle", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
        .master("local[8]").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = []
    for name in sys.argv[2:] or entry.queries():
        try:
            problem, n, took = compare(spark, con, name, sf)
        except Exception as e:
            problem, n, took = f"{type(e).__name__}: {str(e)[:600]}", 0, 0.0
        flag = "ok" if problem is None else problem
        if problem is not None and problem != "no sql":
            bad.append(name)
        if n == 0 and name not in bad:
            bad.append(name + " (empty)")
        print(f"{name:28s} {n:8d} {took:7.2f}s {flag[:700]}", flush=True)
    print("BAD", bad)
