"""Run registered queries and their SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


DUCK_TYPES = {"bigint": ("BIGINT", "NUMBER"), "int": ("INTEGER", "NUMBER"), "double": ("DOUBLE", "NUMBER"),
              "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "BOOL")}


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def compare(df, con, sql: str) -> str:
    """'' when names and rows agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    theirs_types = {d[0]: str(d[1]).upper() for d in cur.description}
    for f in df.schema.fields:
        want = DUCK_TYPES.get(f.dataType.simpleString())
        if want and theirs_types[f.name] not in want:
            return f"type of {f.name}: {f.dataType.simpleString()} vs {theirs_types[f.name]}"
    theirs = sorted(tuple(_cell(r[names.index(n)]) for n in order) for r in cur.fetchall())
    mine = sorted(tuple(_cell(r[n]) for n in order) for r in df.collect())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"first difference {dict(zip(order, a))} vs {dict(zip(order, b))}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tabspark.session import local_session
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(folder), 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            sql = entry.oracle_sql().get(name)
            result = compare(df, con, sql) if sql else f"rows only: {df.count()}"
        except Exception as e:
            result = f"ERROR {type(e).__name__} {str(e)[:500]}"
        bad += result != "" and not result.startswith("rows only")
        print(f"{time.time() - start:6.1f}s {name}: {result[:700] or 'ok'}", flush=True)
    print("failed:", bad)
