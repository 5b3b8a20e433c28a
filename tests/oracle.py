"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, build, sql):
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(set(names) ^ set(df.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(got, want):
        if a == b:
            continue
        close = all(
            x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool)
                       and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6))
            for x, y in zip(a, b)
        )
        if not close:
            return f"columns {sorted(names)}\n   spark {a}\n   sql   {b}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    seen = {d[0]: str(d[1]).lower() for d in cur.description}
    pairs = {"bigint": ("bigint",), "int": ("integer",), "double": ("double",), "string": ("varchar", "string"), "boolean": ("boolean", "bool"),
             "timestamp": ("timestamp",), "date": ("date",)}
    odd = [f"{c}: {k} vs {seen[c]}" for c, k in kinds.items() if seen[c] not in pairs.get(k, (k,)) and not seen[c].startswith(k[:6])]
    return ("ok" if got else "ok-empty") + (f" TYPES {odd}" if odd else "")


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cohortlens.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                               "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle, wanted, bad = entry.oracle_sql(), sys.argv[1:], 0
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                verdict = compare(spark, con, folder, name, build, oracle[name])
            else:
                verdict = f"no-sql rows={len(build(spark, folder).collect())}"
        except Exception as error:  # report and go on to the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        fine = verdict.startswith(("ok", "no-sql"))
        bad += not fine
        print(f"{'PASS' if fine else 'FAIL'} {name} {time.time() - start:.2f}s {verdict}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
