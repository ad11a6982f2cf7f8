"""Run registered queries against their DuckDB texts: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from candorframe.tables import TABLES  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def compare(df, con, sql):
    """'' when rows, column names and values agree, else what differs."""
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    if sorted(have) != names:
        return f"columns {names} != {sorted(have)}"
    order = [have.index(c) for c in names]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = sorted(tuple(map(_cell, r)) for r in got), sorted(tuple(map(_cell, r)) for r in want)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference:\n   {dict(zip(names, x))}\n   {dict(zip(names, y))}"
    return ""


def main(argv):
    from candorframe.catalog import ORACLES, QUERIES
    from candorframe.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv and "/" in argv[0]:
        sf, argv = argv[0], argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in [n for n in QUERIES if not argv or any(n.startswith(a) for a in argv)]:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf)
            note = compare(df, con, ORACLES[name]) if name in ORACLES else f"no oracle, {df.count()} rows"
        except Exception as exc:  # a failing query must not hide the others
            note = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        flag = "ok " if note == "" or note.startswith("no oracle") else "BAD"
        bad += flag == "BAD"
        print(f"{flag} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
