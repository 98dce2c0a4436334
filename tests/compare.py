"""Holds queries against their SQL in DuckDB."""

import glob
import os

import duckdb


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.9g}"
        if isinstance(v, bool):
            return str(int(v))
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def mismatch(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(found) != names:
        return f"columns {names} and {sorted(found)}"
    want = canon([tuple(r[found.index(n)] for n in names) for r in want])
    got = canon([tuple(r[n] for n in names) for r in df.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)}: {[x for x in got if x not in set(want)][:2]} {[x for x in want if x not in set(got)][:2]}"
    odd = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(odd)} of {len(got)} rows differ: {odd[:2]}" if odd else None
