"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if (p := Path(sf_dir) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return int(v) if isinstance(v, bool) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both have the same columns and rows."""
    cur = connected(sf_dir).execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return f"columns {got_names}, wanted {want_names}"
    if want != got:
        extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows, wanted {len(want)}; extra {extra}, missing {missing}"
    return ""
