"""Compare a registered query with its SQL in DuckDB: same columns, same rows (floats within 1e-6)."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, float(v))
    if isinstance(v, int):
        return (1, float(v))
    if isinstance(v, float):
        return (1, float(f"{v:.5g}"))
    return (2, str(v))


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return a == b and isinstance(a, bool) == isinstance(b, bool)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)
    return a == b and type(a) is type(b)


def differences(spark_df, con, sql: str, limit: int = 5) -> list[str]:
    cols = sorted(spark_df.columns)
    got = [tuple(r) for r in spark_df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return [f"columns differ: only spark {sorted(set(cols) - set(names))}, only sql {sorted(set(names) - set(cols))}"]
    idx = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    if len(got) != len(want):
        return [f"rows differ: spark {len(got)}, sql {len(want)}"]
    order = sorted(range(len(cols)), key=lambda i: any(isinstance(r[i], float) for r in got[:200]))
    got.sort(key=lambda r: [_key(r[i]) for i in order])
    want.sort(key=lambda r: [_key(r[i]) for i in order])
    out = []
    for a, b in zip(got, want):
        bad = [(c, x, y) for c, x, y in zip(cols, a, b) if not _same(x, y)]
        if bad:
            out.append(f"{bad[:4]} in {a[:3]}")
            if len(out) >= limit:
                break
    return out
