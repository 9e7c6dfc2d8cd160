"""Run registered queries against their SQL: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata")


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def expected(sql: str, sf: str):
    con = duckdb.connect()
    for f in (DATA / f"sf{sf}").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    return types, *_rows([d[0] for d in result.description], result.fetchall())


def actual(df):
    types = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    return types, *_rows(df.columns, [tuple(r) for r in df.collect()])


def difference(name, query, sql, spark, sf) -> str | None:
    """None when the query and its SQL agree, else a short description."""
    types, columns, rows = actual(query(spark, str(DATA / f"sf{sf}")))
    if sql is None:
        return None if rows else "no rows"
    want_types, want_columns, want = expected(sql, sf)
    if types != want_types:
        return f"columns {types} != {want_types}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    from hearthflow.catalog import ORACLES, QUERIES
    from hearthflow.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    session = local_session(cores=8)
    session.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        began = time.time()
        try:
            wrong = difference(name, QUERIES[name], ORACLES.get(name), session, sf)
        except Exception as e:  # noqa: BLE001
            wrong = f"{type(e).__name__}: {str(e)[:600]}"
        failed += wrong is not None
        print(f"{'ok  ' if wrong is None else 'FAIL'} {time.time() - began:6.1f}s {name} {wrong or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
