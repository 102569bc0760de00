"""Run registered queries on Spark and their DuckDB oracle side by side and
compare row count, column types and exact values (order-insensitive).

    python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from ledgerline.session import local_session  # noqa: E402
from ledgerline.sources import TEST_TABLES  # noqa: E402

CANON = {
    "int": "int32", "integer": "int32", "bigint": "int64", "double": "float64", "float": "float32",
    "string": "str", "varchar": "str", "boolean": "bool", "timestamp_ntz": "ts", "timestamp": "ts",
    "date": "date", "smallint": "int16", "tinyint": "int8",
}


def canon(t: str) -> str:
    t = t.lower()
    return CANON.get(t, t)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    scols = sdf.columns
    stypes = {c: canon(t) for c, t in sdf.dtypes}
    if sql is None:
        print(f"{name}: rows-only {len(srows)} rows ({t1 - t0:.1f}s)")
        return True
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = {c: canon(str(t)) for c, t in zip(rel.columns, rel.types)}
    drows = [tuple(norm(x) for x in r) for r in rel.fetchall()]
    ok = True
    msgs = []
    if sorted(scols) != sorted(dcols):
        ok = False
        msgs.append(f"columns differ: spark-only {sorted(set(scols) - set(dcols))[:8]} duck-only {sorted(set(dcols) - set(scols))[:8]}")
    else:
        bad = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
        if bad:
            ok = False
            msgs.append(f"types differ: {dict(list(bad.items())[:8])}")
    if len(srows) != len(drows):
        ok = False
        msgs.append(f"rows {len(srows)} vs {len(drows)}")
    if ok:
        order = sorted(scols)
        si = [scols.index(c) for c in order]
        di = [dcols.index(c) for c in order]
        key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
        sr = sorted((tuple(r[i] for i in si) for r in srows), key=key)
        dr = sorted((tuple(r[i] for i in di) for r in drows), key=key)
        diffs = {}
        for a, b in zip(sr, dr):
            for c, x, y in zip(order, a, b):
                if x != y:
                    d = diffs.setdefault(c, [0, 0.0, (x, y)])
                    d[0] += 1
                    if isinstance(x, float) and isinstance(y, float):
                        d[1] = max(d[1], abs(x - y) / max(1e-300, abs(y)))
        if diffs:
            ok = False
            msgs.append("values differ: " + "; ".join(f"{c}: {n} rows, rel {r:.2e}, e.g. {ex}" for c, (n, r, ex) in list(diffs.items())[:6]))
    print(f"{name}: {'OK' if ok else 'MISMATCH'} {len(srows)} rows ({t1 - t0:.1f}s) " + " | ".join(msgs))
    return ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from ledgerline.plans.catalog import REGISTRY

    spark = local_session(8)
    con = duck(sf_dir)
    results = {}
    for name, (fn, sql) in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            results[name] = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {type(e).__name__}: {str(e)[:600]}")
            results[name] = False
    bad = [n for n, v in results.items() if not v]
    print(f"{len(results) - len(bad)}/{len(results)} ok; failing: {bad}")
    return 0 if not bad else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
