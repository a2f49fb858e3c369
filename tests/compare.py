"""Compare registered queries with their SQL, value by value: python tests/compare.py SF [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(int(v)) if isinstance(v, bool) else str(v)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs first."""
    got_names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = canonical(*oracle_rows(sql, sf_dir))
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {set(got) ^ set(want) and list(set(got) ^ set(want))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{got_names}\n   {a}\n   {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from parcelwise.session import local_session

    sf_dir, names = str(DATA / f"sf{sys.argv[1]}"), sys.argv[2:]
    spark = local_session(8)
    bad = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                problem, note = None, f"rows only: {query(spark, sf_dir).count()}"
            else:
                problem, note = difference(query(spark, sf_dir), sql, sf_dir), ""
        except Exception as error:
            problem, note = str(error)[:600], ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note}{problem or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() and 1)
