"""Run every catalogued query and its SQL oracle side by side: ``python tests/compare.py [sf_dir] [name...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[str, int]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", sum(got.values())
    if got != expected:
        return (
            f"rows {sum(got.values())} vs {sum(expected.values())}; only here {list((got - expected).items())[:2]}; "
            f"only there {list((expected - got).items())[:2]}"
        ), sum(got.values())
    return "", sum(got.values())


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = make_session()
    con = oracle_connection(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        if name not in oracles:
            print(f"ROWS  {name} {query(spark, sf_dir).count()} {time.time() - started:.2f}s", flush=True)
            continue
        try:
            problem, n = compare(spark, con, query, oracles[name], sf_dir)
        except Exception as error:  # reported, and counted as a failure
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'OK  '}  {name} {n} {time.time() - started:.2f}s {problem}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
