"""Compare every registered query with its SQL check. Usage: check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def kind_of(arrow_type) -> str:
    text = str(arrow_type)
    return {"large_string": "string", "timestamp[us, tz=UTC]": "timestamp[us]"}.get(text, text)


def rows_of(table) -> tuple[list, list]:
    names = sorted(table.column_names)
    kinds = [(n, kind_of(table.schema.field(n).type)) for n in names]
    return kinds, sorted(zip(*[table.column(n).to_pylist() for n in names]), key=repr)


def compare(frame, con, sql: str | None) -> str:
    """Empty when the query result has the same columns, types and rows as the SQL."""
    got_kinds, got = rows_of(frame.toArrow())
    if sql is None:
        return "" if got_kinds else "no columns"
    want_kinds, want = rows_of(con.execute(sql).to_arrow_table())
    if [n for n, _ in got_kinds] != [n for n, _ in want_kinds]:
        return f"columns {got_kinds} != {want_kinds}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got_kinds != want_kinds:
        return f"types {[p for p in zip(got_kinds, want_kinds) if p[0] != p[1]]}"
    differing = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else ""


def main() -> int:
    import __spark_entry__ as entry
    from packetscope.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(queries[name](spark, sf_dir), con, checks.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in checks else "ok (rows only)")
        print(f"{name:20s} {time.time() - start:6.2f}s {mark} {problem}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree, {len(checks)} have SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main())
