"""Run registered queries against their DuckDB twins: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_df, con, sql: str) -> str:
    """Empty when both sides hold exactly the same rows, else what differs."""
    left = spark_df.toArrow()
    right = con.execute(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return f"columns {sorted(left.column_names)} vs {sorted(right.column_names)}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} vs {right.num_rows}"
    types = []
    for name in left.column_names:
        a, b = str(left.schema.field(name).type), str(right.schema.field(name).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            types.append(f"{name}: {a} vs {b}")
    con.register("spark_rows", left)
    con.register("sql_rows", right)
    columns = ", ".join(f'"{c}"' for c in sorted(left.column_names))
    extra = f"(select {columns} from spark_rows except all select {columns} from sql_rows)"
    missing = f"(select {columns} from sql_rows except all select {columns} from spark_rows)"
    n = con.execute(f"select count(*) from {extra}").fetchone()[0]
    if n:
        first = [con.execute(f"select * from {side} order by all limit 1").fetchone() for side in (extra, missing)]
        return f"{n} rows differ, first: {first[0]} vs {first[1]} {types}"
    return f"types {types}" if types else ""


def main() -> int:
    import __spark_entry__ as entry

    from larderflow.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(run(spark, sf_dir), con, oracles[name])
            else:
                problem = "" if run(spark, sf_dir).count() > 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {problem}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
