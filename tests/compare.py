"""Run registered queries next to their SQL and compare the results.

``python tests/compare.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(spark_table, sql_table) -> list[str]:
    if sorted(spark_table.column_names) != sorted(sql_table.column_names):
        return [f"columns {sorted(spark_table.column_names)} / {sorted(sql_table.column_names)}"]
    out = []
    for n in spark_table.column_names:
        left, right = spark_table.schema.field(n).type, sql_table.schema.field(n).type
        if str(left).replace("large_", "") != str(right).replace("large_", ""):
            out.append(f"type of {n}: {left} / {right}")
    a, b = rows_of(spark_table), rows_of(sql_table)
    if len(a) != len(b):
        out.append(f"rows {len(a)} / {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from themeforge.session import build_session

    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or sorted(queries):
        start = time.time()
        try:
            result = queries[name](spark, sf_dir).toArrow()
            spent = time.time() - start
            if name in oracles:
                start = time.time()
                expected = con.sql(oracles[name]).to_arrow_table()
                problems = differences(result, expected)
                status = "ok" if not problems else "DIFF " + "; ".join(problems)
                failed += bool(problems)
                print(f"{name}: {status} rows={result.num_rows} spark={spent:.1f}s sql={time.time() - start:.1f}s", flush=True)
            else:
                print(f"{name}: no SQL, rows={result.num_rows} spark={spent:.1f}s", flush=True)
        except Exception as error:
            failed += 1
            print(f"{name}: ERROR {str(error)[:600]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
