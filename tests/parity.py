"""Compare registered queries with their oracle statements in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when equal."""
    problems = []
    result = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(result.columns):
        return [f"columns {names} != {sorted(result.columns)}"]
    want_types = dict(zip(result.columns, map(str, result.types)))
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind.upper()) != want_types[name]:
            problems.append(f"type of {name}: {kind} / {want_types[name]}")
    at = [result.columns.index(n) for n in names]
    want = sorted((tuple(_plain(row[i]) for i in at) for row in result.fetchall()), key=repr)
    got = sorted((tuple(_plain(v) for v in row) for row in df.select(*names).collect()), key=repr)
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
        extra = list(set(got) - set(want))[:2]
        missing = list(set(want) - set(got))[:2]
        problems.append(f"  only spark {extra}; only oracle {missing}")
    elif got != want:
        different = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(different)} of {len(got)} rows differ, {names}: {different[0]}")
    elif not got:
        problems.append("no rows")
    return problems


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pulsegrid.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = oracle_connection(sf_dir), oracle_sql()
    bad = 0
    for name, plan in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = plan(spark, sf_dir)
            problems = compare(df, con, oracles[name]) if name in oracles else ([] if df.count() else ["no rows"])
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        real = [p for p in problems if p != "no rows"]
        bad += bool(real)
        note = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if real else 'ok  '} {name}{note} {time.time() - start:.1f}s " + "\n     ".join(problems), flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
