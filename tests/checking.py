"""Side-by-side run of a registered query on Spark and of its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, decimal.Decimal):
        return ("DECIMAL", str(value))
    if isinstance(value, int):
        return ("n", float(value))
    if isinstance(value, float):
        return ("n", "-0.0") if value == 0 and math.copysign(1, value) < 0 else ("n", value)
    if isinstance(value, dt.datetime):
        return ("ts", value.isoformat())
    if isinstance(value, dt.date):
        return ("d", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    return ("s", str(value))


def family(kind: str) -> str:
    kind = kind.lower()
    if kind.startswith(("int", "bigint", "small", "tiny", "ubig", "uint")):
        return "int"
    if kind.startswith(("double", "float")):
        return "double"
    if kind.startswith(("varchar", "string")):
        return "string"
    if kind.startswith("bool"):
        return "bool"
    return kind


def compare(spark, con, query, sf_dir: str) -> tuple[str, float, float, int]:
    started = time.time()
    df = query.run(spark, sf_dir)
    rows = df.collect()
    spark_seconds = time.time() - started
    if query.sql is None:
        return ("rows-only" if rows else "EMPTY"), spark_seconds, 0.0, len(rows)
    started = time.time()
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    expected = result.fetchall()
    duck_seconds = time.time() - started
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(names)}", spark_seconds, duck_seconds, len(rows)
    order = sorted(names)
    mine = sorted((tuple(plain(row[c]) for c in order) for row in rows), key=repr)
    position = {n: i for i, n in enumerate(names)}
    other = sorted((tuple(plain(row[position[c]]) for c in order) for row in expected), key=repr)
    note = ""
    types = dict(df.dtypes)
    odd = [f"{n}:{types[n]}/{kinds[i]}" for i, n in enumerate(names) if family(types[n]) != family(kinds[i])]
    if odd:
        note = f" types {odd}"
    if mine == other:
        return ("ok" if not note else "TYPES" + note) + ("" if rows else " EMPTY"), spark_seconds, duck_seconds, len(rows)
    text = f"DIFF rows {len(mine)}/{len(other)}{note}"
    shown = 0
    for a, b in zip(mine, other):
        if a != b:
            text += "\n      spark " + str(dict((c, v) for c, v in zip(order, a))) + "\n      sql   " + str(dict((c, v) for c, v in zip(order, b)))
            shown += 1
            if shown == 2:
                break
    return text, spark_seconds, duck_seconds, len(rows)


def main() -> None:
    """python -m tests.checking <sf dir> [name part ...]"""
    from caudal.catalog import load
    from caudal.session import local_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in load().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            verdict, a, b, n = compare(spark, con, query, sf_dir)
        except Exception as error:  # noqa: BLE001 - a report tool: show every failure
            verdict, a, b, n = f"ERROR {type(error).__name__} {str(error)[:900]}", 0, 0, 0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{verdict[:4]:4s} {name:34s} rows {n:7d} spark {a:6.2f}s duck {b:6.2f}s {'' if verdict in ('ok', 'rows-only') else verdict}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
