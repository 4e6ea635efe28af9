"""Runs registered queries next to their check SQL and compares the results.

As a script: ``python tests/compare.py <sf_dir> [name prefix ...]``.
"""

import decimal
import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (bool, str)) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return value


def digest(rows) -> str:
    lines = sorted(repr(row) for row in rows)
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def spark_result(df):
    columns = sorted(df.columns)
    rows = [tuple(cell(v) for v in row) for row in df.select(*columns).collect()]
    return columns, rows


def duck_result(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(cell(r[i]) for i in order) for r in cursor.fetchall()]
    return [names[i] for i in order], rows


def difference(mine, theirs) -> str | None:
    """What differs between two (columns, rows) results; None when they agree."""
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"row counts {len(mine[1])} / {len(theirs[1])}"
    if digest(mine[1]) == digest(theirs[1]):
        return None
    only_mine = sorted(set(map(repr, mine[1])) - set(map(repr, theirs[1])))
    only_theirs = sorted(set(map(repr, theirs[1])) - set(map(repr, mine[1])))
    return f"{len(only_mine)} rows differ, e.g.\n   {only_mine[:1]}\n   {only_theirs[:1]}"


def main(sf_dir: str, prefixes):
    import __spark_entry__ as entry
    from shelfwise.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    print(sf_dir, con.execute("SELECT count(*) FROM part").fetchall()[0][0], "parts", flush=True)
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            start = time.time()
            mine = spark_result(fn(spark, sf_dir))
            took = time.time() - start
            note = f"rows only ({len(mine[1])})"
            if name in oracles:
                start = time.time()
                wrong = difference(mine, duck_result(con, oracles[name]))
                note = wrong or f"ok {len(mine[1])} rows, sql {time.time() - start:.1f}s"
                if not mine[1]:
                    note += " EMPTY"
                bad += wrong is not None
        except Exception as error:  # report and go on with the next query
            bad += 1
            took, note = 0.0, f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:40s} {took:6.2f}s  {note}"[:900], flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
