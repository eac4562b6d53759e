"""Run registered queries next to their check SQL.

`python -m tests.compare [--sf 0.01] [name-prefix ...]`
"""

import argparse
import math
import sys
import time

import duckdb

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _cell(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def canonical(columns, rows):
    """Rows as sorted text, with the columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, db, name, folder):
    """None when the query equals its check, else a description."""
    df = contract.queries()[name](spark, folder)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    statement = contract.oracle_sql().get(name)
    if statement is None:
        return None if mine[1] else "no rows"
    result = db.execute(statement)
    theirs = canonical([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        left, right = set(mine[1]), set(theirs[1])
        only_mine, only_theirs = sorted(left - right)[:3], sorted(right - left)[:3]
        return f"rows {len(mine[1])} / {len(theirs[1])}: {only_mine} / {only_theirs}"
    if not mine[1]:
        return "no rows"
    return None


def main():
    from tests.conftest import make_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    folder = f"/root/testdata/sf{options.sf}"
    spark, db = make_session(), connect(folder)
    bad = 0
    for name in contract.queries():
        if options.names and not any(name.startswith(n) for n in options.names):
            continue
        start = time.time()
        try:
            problem = difference(spark, db, name, folder)
        except Exception as error:  # report every query, then fail
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        checked = "sql" if name in contract.oracle_sql() else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name} ({checked}) {time.time() - start:.1f}s"
              + (f"  {problem}" if problem else ""), flush=True)
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
