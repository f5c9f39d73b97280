"""Compare every query with its SQL: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} expected {sorted(names)}"
    types = dict(df.dtypes)
    want = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    odd = {n: (types[n], kinds[n]) for n in names if want.get(kinds[n]) != types[n]}
    if odd:
        return f"types differ {odd}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}; first {got[:2]} / {expected[:2]}"
    if not got:
        return "no rows on either side"
    for a, b in zip(got, expected):
        if a != b:
            return f"got      {a}\n   expected {b}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from clearroll import build_session

    sf = argv[0] if argv else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", shuffle_partitions=8, memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = oracle_sql()
    failed = 0
    for name, run in queries().items():
        wanted = [a for a in argv[1:] if not a.startswith("-")]
        if any(a[1:] in name for a in argv[1:] if a.startswith("-")) or (wanted and not any(a in name for a in wanted)):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        took = time.time() - start
        if problem:
            failed += 1
            print(f"FAIL {name} ({took:.1f}s): {problem}", flush=True)
        else:
            print(f"ok   {name} ({took:.1f}s){'' if name in sqls else ' [rows only]'}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
