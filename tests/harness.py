"""Compare queries with their SQL in DuckDB, the way the driver does (sorted columns, any row order)."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{value:.6g}" if value != int(value) else str(int(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def compare(spark, con, name, query, sql, sf_dir):
    started = time.time()
    frame = query(spark, sf_dir)
    rows = frame.collect()
    mid = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    ended = time.time()
    columns = sorted(frame.columns)
    problems = []
    if columns != sorted(names):
        problems.append(f"columns {columns} <> {sorted(names)}")
        return len(rows), len(expected), problems, mid - started, ended - mid
    left = sorted(tuple(_norm(r[c]) for c in columns) for r in rows)
    order = [names.index(c) for c in columns]
    right = sorted(tuple(_norm(r[i]) for i in order) for r in expected)
    if left != right:
        from collections import Counter

        a, b = Counter(left), Counter(right)
        problems.append(f"columns {columns}; only spark {list((a - b).items())[:3]}; only duckdb {list((b - a).items())[:3]}")
    return len(rows), len(expected), problems, mid - started, ended - mid


if __name__ == "__main__":
    import __spark_entry__ as entry
    from hushmark.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    directory = f"/root/testdata/sf{scale}"
    session = local_session()
    connection = connect(directory)
    todo, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, query in todo.items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        try:
            if key in oracle:
                n, m, problems, t1, t2 = compare(session, connection, key, query, oracle[key], directory)
            else:
                t0 = time.time()
                n, m, problems, t1, t2 = len(query(session, directory).collect()), "-", [], time.time() - t0, 0
        except Exception as error:  # noqa: BLE001
            n, m, problems, t1, t2 = -1, -1, [str(error)[:1500]], 0, 0
        flag = "ok " if not problems and n else ("EMPTY" if not problems else "BAD")
        bad += flag != "ok "
        print(f"{flag} {key:28s} spark={n} duck={m} {t1:.2f}s {t2:.2f}s", *problems, flush=True)
    print("bad:", bad)
