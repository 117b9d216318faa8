"""Side-by-side comparison of the registered queries with DuckDB.

    python tests/check.py SF_DIR [name-part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(_cell(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(_cell(x) for x in v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v))
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = cur.fetchall()
    return [names[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql):
    """Empty string when equal, else what differs."""
    sn, sr = rows_of_spark(df)
    dn, dr = rows_of_duck(con, sql)
    if sn != dn:
        return f"columns {sn} vs {dn}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    return f"{len(bad)} of {len(sr)} rows differ, e.g. {sn}\n   {bad[0][0]}\n   {bad[0][1]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry
    from trackweave.session import build_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.log.level": "OFF"})
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                told = compare(df, con, sqls[name])
                verdict = "ok" if not told else "DIFF " + told
                n = df.count() if told else len(rows_of_duck(con, sqls[name])[1])
            else:
                n = len(df.collect())
                verdict = "rows-only"
        except Exception as error:  # noqa: BLE001
            n, verdict = -1, "ERROR " + str(error)[:1500]
        failed += verdict[:2] not in ("ok", "ro")
        print(f"{time.time() - start:6.1f}s {n:7d} {name}: {verdict}", flush=True)
    print("failed:", failed)
    spark.stop()
    sys.exit(failed > 0)


if __name__ == "__main__":
    main()
