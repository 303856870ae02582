"""Runs registered queries against their SQL in DuckDB and compares the values."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return type(v).__name__
    if isinstance(v, dt.datetime):
        return "timestamp"
    if isinstance(v, dt.date):
        return "date"
    return type(v).__name__


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(r[i] for i in order) for r in rows]
    out.sort(key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))
    return [names[i] for i in order], out


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else the first difference."""
    got = _table(list(spark_df.columns), [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = _table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    if not got[1]:
        return "no rows on either side"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w or [_kind(x) for x in g] != [_kind(x) for x in w]]
    if bad:
        g, w = bad[0]
        cols = [(n, a, b) for n, a, b in zip(got[0], g, w) if a != b or _kind(a) != _kind(b)]
        return f"{len(bad)} of {len(got[1])} rows differ, first {cols[:4]} in {g[:6]}"
    return None


def main(argv: list[str]) -> int:
    from tabloom.plans import registry
    from tabloom.session import local_session

    sf = argv[0]
    wanted = argv[1:]
    registry.load_all()
    spark = local_session(8, "compare")
    con = connect(sf)
    failed = 0
    for name, fn in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in registry.ORACLES:
                why = difference(df, con, registry.ORACLES[name])
                note = "ok" if why is None else f"DIFF {why}"
            else:
                n = len(df.collect())
                note = f"rows {n}" if n else "DIFF no rows"
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        if note.startswith(("DIFF", "ERROR")):
            failed += 1
        print(f"{name:45s} {time.time() - t:6.2f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
