"""Runs a registered query and its check SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(_cell(x) for x in v.values())
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    out = [tuple(_cell(c) for c in r) for r in zip(*cols)] if cols else []
    return names, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def _kind(t) -> str:
    s = str(t)
    return {"large_string": "string", "string_view": "string"}.get(s, s)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in columns, row count, values and types; empty when equal."""
    got, want = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    gn, gr = rows(got)
    wn, wr = rows(want)
    if gn != wn:
        return [f"columns {gn} != {wn}"]
    out = []
    if len(gr) != len(wr):
        out.append(f"rows {len(gr)} != {len(wr)}")
    if gr != wr:
        a, b = set(gr) - set(wr), set(wr) - set(gr)
        out.append(f"values: {len(a)} only here {list(a)[:2]}, {len(b)} only there {list(b)[:2]} cols={gn}")
    for n in gn:
        x, y = _kind(got.schema.field(n).type), _kind(want.schema.field(n).type)
        if x != y and not (x.startswith(("list", "struct")) and y.startswith(("list", "struct"))):
            out.append(f"type {n}: {x} != {y}")
    return out


def main(argv: list[str]) -> None:
    import sys
    import time

    from roamlens.plans import load
    from roamlens.session import get_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = get_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = load()
    for name, fn in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                diff = compare(df, con, oracles[name])
                note = "ok" if not diff else "DIFF " + " | ".join(d[:700] for d in diff)
            else:
                note = f"rows={df.count()} (no SQL)"
        except Exception as e:  # report and go on
            note = "ERR " + str(e).split("JVM stacktrace")[0][:900]
        print(f"{name:45s} {time.time() - t:6.2f}s {note}", flush=True)
    spark.stop()


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
