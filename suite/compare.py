"""Run queries and their SQL twins side by side: ``python -m suite.compare <sf_dir> [names…]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from suite.oracles import ORACLES
from suite.registry import QUERIES
from tillscope.session import local_session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([cell(r[i]) for i in order] for r in data), key=repr), [names[i] for i in order]


def compare(spark, sf: str, names: list[str]) -> dict[str, str]:
    out = {}
    for name in names:
        start = time.time()
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        try:
            df = QUERIES[name](spark, sf)
            got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
            if name not in ORACLES:
                out[name] = f"rows {len(got)}"
            else:
                rel = con.execute(ORACLES[name])
                want, wcols = rows([d[0] for d in rel.description], rel.fetchall())
                kinds = dict(df.dtypes), {d[0]: str(d[1]) for d in rel.description}
                if cols != wcols:
                    out[name] = f"COLUMNS {cols} vs {wcols}"
                elif got != want:
                    diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
                    out[name] = f"DIFF {len(got)} vs {len(want)} {cols} {diff}"
                else:
                    odd = [(c, kinds[0][c], kinds[1][c]) for c in cols if not _alike(kinds[0][c], kinds[1][c])]
                    out[name] = f"ok {len(got)}" + (f" TYPES {odd}" if odd else "")
        except Exception as error:  # noqa: BLE001
            out[name] = f"ERROR {str(error)[:400]}"
        print(f"{name:32s} {time.time() - start:6.1f}s {out[name]}", flush=True)
    return out


def _alike(spark_type: str, other: str) -> bool:
    groups = {"bigint": ("BIGINT", "HUGEINT"), "int": ("INTEGER", "BIGINT"), "double": ("DOUBLE",), "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "BOOL"), "date": ("DATE",)}
    return other.upper() in groups.get(spark_type, (other.upper(),)) or other in ("NUMBER",)


if __name__ == "__main__":
    session = local_session(8)
    chosen = sys.argv[2:] or list(QUERIES)
    result = compare(session, sys.argv[1], chosen)
    bad = [n for n, r in result.items() if not r.startswith(("ok", "rows"))]
    print(f"{len(result)} run, {len(bad)} differ: {bad}")
