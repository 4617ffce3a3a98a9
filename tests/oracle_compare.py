"""Compare a Spark result with its SQL twin: names, kinds and values, in any row order."""

import datetime as dt
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0.0 and math.copysign(1, value) < 0:
        return "-0.0"
    return value


def _order(row):
    return [(v is None, type(v).__name__, v if v is not None else 0) for v in row]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_order)


def differences(frame, con, sql: str) -> list[str]:
    found = con.execute(sql)
    names, expected = rows_of([d[0] for d in found.description], found.fetchall())
    mine, actual = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if mine != names:
        return [f"columns {mine} are not {names}"]
    out = [] if len(actual) == len(expected) else [f"{len(actual)} rows, not {len(expected)}"]
    for a, e in zip(actual, expected):
        kinds = [(type(x), type(y)) for x, y in zip(a, e) if x is not None and y is not None]
        if a != e or any(k[0] is not k[1] for k in kinds):
            out.append(f"{a} is not {e}")
        if len(out) > 3:
            break
    return out
