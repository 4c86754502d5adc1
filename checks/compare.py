"""Run a query and its SQL side by side and compare schema and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def kind(name: str) -> str:
    """Type families that both engines share."""
    name = name.lower()
    return {"varchar": "string", "integer": "int", "timestamp": "timestamp_ntz"}.get(name, name)


def _key(row):
    return tuple((v is not None, repr(round(v, 9)) if isinstance(v, float) else str(v)) for v in row)


def same(a, b) -> bool:
    """Exact, but for the last bit of a double."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def mismatch(spark_df, con, statement: str) -> str | None:
    """None when both sides agree, else what differs."""
    result = con.execute(statement)
    theirs = {d[0]: i for i, d in enumerate(result.description)}
    types = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {statement}").fetchall()}
    rows = con.execute(statement).fetchall()
    names = sorted(spark_df.columns)
    if names != sorted(theirs):
        return f"columns {names} != {sorted(theirs)}"
    mine_types = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    if mine_types != types:
        return f"types {[(n, mine_types[n], types[n]) for n in names if mine_types[n] != types[n]]}"
    mine = sorted(([r[n] for n in names] for r in spark_df.collect()), key=_key)
    other = sorted(([r[theirs[n]] for n in names] for r in rows), key=_key)
    if len(mine) != len(other):
        return f"{len(mine)} rows != {len(other)}"
    for a, b in zip(mine, other):
        if not all(same(x, y) for x, y in zip(a, b)):
            return f"row {dict(zip(names, a))} != {dict(zip(names, b))}"
    return None
