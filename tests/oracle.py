"""Run a registered query and its oracle, compare rows regardless of order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and an oracle, empty when equal."""
    names = sorted(df.columns)
    result = con.execute(sql)
    oracle_names = [c[0] for c in result.description]
    if sorted(oracle_names) != names:
        return [f"columns {names} vs {sorted(oracle_names)}"]
    order = [oracle_names.index(n) for n in names]
    expected = Counter(tuple(_cell(row[i]) for i in order) for row in result.fetchall())
    actual = Counter(tuple(_cell(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    if expected == actual:
        return [] if expected else ["both empty"]
    missing, extra = list((expected - actual).items())[:2], list((actual - expected).items())[:2]
    return [
        f"{sum(actual.values())} rows vs {sum(expected.values())}",
        f"columns {names}",
        f"missing {missing}",
        f"extra {extra}",
    ]
