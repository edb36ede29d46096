"""Runs a registered query and its SQL statement on the same tables and compares all values."""

from __future__ import annotations

import duckdb
import pandas as pd

from flightframe.catalog.views import TABLES


def engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _text(value) -> str:
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return "[" + ",".join(_text(v) for v in value) + "]"
    if value is None or value is pd.NA or (isinstance(value, float) and value != value) or value is pd.NaT:
        return "~"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        number = float(value)
        return repr(0.0 if number == 0 else number)
    return str(value)


def tidy(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).itertuples(index=False, name=None)
    return sorted(tuple(_text(v) for v in row) for row in rows)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    a, b = tidy(spark_rows), tidy(sql_rows)
    if a == b:
        return None
    in_a, in_b = set(a), set(b)
    left, right = [r for r in a if r not in in_b], [r for r in b if r not in in_a]
    return f"{len(a)} rows vs {len(b)}; {len(left)} only in spark {left[:2]}; {len(right)} only in sql {right[:2]}"
