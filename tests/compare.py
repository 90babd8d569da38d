"""Row-for-row comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "text"
    return str(t)


def _rows(table: pa.Table, columns: list[str]) -> list[tuple]:
    data = [table.column(c).to_pylist() for c in columns]
    return sorted(zip(*data, strict=True), key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    columns = sorted(spark_table.column_names)
    if columns != sorted(sql_table.column_names):
        return [f"columns {columns} against {sorted(sql_table.column_names)}"]
    out = []
    for c in columns:
        a, b = _kind(spark_table.schema.field(c).type), _kind(sql_table.schema.field(c).type)
        if a != b:
            out.append(f"type of {c}: {a} against {b}")
    if spark_table.num_rows != sql_table.num_rows:
        return [*out, f"{spark_table.num_rows} rows against {sql_table.num_rows}"]
    left, right = _rows(spark_table, columns), _rows(sql_table, columns)
    wrong = [(x, y) for x, y in zip(left, right, strict=True) if x != y]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {columns}: {wrong[0][0]} against {wrong[0][1]}")
    return out
