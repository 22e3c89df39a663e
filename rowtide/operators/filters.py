"""Which tables and events pass; predicates that are placed before the decoding of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed(include_databases: list[str] = (), include_tables: list[str] = (), exclude_tables: list[str] = ()) -> Column:
    """Databases first, then what is excluded, then what is included; empty lists allow all.

    A table is named ``database.table``, or by its own name for any database. Names are compared exactly.
    """
    full = F.concat_ws(".", "database", "table")
    ok = F.lit(True)
    if include_databases:
        ok &= F.col("database").isin(list(include_databases))
    if exclude_tables:
        ok &= ~(full.isin(list(exclude_tables)) | F.col("table").isin(list(exclude_tables)))
    if include_tables:
        ok &= full.isin(list(include_tables)) | F.col("table").isin(list(include_tables))
    return ok


def matching(found: DataFrame, tables: DataFrame, exclude: bool = False) -> DataFrame:
    """Rows whose table is listed (or isn't) in a frame (database, table), which may change between runs."""
    return found.join(tables.select("database", "table").distinct(), ["database", "table"], "left_anti" if exclude else "left_semi")
