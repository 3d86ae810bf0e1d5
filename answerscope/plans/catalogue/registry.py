"""Where queries and their SQL equivalents are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, signed: tuple[str, ...] = ()):
    """Register ``fn(spark, folder)``; ``sql`` is the same query for another engine.

    ``signed``: result columns in which -0.0 may turn up and is made 0.0.
    """
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if not signed else (
                f"SELECT * REPLACE ({', '.join(f'{c} + 0.0::DOUBLE AS {c}' for c in signed)}) FROM ({sql})")
        return fn

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round result columns, since two engines add doubles in different orders."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def long_of(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]
