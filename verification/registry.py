"""Where every query registers itself, next to its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType

from jobtally.session import use_utc

DIGITS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None, rounded: str = ""):
    """Register the function under its name.

    ``covers`` lists the operators of the inventory it exercises, ``rounded`` the
    floating-point result columns, which both sides round before comparing.
    Dates are compared as text.
    """
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        name = fn.__name__

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _comparable(fn(use_utc(spark), sf_dir))

        QUERIES[name], COVERS[name] = run, covers
        if sql is not None:
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" for c in rounded.split())
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if replaced else sql
        return run

    return register


def _comparable(df: DataFrame) -> DataFrame:
    def shown(field):
        if isinstance(field.dataType, DoubleType) or isinstance(field.dataType, DecimalType) and field.dataType.scale:
            return F.round(F.col(field.name).cast("double"), DIGITS)
        return F.col(field.name).cast("string") if isinstance(field.dataType, DateType) else F.col(field.name)

    return df.select(*(shown(f).alias(f.name) for f in df.schema.fields))
