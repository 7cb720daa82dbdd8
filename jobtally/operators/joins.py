"""Lookups that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000
MOST_HOT = 50_000


def key_counts(rows: DataFrame, keys: Sequence[str], name: str = "__n") -> DataFrame:
    """How many rows each key has; every task sends one row per key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def hot_keys(counts: DataFrame, keys: Sequence[str], size: str = "__n", hot_rows: int = HOT_ROWS,
             most_hot: int = MOST_HOT) -> DataFrame:
    """(keys, __parts) of the keys with more than ``hot_rows`` rows: how many tasks share the rows of each.

    A key also needs more than one part in ``most_hot`` of all rows, so there are never as many as ``most_hot``
    hot keys, whatever the data: this is the size bound of the broadcast in :func:`split_lookup`.
    """
    total = counts.agg(F.sum(size).alias("total")).scalar()
    least = F.greatest(F.lit(hot_rows).cast("double"), total / F.lit(most_hot))
    parts = F.ceil(F.col(size) / least).cast("int")
    return counts.where(F.col(size) > least).select(*keys, parts.alias("__parts"))


def split_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], size: str | None = None, how: str = "left",
                 hot_rows: int = HOT_ROWS, most_hot: int = MOST_HOT) -> DataFrame:
    """Add the other columns of ``lookup``, which has one row per key, to ``rows``. A NULL key finds the row of the NULL key.

    Only keys found hot are split: their rows are dealt to several tasks by a hash of the whole row, and their lookup
    row is repeated as often. All other keys keep one lookup row and an ordinary join. How many rows a key has is
    counted, or read from the column ``size`` of the lookup, which is not part of the result then.
    """
    counts = key_counts(rows, keys) if size is None else lookup.select(*keys, F.col(size).alias("__n"))
    # Small by the bound of hot_keys, so every task may hold it.
    hot = F.broadcast(_renamed(hot_keys(counts, keys, "__n", hot_rows, most_hot), keys, "__hot"))

    def marked(side: DataFrame) -> DataFrame:
        return side.join(hot, _same(keys, "__hot"), "left").select(*side.columns, F.coalesce("__parts", F.lit(1)).alias("__parts"))

    simple = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    dealt = marked(rows).withColumn("__part", F.pmod(F.xxhash64(*simple), F.col("__parts")).cast("int"))
    keep = [c for c in lookup.columns if c not in (*rows.columns, size)]
    copies = marked(lookup.select(*keys, *keep)).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    copies = _renamed(copies.drop("__parts"), keys, "__of")
    return dealt.join(copies, _same(keys, "__of") & (F.col("__part") == F.col("__copy")), how).select(*rows.columns, *keep)


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{i}" for i, k in enumerate(keys)})


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)))
