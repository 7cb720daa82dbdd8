"""Work on large tables in several passes, so that the shuffles of one pass at a time are on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PASS_BYTES = 1 << 30  # of rows as text, for each pass
MOST = 8  # every pass reads its input again
COLUMNAR = {"parquet": 8, "orc": 8}  # rows as text are about so many times larger


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as text. Inputs of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    unknown = df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    total = 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        size = int(str(leaf.stats().sizeInBytes()))
        if size < unknown:
            kind = leaf.relation().toString().lower() if leaf.nodeName() == "LogicalRelation" else ""
            total += size * COLUMNAR.get(kind, 1)
    return total


def needed(df: DataFrame) -> int:
    """Passes for the input of ``df``: one for small ones, ``MOST`` at most."""
    return max(1, min(MOST, -(-input_bytes(df) // PASS_BYTES)))


def number(key: Column | str, count: int) -> Column:
    """The pass of a key, from 0; all rows of a key are in one pass, NULL is a key too."""
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
