"""Catalogue dumps: CSV without header, ``null`` for NULL, abort on a bad row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from jobtally import schemas as S


def read_csv(spark: SparkSession, path: str, schema: StructType,
             columns: Sequence[str] | None = None) -> DataFrame:
    """A dump read with its declared schema; ``path`` may be a folder of parts.

    Only the selected columns are parsed, so a bad value elsewhere goes unnoticed.
    """
    df = (spark.read.format("csv").option("nullValue", "null").option("mode", "FAILFAST")
          .schema(schema).load(path))
    return df.select(*columns) if columns else df


def read_files(spark: SparkSession, path: str, schema: StructType = S.FILES_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema, [S.FILE_NAME, S.FILE_SIZE, S.FILE_DATASET_ID, S.FILE_BLOCK_ID])


def read_datasets(spark: SparkSession, path: str, schema: StructType = S.DATASETS_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema, [S.DATASET_ID, S.DATASET_NAME])


def read_blocks(spark: SparkSession, path: str, schema: StructType = S.BLOCKS_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema, [S.BLOCK_NAME, S.BLOCK_BYTES])
