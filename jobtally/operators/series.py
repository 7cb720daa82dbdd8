"""Chart series over the hours of a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtally import schemas as S


def all_hours(spark: SparkSession) -> DataFrame:
    """hour 0-23."""
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def align_hours(hourly: DataFrame, value: str, by: str = S.INPUT_DATA,
                names: Sequence[str] = (S.ONSITE, S.OFFSITE)) -> DataFrame:
    """One row per hour of day and one column per series; hours without jobs are NULL."""
    wide = hourly.groupBy("hour").pivot(by, list(names)).agg(F.first(value))
    return all_hours(hourly.sparkSession).join(wide, "hour", "left")


def with_mean_lines(wide: DataFrame, names: Sequence[str] = (S.ONSITE, S.OFFSITE)) -> DataFrame:
    """Add the constant line ``mean_<name>``: the plain mean of the hourly values.

    This is not the efficiency of the whole day, which weighs hours by their jobs.
    """
    means = wide.agg(F.struct(*(F.avg(n).alias(n) for n in names)).alias("means")).scalar()
    return wide.withColumns({f"mean_{n}": means[n] for n in names})
