"""Daily parts that merge: what a day adds is kept as a few rows, and any window is answered from those.

Every part has one row for each day and key. Times merge by least and greatest, sums by adding, distinct counts and
quantiles by merging sketches. A part is made of a day's records alone (one record per job and day), so a run that
renews a day replaces that day's rows and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from jobtally import schemas as S
from jobtally.operators import catalogue
from jobtally.operators.exact import exact_sum, sum_of_sums

LG_USERS = 12  # 2^12 registers: counts are within 1.04 / 64, some 1.6 %, of the truth, one standard deviation
KLL_K = 200  # quantile ranks are within 1.65 % of the truth, at 99 % confidence
USERS_ERROR, RANK_ERROR = 0.05, 0.0165  # three standard deviations; the stated bound


def access_parts(cleaned: DataFrame) -> DataFrame:
    """First and last access per day, tier, dataset, block and task."""
    return catalogue.accesses(cleaned, S.RECORD_DATE)


def merged_accesses(parts: DataFrame, *keys: str) -> DataFrame:
    """The accesses of all days together; dataset and block tables build on them as on fresh ones."""
    return parts.groupBy(*keys, S.TIER, S.DATASET, S.BLOCK, S.TASK).agg(
        F.min(S.FIRST_ACCESS).alias(S.FIRST_ACCESS), F.max(S.LAST_ACCESS).alias(S.LAST_ACCESS))


def usage_parts(cleaned: DataFrame) -> DataFrame:
    """Jobs, exact CPU hours, and sketches of the users and workflows, per day and dataset."""
    return cleaned.groupBy(S.RECORD_DATE, S.DATASET).agg(
        F.count(F.lit(1)).alias("jobs"), exact_sum(S.CPU_HR).alias("sum_CpuTimeHr"),
        F.hll_sketch_agg(S.USER_NAME, F.lit(LG_USERS)).alias("users"), F.hll_sketch_agg(S.WORKFLOW, F.lit(LG_USERS)).alias("workflows"))


def merged_usage(parts: DataFrame, *keys: str | Column) -> DataFrame:
    """Jobs, CPU hours and estimated numbers of users and workflows per dataset, over all days of the parts."""
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    return parts.groupBy(*keys, S.DATASET).agg(
        F.sum("jobs").alias("jobs"), sum_of_sums("sum_CpuTimeHr").alias("sum_CpuTimeHr"),
        estimate("users").alias("distinct_CRAB_UserHN"), estimate("workflows").alias("distinct_Workflow"))


def profile_parts(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """Per day (or other keys) and column: count, mean, spread, least, greatest, and a sketch of the quantiles."""
    long = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(keys), list(columns), "measure", "value")
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "measure").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("squares"),
        F.min("value").alias("least"), F.max("value").alias("greatest"), F.kll_sketch_agg_double("value", F.lit(KLL_K)).alias("quantiles"))


def merged_profile(parts: DataFrame, *keys: str) -> DataFrame:
    """The profile of all parts together: count, mean, stddev, min, quartiles and max per column.

    Means and spreads are folded part by part, each against what came before it, which keeps the digits that a
    difference of two large sums would lose. There is one part a day, so the list is short.
    """
    def folded(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"),
                        (a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / n).alias("squares"))

    part = F.struct(F.col("n").cast("double").alias("n"), "mean", "squares")
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    both = parts.groupBy(*keys, "measure").agg(
        F.sum("n").alias("count"), F.sort_array(F.collect_list(part)).alias("parts"), F.min("least").alias("min"),
        F.max("greatest").alias("max"), F.kll_merge_agg_double("quantiles").alias("q"))
    both = both.withColumn("m", F.aggregate("parts", start, folded))
    quartile = lambda at: F.kll_sketch_get_quantile_double("q", F.lit(at))
    return both.select(*keys, "measure", "count", F.col("m.mean").alias("mean"),
                       F.sqrt(F.try_divide(F.col("m.squares"), F.col("m.n") - 1)).alias("stddev"), "min",
                       quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), "max")
