"""Results that promise an order come in it. Each list is long enough not to be in order by chance."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from jobtally import schemas as S
from jobtally.operators import aggregates as A, topk
from jobtally.plans import extracts, popularity, usage
from verification import bindings as B, popularity as P


@pytest.fixture(scope="module")
def jobs(spark, sf_dir):
    """Job records with many tiers, classes and codes."""
    wide = B.jobs(spark, sf_dir)
    return wide.withColumn(S.TIER, F.concat(F.lit("tier"), F.xxhash64(S.JOB_ID) % 40)).withColumn(
        S.EXIT_CODE, F.when(F.xxhash64(S.JOB_ID) % 3 != 0, F.abs(F.xxhash64(S.JOB_ID) % 50) * 7)).withColumn(
        S.RECORD_TIME, F.col(S.RECORD_TIME) + F.abs(F.xxhash64(S.JOB_ID) % 24) * 3_600_000).cache()


def nulls_first(value):
    return value is not None, value


def in_order(got, *keys):
    assert len(got) > 8
    return got == sorted(got, key=lambda r: tuple(k(r) for k in keys))


def test_tiers_by_wall_hours(jobs):
    assert in_order(usage.tier_hours(jobs).collect(), lambda r: nulls_first(r[A.SUM_WALL]), lambda r: r[S.TIER])


def test_folded_tiers_end_with_others(jobs):
    got = usage.tier_shares(jobs, below=1.2).collect()
    assert in_order(got, lambda r: r.is_others, lambda r: r.percent, lambda r: r.label) and got[-1].is_others


def test_hours_of_the_day(jobs):
    assert in_order(usage.hourly_efficiency(jobs).collect(), lambda r: r.hour, lambda r: nulls_first(r[S.INPUT_DATA]))
    assert in_order(usage.efficiency_series(jobs).collect(), lambda r: r.hour)


def test_exit_code_detail_in_time_order(jobs):
    assert in_order(usage.exit_code_detail(jobs).collect(), lambda r: r[S.RECORD_TIME], lambda r: r[S.JOB_ID])


def test_exit_codes_by_share(jobs):
    assert in_order(usage.exit_code_shares(jobs).collect(), lambda r: r.is_others, lambda r: -r.percent, lambda r: r.label)


def test_failures_by_number(jobs):
    assert in_order(usage.failure_reasons(jobs).collect(), lambda r: r["count_ExitCode"], lambda r: r[S.EXIT_CODE])


def test_datasets_by_workflows(jobs, spark, sf_dir):
    popular = popularity.dataset_popularity(jobs, P.sizes_by_file(spark, sf_dir))
    assert in_order(popularity.most_used_first(popular).collect(), lambda r: -r.distinct_Workflow, lambda r: r[S.DATASET])


def test_blocks_by_dataset_size(jobs, spark, sf_dir):
    table = extracts.largest_dataset_blocks(jobs, P.sizes_by_dataset(spark, sf_dir), P.sizes_by_block(spark, sf_dir))
    assert in_order(table.collect(), lambda r: (r[S.DATASET_SIZE] is None, -(r[S.DATASET_SIZE] or 0)), lambda r: r[S.DATASET], lambda r: r[S.BLOCK])


def test_largest_first_and_top_rows(spark):
    df = spark.createDataFrame([(i * 37 % 101 if i % 10 else None, f"n{i % 50}", i) for i in range(200)], "v INT, name STRING, i INT").repartition(7)
    order = [lambda r: (r.v is None, -(r.v or 0)), lambda r: r.name, lambda r: r.i]
    everything = topk.largest_first(df, "v", ["name", "i"]).collect()
    assert in_order(everything, *order)
    assert rows(topk.top_rows(df, "v", 20, ["name", "i"])) == [tuple(r) for r in everything[:20]]
