"""Dataset and block sizes, and how job records use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobtally import schemas as S
from jobtally.operators import topk
from jobtally.operators.exact import sum_of_sums
from jobtally.operators.joins import split_lookup


def _size_by_id(files: DataFrame) -> DataFrame:
    """Bytes per dataset id. Summing before any join keeps file rows off the network."""
    return files.groupBy(S.FILE_DATASET_ID).agg(F.sum(S.FILE_SIZE).alias(S.DATASET_SIZE))


def dataset_sizes(datasets: DataFrame, files: DataFrame) -> DataFrame:
    """(d_dataset, Dataset_Size) of every dataset; one without files has a NULL size."""
    sizes = _size_by_id(files)
    joined = datasets.join(sizes, datasets[S.DATASET_ID] == sizes[S.FILE_DATASET_ID], "left")
    return joined.groupBy(S.DATASET_NAME).agg(F.sum(S.DATASET_SIZE).alias(S.DATASET_SIZE))


def file_sizes(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset, sum_file_size) of all files; files of no known dataset form a NULL group."""
    sizes = _size_by_id(files)
    joined = sizes.join(datasets, sizes[S.FILE_DATASET_ID] == datasets[S.DATASET_ID], "left")
    return joined.groupBy(F.col(S.DATASET_NAME).alias("dataset")).agg(
        F.sum(S.DATASET_SIZE).alias("sum_file_size"))


def block_sizes(blocks: DataFrame) -> DataFrame:
    """(b_block_name, Block_Size)."""
    return blocks.select(S.BLOCK_NAME, S.BLOCK_BYTES).withColumnRenamed(S.BLOCK_BYTES, S.BLOCK_SIZE)


def popularity(usage: DataFrame, sizes: DataFrame) -> DataFrame:
    """Usage per dataset with its size; jobs without a dataset are left out.

    Both sides have one row per dataset, so no key can be hot here.
    """
    named = usage.where(F.col(S.DATASET).isNotNull())
    return named.join(sizes, named[S.DATASET] == sizes["dataset"], "left").drop("dataset")


def job_dataset_sizes(jobs: DataFrame, sizes: DataFrame, **split) -> DataFrame:
    """(dataset, size) with one row per job, as many as jobs with a dataset. ``split`` goes to :func:`split_lookup`."""
    named = jobs.where(F.col(S.DATASET).isNotNull())
    return split_lookup(named, sizes.withColumnRenamed("dataset", S.DATASET), [S.DATASET], **split)


def distinct_dataset_sizes(jobs: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """The same with one row per dataset and its number of jobs."""
    counts = jobs.where(F.col(S.DATASET).isNotNull()).groupBy(*keys, S.DATASET).agg(
        F.count(F.lit(1)).alias("jobs"))
    # A dataset has one row for each value of the keys here, so none can be hot.
    return counts.join(sizes, counts[S.DATASET] == sizes["dataset"], "left").drop("dataset")


def accesses(jobs: DataFrame, *keys: str) -> DataFrame:
    """First and last access per tier, dataset, block and task.

    One hash aggregation with a partial step: the many jobs of a block become a
    few rows before anything is shuffled. Dataset and block tables build on it.
    """
    return jobs.groupBy(*keys, S.TIER, S.DATASET, S.BLOCK, S.TASK).agg(
        F.min(S.RECORD_TIME).alias(S.FIRST_ACCESS), F.max(S.RECORD_TIME).alias(S.LAST_ACCESS))


def _earliest() -> Column:
    """The earliest access as one struct; the other columns settle equal times.

    It names every column of :func:`accesses`, so the result is fixed and both
    tables below read the same columns and share the shuffled job records.
    """
    return F.min(F.struct(S.FIRST_ACCESS, S.LAST_ACCESS, S.TIER, S.DATASET, S.BLOCK, S.TASK)).alias("e")


def active_datasets(access: DataFrame, *keys: str) -> DataFrame:
    """One row per accessed dataset with the tier of its earliest access."""
    return access.groupBy(*keys, S.DATASET).agg(_earliest()).select(
        *keys, F.col(f"e.{S.TIER}").alias(S.TIER), S.DATASET)


def active_blocks(access: DataFrame, *keys: str) -> DataFrame:
    """One row per accessed block: first and last access, dataset and task of the first."""
    return access.groupBy(*keys, S.BLOCK).agg(_earliest(), F.max(S.LAST_ACCESS).alias(S.LAST_ACCESS)).select(
        *keys, F.col(f"e.{S.DATASET}").alias(S.DATASET), S.BLOCK, F.col(f"e.{S.TASK}").alias(S.TASK),
        F.col(f"e.{S.FIRST_ACCESS}").alias(S.FIRST_ACCESS), S.LAST_ACCESS)


def with_block_access(jobs: DataFrame) -> DataFrame:
    """Every job row with the first and last access of its block (NULL is a block too).

    A window over the block would do, but would gather all jobs of a hot block, the
    Monte-Carlo marker say, in one task. So the two times are grouped, with a
    partial step, and looked up; their number of jobs, counted on the way, tells which
    blocks to split. For one row per block see :func:`active_blocks`.
    """
    span = jobs.groupBy(S.BLOCK).agg(F.min(S.RECORD_TIME).alias(S.FIRST_ACCESS), F.max(S.RECORD_TIME).alias(S.LAST_ACCESS),
                                     F.count(F.lit(1)).alias("__jobs"))
    return split_lookup(jobs, span, [S.BLOCK], size="__jobs")


def sized_datasets(active: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """Accessed datasets with their size; datasets the catalogue lacks drop out."""
    return active.join(sizes, active[S.DATASET] == sizes[S.DATASET_NAME]).select(
        *keys, S.TIER, S.DATASET, S.DATASET_SIZE)


def sized_blocks(active: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """Accessed blocks with their size; blocks the catalogue lacks drop out."""
    return active.join(sizes, active[S.BLOCK] == sizes[S.BLOCK_NAME]).select(
        *keys, S.DATASET, S.BLOCK, S.BLOCK_SIZE, S.TASK, S.FIRST_ACCESS, S.LAST_ACCESS)


def dataset_block_table(access: DataFrame, dataset_size: DataFrame, block_size: DataFrame,
                        *keys: str, salts: int = 8) -> DataFrame:
    """Accessed blocks with dataset, both sizes, task, first and last access.

    ``access`` is the result of :func:`accesses`. ``keys`` (the record date, say) makes one independent table per key value, all
    in the same job. A dataset can own very many blocks, so its blocks are spread.
    """
    datasets = sized_datasets(active_datasets(access, *keys), dataset_size, *keys)
    blocks = sized_blocks(active_blocks(access, *keys), block_size, *keys)
    on = [*keys, S.DATASET, "__salt"]
    datasets = datasets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    blocks = blocks.withColumn("__salt", F.pmod(F.xxhash64(S.BLOCK), F.lit(salts)).cast("int"))
    return datasets.join(blocks, on).select(
        *keys, S.TIER, S.DATASET, S.DATASET_SIZE, S.BLOCK, S.BLOCK_SIZE, S.TASK,
        S.FIRST_ACCESS, S.LAST_ACCESS)


def last_accessed_before(table: DataFrame, cutoff_ms: int) -> DataFrame:
    """Rows not used since ``cutoff_ms``: candidates for clean-up."""
    return table.where(F.col(S.LAST_ACCESS) < cutoff_ms)


def top_share(daily: DataFrame, k: int) -> DataFrame:
    """One row: CPU hours of the k most used datasets and their percent of all."""
    per_dataset = daily.groupBy(S.DATASET).agg(sum_of_sums("Sum_CpuTimeHr").alias("cpu_hr"))
    total = per_dataset.agg(sum_of_sums("cpu_hr").alias("total")).scalar()
    top = topk.top_rows(per_dataset, "cpu_hr", k, [S.DATASET])
    return top.agg(sum_of_sums("cpu_hr").alias("top_cpu_hr")).select(
        "top_cpu_hr", total.alias("all_cpu_hr"),
        F.try_divide(F.col("top_cpu_hr") * 100.0, total).alias("top_pct"))
