"""Large extracts in several passes: the same table, with the shuffles of one pass at a time on disk."""

import os
import random
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from jobtally import contract, passes, schemas as S, sinks
from jobtally.plans import extracts
from jobtally.session import shared_base, shared_folder, shuffles_freed
from jobtally.sources import jobs as source
from jobtally.sources.windows import TimeWindow
from verification.check import mismatch, oracle_connection

DAY_MS = 86_400_000
START = int(datetime.fromisoformat("2024-01-01T00:00:00+00:00").timestamp() * 1000)
SCHEMA = (f"{S.JOB_ID} STRING, {S.RECORD_TIME} LONG, {S.STATUS} STRING, {S.SITE} STRING, {S.TIER} STRING, {S.TASK} STRING, "
          f"{S.USER} STRING, {S.CPUS} LONG, {S.CPU_HR} DOUBLE")
WIDE = {"columns": None, "statuses": None}


def records(spark, n=4000, seed=3):
    """Jobs with several records, on one day or more, some equal, some without id, time or other values."""
    draw = random.Random(seed)
    some = lambda *v: draw.choice([None, *v])
    rows = [(None if draw.random() < 0.02 else f"job#{draw.randrange(n // 2)}",
             None if draw.random() < 0.02 else START + draw.randrange(9) * DAY_MS + draw.choice([0, 1, 7]),
             some("Completed", "Running"), some("T1", "T2"), some("RAW", ""), some("a", "b\0"), some("u"), some(-1, 8), some(0.5, -2.0)) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return Counter(map(repr, map(tuple, df.collect())))


def files(path):
    """Files of every day, and whether the mark of success is there."""
    below = Path(path.removeprefix("file:"))
    return {d.name: len(list(d.glob("part-*"))) for d in below.iterdir() if d.is_dir()}, (below / "_SUCCESS").exists()


def cleaned_folders(spark):
    return [p for p in os.listdir(shared_base(spark).removeprefix("file:")) if p.startswith("cleaned-")]


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("options", [{"once": True, **WIDE}, {"once": False, **WIDE}, {"once": True, "columns": [S.STATUS, S.SITE]}], ids=str)
def test_extract_in_passes_is_that_of_one_job(spark, options):
    jobs = records(spark)
    one, many = shared_folder(spark, "one"), shared_folder(spark, "many")
    extracts.write_clean_extract(jobs, one, passes=1, **options)
    extracts.write_clean_extract(jobs, many, passes=3, **options)
    expected, got = source.read_extract(spark, one), source.read_extract(spark, many)
    assert got.schema == expected.schema and contract.contract_of(got) == contract.contract_of(expected) is not None
    assert content(got) == content(expected)
    assert files(many) == files(one)
    assert cleaned_folders(spark) == []


def test_large_extract_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    """All records went through two shuffles in one job, whose files then stayed."""
    records(spark).write.parquet(str(tmp_path / "records"))
    jobs = spark.read.parquet(str(tmp_path / "records"))
    monkeypatch.setattr(passes, "PASS_BYTES", passes.input_bytes(jobs) // 4 + 1)
    begun, parts = [], sinks.write_parts
    monkeypatch.setattr(sinks, "write_parts", lambda df, *more: (begun.append(df), parts(df, *more)))
    before = shuffle_files(spark)
    extracts.write_clean_extract(jobs, shared_folder(spark, "large"), once=True, **WIDE)
    assert len(begun) == 4
    until = time.time() + 30
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_every_pass_has_a_part_of_the_jobs(spark, monkeypatch):
    seen, parts = [], sinks.write_parts
    monkeypatch.setattr(sinks, "write_parts", lambda df, *more: (seen.append({r[0] for r in df.select(S.JOB_ID).collect()}), parts(df, *more)))
    jobs = records(spark)
    extracts.write_clean_extract(jobs, shared_folder(spark, "parts"), passes=4, once=True, **WIDE)
    ids = {r[0] for r in jobs.select(S.JOB_ID).collect()}
    assert sum(map(len, seen)) == len(ids) and set().union(*seen) == ids
    assert max(map(len, seen)) < len(ids) / 3


def test_passes_replace_their_days_only(spark):
    path, jobs = shared_folder(spark, "renewed"), records(spark).where(F.col(S.RECORD_TIME).isNotNull())
    window = TimeWindow(datetime(2024, 1, 3), datetime(2024, 1, 6))
    extracts.write_clean_extract(jobs, path, passes=2, **WIDE)
    was = content(source.read_extract(spark, path))
    other = jobs.withColumn(S.SITE, F.lit("new"))
    extracts.write_clean_extract(other, path, replace=True, passes=3, window=window, **WIDE)
    now = source.read_extract(spark, path)
    assert content(now.where(~window.contains())) == content(extracts.clean_extract(jobs, **WIDE).where(~window.contains()))
    assert content(now.where(window.contains())) == content(extracts.clean_extract(other, window=window, **WIDE))
    assert content(now) != was


def test_a_table_that_exists_is_refused_and_a_failed_one_taken_back(spark, monkeypatch):
    path, jobs = shared_folder(spark, "refused"), records(spark, 200)
    write, calls = sinks.write_by, []

    def failing(*args, **named):
        if calls:
            raise OSError("disk")
        calls.append(1)
        write(*args, **named)

    monkeypatch.setattr(sinks, "write_by", failing)
    with pytest.raises(OSError):
        extracts.write_clean_extract(jobs, path, passes=3, **WIDE)
    assert calls and not sinks.exists(spark, path) and cleaned_folders(spark) == []
    monkeypatch.undo()
    extracts.write_clean_extract(jobs, path, passes=3, **WIDE)
    was = content(source.read_extract(spark, path))
    with pytest.raises(AnalysisException):
        extracts.write_clean_extract(jobs, path, passes=3, **WIDE)
    assert content(source.read_extract(spark, path)) == was


def test_no_records_give_an_empty_table(spark):
    path = shared_folder(spark, "none")
    extracts.write_clean_extract(records(spark, 50).limit(0), path, passes=2, **WIDE)
    assert files(path) == ({}, True)


def test_passes_follow_from_the_files_read(spark, tmp_path, monkeypatch):
    records(spark).write.parquet(str(tmp_path / "p"))
    records(spark).write.json(str(tmp_path / "j"))
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).glob("part-*")) for k in "pj"}
    columns, lines = spark.read.parquet(str(tmp_path / "p")), spark.read.schema(SCHEMA).json(str(tmp_path / "j"))
    assert passes.input_bytes(columns) == 8 * size["p"] and passes.input_bytes(lines) == size["j"]
    assert passes.input_bytes(columns.join(lines, S.JOB_ID)) == 8 * size["p"] + size["j"]
    assert passes.needed(spark.createDataFrame([("a",)], "a STRING")) == passes.needed(lines) == 1
    monkeypatch.setattr(passes, "PASS_BYTES", 100)
    assert passes.needed(lines) == passes.MOST


def test_the_option_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
        1 / 0
    assert spark.conf.get(name) == before


def test_a_query_of_a_wide_extract_in_passes_matches_its_oracle(spark, sf_dir, monkeypatch):
    name = "dataset_popularity_from_wide_extract"
    monkeypatch.setattr(passes, "PASS_BYTES", 1)
    monkeypatch.setattr(passes, "MOST", 2)
    begun, parts = [], sinks.write_parts
    monkeypatch.setattr(sinks, "write_parts", lambda df, *more: (begun.append(df), parts(df, *more)))
    assert mismatch(queries()[name](spark, sf_dir), oracle_connection(sf_dir), oracle_sql()[name]) is None
    assert len(begun) == 2
