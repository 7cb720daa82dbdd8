"""Stored tables: contracts, the archive, daily runs, mergeable parts, counted reads and exact sums."""

import json
import random
import re
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import executed_plan, rows
from jobtally import contract, schemas as S, sinks
from jobtally.operators import aggregates as A, catalogue, clean, exact, hierarchy, state, topk
from jobtally.plans import archive, daily, extracts, popularity, usage
from jobtally.session import shared_folder
from jobtally.sources import jobs as source
from jobtally.sources.windows import DAY_MS, TimeWindow
from verification import bindings as B, popularity as P

DAY_0 = date(2022, 5, 1)
START = TimeWindow(datetime(2022, 5, 1), datetime(2022, 5, 2)).start_ms


# --- contracts ------------------------------------------------------------------

def extract(spark, sf_dir, **options):
    path = shared_folder(spark, "extract")
    extracts.write_clean_extract(B.events_as_jobs(spark, sf_dir, *S.EXTRACT_COLUMNS), path, **options)
    return source.read_extract(spark, path)


def test_an_extract_says_what_it_holds(spark, sf_dir):
    once, per_day = extract(spark, sf_dir, once=True), extract(spark, sf_dir)
    assert contract.contract_of(once) == contract.Contract(contract.ONE_PER_JOB, S.FINAL_STATUSES)
    assert contract.contract_of(per_day).grain == contract.ONE_PER_JOB_AND_DAY
    narrowed = once.where(F.col(S.TIER) == "RAW").select(S.JOB_ID, S.RECORD_TIME, S.STATUS)
    assert contract.contract_of(narrowed) == contract.contract_of(once)
    assert contract.contract_of(B.events_as_jobs(spark, sf_dir)) is None


def test_already_clean_is_refused_where_it_is_not(spark, sf_dir):
    per_day, once = extract(spark, sf_dir), extract(spark, sf_dir, once=True)
    with pytest.raises(ValueError, match="one record per job and day"):
        usage.tier_hours(per_day, already_clean=True)
    with pytest.raises(ValueError, match="one record per job and day"):
        extracts.period_dataset_sizes(per_day, None, already_clean=True)
    assert clean.clean_jobs(per_day, [S.TIER], per_day=True, already_clean=True).count() == per_day.count()
    usage.tier_hours(once, already_clean=True)
    done = extract(spark, sf_dir, once=True, statuses=["Completed"])
    with pytest.raises(ValueError, match="without records of status Error, Held, Removed"):
        usage.tier_hours(done, already_clean=True)
    usage.tier_hours(done, statuses=["Completed"], already_clean=True)


def test_every_analysis_runs_from_one_wide_extract_without_a_shuffle_by_job(spark, sf_dir):
    path = shared_folder(spark, "wide")
    extracts.write_clean_extract(B.jobs(spark, sf_dir).where(F.col(S.RECORD_TIME) % (7 * DAY_MS) == 0), path, once=True, columns=None, statuses=None)
    wide = source.read_extract(spark, path)
    sizes = P.sizes_by_file(spark, sf_dir)
    analyses = [
        usage.tier_hours(wide, already_clean=True), usage.tier_shares(wide, already_clean=True), usage.type_hours(wide, already_clean=True),
        usage.mc_hours(wide, already_clean=True), usage.hourly_efficiency(wide, already_clean=True), usage.efficiency_series(wide, already_clean=True),
        usage.analysis_success(wide, already_clean=True), usage.exit_code_detail(wide, already_clean=True),
        usage.exit_code_shares(wide, already_clean=True), usage.failure_reasons(wide, already_clean=True),
        usage.failures_over_time(wide, already_clean=True), usage.rates_by_dimension(wide, already_clean=True),
        popularity.daily_cpu(wide, already_clean=True), popularity.daily_top(wide, already_clean=True),
        popularity.usage_hierarchy(wide, "all", already_clean=True), popularity.dataset_popularity(wide, sizes, already_clean=True),
        extracts.dataset_blocks(wide, P.sizes_by_dataset(spark, sf_dir), P.sizes_by_block(spark, sf_dir), already_clean=True),
        extracts.period_dataset_sizes(wide, sizes, already_clean=True, distinct_datasets=True),
    ]
    for df in analyses:
        plan = executed_plan(df)
        assert not re.search(rf"hashpartitioning\([^)]*{S.JOB_ID}", plan)


def test_replace_needs_the_window(spark, sf_dir):
    records = B.events_as_jobs(spark, sf_dir, *S.EXTRACT_COLUMNS)
    path = shared_folder(spark, "extract")
    extracts.write_clean_extract(records, path)
    before = spark.read.parquet(path).count()
    part = TimeWindow(datetime(2024, 1, 5), datetime(2024, 1, 5, 12))
    with pytest.raises(ValueError, match="replace needs the window"):
        extracts.write_clean_extract(records.where(part.contains()), path, replace=True)
    with pytest.raises(ValueError, match="replace needs the window"):
        extracts.write_daily_dataset_blocks(records, None, None, path, replace=True)
    assert spark.read.parquet(path).count() == before
    extracts.write_clean_extract(records, path, replace=True, window=TimeWindow(datetime(2024, 1, 5), datetime(2024, 1, 6)))
    assert spark.read.parquet(path).count() == before


# --- the archive -----------------------------------------------------------------

def job_frame(spark, data):
    return spark.createDataFrame(data, f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT, {S.STATUS} STRING, {S.WALL_HR} DOUBLE")


@pytest.fixture
def archived(spark):
    name = f"archive_{random.randrange(10**12)}"
    first = job_frame(spark, [(f"j{i}", START + i, "Running" if i % 3 else "Held", float(i)) for i in range(60)] + [(None, START, "Held", 1.0)] * 5)
    archive.create(first, name, shared_folder(spark, name), buckets=4)
    later = job_frame(spark, [(f"j{i}", START + DAY_MS + i, "Completed", i + 0.5) for i in range(0, 60, 2)] + [(None, START + 7, "Error", 2.0)])
    archive.append(later, name)
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_archived_jobs_need_no_shuffle_by_id(spark, archived):
    assert archive.buckets_of(spark, archived) == 4
    df = clean.clean_jobs(archive.read(spark, archived), [S.STATUS, S.WALL_HR])
    plan = executed_plan(df)
    assert "Exchange" not in plan and "Bucketed: true" in plan
    expected = {f"j{i}": "Completed" if i % 2 == 0 else "Held" for i in range(60) if i % 2 == 0 or i % 3 == 0} | {None: "Error"}
    assert {r[S.JOB_ID]: r[S.STATUS] for r in df.collect()} == expected


def test_two_archives_are_joined_where_they_lie(spark, archived):
    other = f"{archived}_b"
    archive.create(job_frame(spark, [(f"j{i}", START, "Held", 9.0) for i in range(0, 90, 3)]), other, shared_folder(spark, other), buckets=4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        wanted = archive.read(spark, other).select(S.JOB_ID)
        found = archive.look_up(spark, archived, wanted, [S.STATUS])
        assert "Exchange" not in executed_plan(found)
        assert {r[S.JOB_ID]: r[S.STATUS] for r in found.collect()} == {
            f"j{i}": ("Completed" if i % 2 == 0 else "Held") if i < 60 else None for i in range(0, 90, 3)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {other}")


def test_an_archive_is_read_by_window(spark, archived):
    day = TimeWindow(datetime(2022, 5, 2), datetime(2022, 5, 3))
    plan = executed_plan(archive.read(spark, archived, day))
    assert re.search(r"PartitionFilters: \[[^\]]*record_date", plan)
    assert archive.read(spark, archived, day).count() == 30
    assert archive.read(spark, archived, TimeWindow(datetime(2022, 5, 2), datetime(2022, 5, 2))).count() == 0
    with pytest.raises(ValueError):  # several records a job
        clean.clean_jobs(archive.read(spark, archived), [S.STATUS], already_clean=True)
    with pytest.raises(AnalysisException):
        archive.create(job_frame(spark, []), archived)


# --- daily runs --------------------------------------------------------------------

def put(base, day, name, *records):
    path = base / f"{day:%Y/%m/%d}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("".join(json.dumps({"data": r}) + "\n" for r in records))


def job(name, day, ms=0, status="Completed", **more):
    return {S.JOB_ID: name, S.RECORD_TIME: START + day * DAY_MS + ms, S.STATUS: status, S.WALL_HR: 1.0, **more}


def days(first, last):
    return TimeWindow(datetime(2022, 5, first), datetime(2022, 5, last))


def held(spark, home, table):
    df = daily.read(spark, home, table)
    return sorted((r[S.JOB_ID], r[S.RECORD_TIME], str(r[S.RECORD_DATE])) for r in df.collect())


TABLE = daily.clean_records((S.RECORD_TIME, S.STATUS, S.JOB_ID))


def test_late_records_renew_their_days_alone(spark, tmp_path):
    base, home = tmp_path / "in", str(tmp_path / "out")
    for d in range(6):
        put(base, DAY_0 + timedelta(d), "a.json", job(f"a{d}", d), job(f"b{d}", d, 5, "Running"))
    first = daily.run(spark, str(base), home, days(1, 5), [TABLE])
    assert (first.number, first.days) == (1, [DAY_0 + timedelta(d) for d in range(4)])
    assert [r[0] for r in held(spark, home, TABLE)] == ["a0", "a1", "a2", "a3"]
    again = daily.run(spark, str(base), home, days(1, 5), [TABLE])
    assert (again.number, again.folders, again.days) == (2, [], [])
    put(base, DAY_0 + timedelta(3), "late.json", job("late", 1, 9), job("b3", 3, 7), job("far", 9))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "out/clean").rglob("*.parquet")}
    second = daily.run(spark, str(base), home, days(3, 6), [TABLE])
    assert second.folders == ["2022/05/04", "2022/05/05"] and second.days == [DAY_0 + timedelta(d) for d in (1, 3, 4)]
    assert [r[0] for r in held(spark, home, TABLE)] == ["a0", "a1", "a2", "a3", "a4", "b3", "late"]
    untouched = [f for f in files if "record_date=2022-05-01" in str(f) or "record_date=2022-05-03" in str(f)]
    assert untouched and all(f.exists() and f.stat().st_mtime_ns == files[f] for f in untouched)
    whole = str(tmp_path / "whole")
    daily.run(spark, str(base), whole, days(1, 6), [TABLE])
    assert held(spark, whole, TABLE) == held(spark, home, TABLE)
    noted = daily.touched_days(spark, home).orderBy("run", S.RECORD_DATE).collect()
    assert [(r.run, r[S.RECORD_DATE].day, r.arrived) for r in noted] == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (1, 4, 2), (2, 2, 1), (2, 4, 3), (2, 5, 2)]


def test_a_run_that_died_is_done_again(spark, tmp_path, monkeypatch):
    base, home = tmp_path / "in", str(tmp_path / "out")
    for d in range(3):
        put(base, DAY_0 + timedelta(d), "a.json", job(f"a{d}", d), job(f"late{d}", max(d - 1, 0), 3))

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(daily.sinks, "remove_inputs", fails)  # the tables are written, the notes are not
        with pytest.raises(RuntimeError):
            daily.run(spark, str(base), home, days(1, 4), [TABLE])
    assert daily.run(spark, str(base), home, days(1, 4), [TABLE]).number == 1
    whole = str(tmp_path / "whole")
    daily.run(spark, str(base), whole, days(1, 4), [TABLE])
    assert held(spark, home, TABLE) == held(spark, whole, TABLE) != []


def test_one_new_day_reads_and_renews_that_day_for_all_tables(spark, tmp_path):
    base, home = tmp_path / "in", str(tmp_path / "out")
    fields = {S.TIER: "RAW", S.DATASET: "/d", S.TOOL: S.ANALYSIS_TOOL, S.TASK: "t", S.USER_NAME: "u", S.WORKFLOW: "w", S.CPU_HR: 0.1}
    tables = [TABLE, daily.access_state(), daily.usage_state()]
    for d in range(4):
        put(base, DAY_0 + timedelta(d), "a.json", *(job(f"j{d}-{i}", d, i, **{**fields, S.BLOCK: f"/d#{i}", S.USER_NAME: f"u{d}{i}"}) for i in range(3)))
        run = daily.run(spark, str(base), home, days(d + 1, d + 2), tables)
        assert run.days == [DAY_0 + timedelta(d)]
    merged = state.merged_accesses(daily.read(spark, home, "accesses"))
    assert sorted(map(tuple, merged.select(S.BLOCK, S.FIRST_ACCESS, S.LAST_ACCESS).collect())) == [
        (f"/d#{i}", START + i, START + 3 * DAY_MS + i) for i in range(3)]
    records = source.read_jobs(spark, str(base), days(1, 5))
    whole = catalogue.accesses(clean.clean_jobs(records, extracts.ACCESS_COLUMNS, per_day=True, tool=S.ANALYSIS_TOOL, known_tier=True, with_block=True))
    assert sorted(rows(merged), key=str) == sorted(rows(whole), key=str)
    used = state.merged_usage(daily.read(spark, home, "usage")).first()
    assert (used.jobs, used.sum_CpuTimeHr, used.distinct_CRAB_UserHN, used.distinct_Workflow) == (12, Decimal("1.2"), 12, 1)


def test_runs_over_nothing(spark, tmp_path):
    home = str(tmp_path / "out")
    with pytest.raises(AnalysisException):
        daily.run(spark, str(tmp_path / "missing"), home, days(1, 3), [TABLE])
    (tmp_path / "in").mkdir()
    assert daily.run(spark, str(tmp_path / "in"), home, days(1, 3), [TABLE]) == daily.Run(1, [], [])
    assert daily.run(spark, str(tmp_path / "in"), home, days(1, 1), [TABLE]) == daily.Run(1, [], [])
    put(tmp_path / "in", DAY_0, "far.json", job("far", 9))  # belongs to no day within reach
    assert daily.run(spark, str(tmp_path / "in"), home, days(1, 3), [TABLE]) == daily.Run(1, ["2022/05/01"], [])
    assert daily.run(spark, str(tmp_path / "in"), home, days(1, 3), [TABLE]) == daily.Run(2, [], [])


# --- mergeable parts -----------------------------------------------------------------

def usage_jobs(spark, n=40_000):
    day = F.timestamp_millis(F.lit(START) + (F.col("id") % 30) * DAY_MS)
    return spark.range(n).select(
        F.concat(F.lit("j"), "id").alias(S.JOB_ID), F.unix_millis(day).alias(S.RECORD_TIME), F.lit("/d").alias(S.DATASET),
        (F.col("id") % 100 / 8).alias(S.CPU_HR), (F.col("id") * 7 % 9001).cast("string").alias(S.USER_NAME),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias(S.WORKFLOW))


def test_distinct_counts_of_thirty_days_stay_within_their_bound(spark):
    cleaned = clean.clean_jobs(usage_jobs(spark), [S.DATASET, S.CPU_HR, S.USER_NAME, S.WORKFLOW], per_day=True)
    parts = state.usage_parts(cleaned)
    assert parts.count() == 30
    got = state.merged_usage(parts).first()
    assert abs(got.distinct_CRAB_UserHN - 9001) <= state.USERS_ERROR * 9001
    assert abs(got.distinct_Workflow - 32_000) <= state.USERS_ERROR * 32_000
    assert got.jobs == 40_000 and got.sum_CpuTimeHr == sum(Decimal(i % 100) / 8 for i in range(40_000))
    week = state.merged_usage(parts.where(F.col(S.RECORD_DATE) < DAY_0 + timedelta(7))).first()
    assert week.jobs == sum(i % 30 < 7 for i in range(40_000))


def test_merged_profiles(spark):
    rng = random.Random(4)
    data = [(i % 9, None if i % 50 == 0 else rng.gauss(1e6, 3), float(i % 7), None) for i in range(20_000)]
    df = spark.createDataFrame(data, "day INT, a DOUBLE, b DOUBLE, c DOUBLE")
    got = {r.measure: r for r in state.merged_profile(state.profile_parts(df, ["a", "b", "c"], "day")).collect()}
    assert set(got) == {"a", "b"}
    for k, name in ((1, "a"), (2, "b")):
        values = sorted(r[k] for r in data if r[k] is not None)
        mean = sum(values) / len(values)
        spread = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5
        r = got[name]
        assert (r["count"], r.min, r.max) == (len(values), values[0], values[-1])
        assert abs(r["mean"] - mean) < 1e-6 and abs(r["stddev"] - spread) < 1e-6
        for q, at in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            below, to = sum(v < r[q] for v in values) / len(values), sum(v <= r[q] for v in values) / len(values)
            assert below <= at + state.RANK_ERROR and to >= at - state.RANK_ERROR
    one = state.merged_profile(state.profile_parts(df.limit(1).select("day", F.lit(2.0).alias("x")), ["x"], "day")).first()
    assert (one["count"], one["mean"], one["stddev"]) == (1, 2.0, None)


# --- counted reads ---------------------------------------------------------------------

def test_every_line_is_counted(spark, tmp_path):
    path = tmp_path / "2022/05/01"
    path.mkdir(parents=True)
    good = json.dumps({"data": job("a", 0)})
    lines = [good, json.dumps({"data": job("next day", 1)}), "{not json", good[:-3], json.dumps({"data": {S.JOB_ID: "no time"}}),
             json.dumps({"data": {**job("type", 0), S.RECORD_TIME: "noon"}}), json.dumps({"other": 1}), "[]", ""]
    (path / "a.json").write_text("\n".join(lines) + "\n")
    reading = source.read_jobs_counted(spark, str(tmp_path), days(1, 2), [S.STATUS])
    assert [r[S.JOB_ID] for r in reading.records.collect()] == ["a"]
    counts = reading.counts.get
    assert counts["read"] == counts["kept"] + counts["outside"] + counts["malformed"]
    assert (counts["kept"], counts["outside"]) == (1, 1)
    assert reading.quarantine.count() == counts["malformed"]
    assert {"{not json", good[:-3]} <= {r.line for r in reading.quarantine.collect()}
    plain = source.read_jobs(spark, str(tmp_path), days(1, 2), [S.STATUS])
    assert rows(plain) == rows(reading.records)


def test_counted_reads_of_no_folder(spark, tmp_path):
    reading = source.read_jobs_counted(spark, str(tmp_path), days(1, 2), [])
    assert reading.records.count() == 0 and reading.quarantine.count() == 0
    with pytest.raises(AnalysisException):
        source.read_jobs_counted(spark, str(tmp_path / "missing"), days(1, 2), [])


def test_written_inputs_are_removed_and_nothing_else(spark):
    base = shared_folder(spark, "home")
    kept, gone = (sinks.written(spark.range(3), f"{base}/{n}") for n in ("kept", "gone"))
    assert len(sinks.remove_inputs(gone, base)) == 1
    assert kept.count() == 3 and spark.read.parquet(f"{base}/kept").count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(f"{base}/gone")
    assert sinks.remove_inputs(kept, f"{base}/elsewhere") == []


# --- exact sums ---------------------------------------------------------------------------

def test_ranks_do_not_depend_on_the_layout(spark):
    """Sums near 1e11 of many fractions; two datasets tie exactly, two differ in the ninth decimal."""
    rng = random.Random(1)
    parts = [rng.randrange(1, 10**15) / 1e6 for _ in range(150)]
    data = [("/tie-b", v) for v in parts] + [("/tie-a", v) for v in reversed(parts)]
    data += [("/close-a", 1e5), ("/close-a", 1e-9), ("/close-b", 1e5), ("/close-b", 2e-9)]
    data += [(f"/d{i}", rng.random() * 1e9) for i in range(200)]
    rng.shuffle(data)
    df = spark.createDataFrame([(f"j{i}", START, d, v) for i, (d, v) in enumerate(data)], f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT, {S.DATASET} STRING, {S.CPU_HR} DOUBLE")
    seen = set()
    for n in (1, 5, 16):
        top = topk.top_per_group(A.dataset_cpu_by_day(df.repartition(n, F.rand(n))), [S.RECORD_DATE], "Sum_CpuTimeHr", 300, [S.DATASET])
        seen.add(tuple(map(tuple, top.orderBy("rank").select("rank", S.DATASET, "Sum_CpuTimeHr").collect())))
    assert len(seen) == 1
    names = [r[1] for r in next(iter(seen))]
    assert names[:2] == ["/tie-a", "/tie-b"] and names.index("/close-b") + 1 == names.index("/close-a")


def test_exact_sums_refuse_what_they_cannot_hold(spark):
    sums = lambda values: spark.createDataFrame([(v,) for v in values], "v DOUBLE").agg(exact.exact_sum("v").alias("s")).first().s
    assert sums([0.1] * 10) == 1 and sums([None, None]) is None and sums([None, 2.5]) == Decimal("2.5")
    assert sums([1e15, 1e-9, -1e15]) == Decimal("1e-9")
    for bad in ([1e19], [float("nan")], [float("inf")]):
        with pytest.raises(Exception, match="no exact decimal"):
            sums(bad)
    big = spark.range(3).select(F.lit("9" * 29).cast(exact.TOTAL).alias("v"))
    with pytest.raises(Exception, match="more than 38 digits"):
        big.agg(exact.sum_of_sums("v")).first()


def test_totals_of_the_hierarchy_balance_exactly(spark, sf_dir):
    nodes = popularity.usage_hierarchy(B.jobs(spark, sf_dir, S.DATASET, S.CPU_HR), "all")
    assert hierarchy.hierarchy_balance(nodes).first().days_minus_period == 0
