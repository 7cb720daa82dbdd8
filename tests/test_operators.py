"""Column functions and operators on hand-made edge cases."""

import random
from datetime import date

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from jobtally import schemas as S
from jobtally.functions import classify as C, labels as L, time as T
from jobtally.operators import aggregates as A, catalogue, clean, exitcodes, hierarchy, joins, series, shares, topk
from jobtally.plans import popularity, usage
from jobtally.sources.exitcodes import MEANINGS, TYPES


def column(spark, values, name="x", kind="BIGINT"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_exit_code_types_at_the_range_ends(spark):
    codes = [0, 1, 512, 513, 6999, 7000, 9000, 9001, 10000, 19999, 20000, 50000, 59999, 60000, 69999, 70000, 79999,
             80000, 89999, 90000, 99999, 100000, None]
    got = dict(rows(column(spark, codes, S.EXIT_CODE).select(S.EXIT_CODE, C.exit_type())))
    for code in codes:
        expected = [t for lo, hi, t in TYPES if code is not None and lo <= code <= hi]
        assert got[code] == (expected[0] if expected else "")


def test_exit_code_description(spark):
    df = exitcodes.with_description(column(spark, [0, 8028, 50666, 50660, None], S.EXIT_CODE))
    got = {r[0]: (r[1], r[2]) for r in rows(df.select(S.EXIT_CODE, "Type", "Meaning"))}
    assert got[0] == ("", "") and got[None] == ("", "")
    assert got[8028][1] == "FileOpenError with fallback"
    assert got[50666] == ("Failures related executable file", "")
    assert got[50660][1].startswith("Application terminated by wrapper because using too much RAM")
    assert len(MEANINGS) == 134


def test_exit_flag_and_class(spark):
    df = column(spark, [0, 5, None]).select("x", C.exit_flag("x"), C.exit_class("x"))
    assert rows(df) == [(0, 0, "Success"), (5, 1, "Fail"), (None, None, "Null Exit Code")]


def test_monte_carlo_classes_never_null(spark):
    data = [("MCFakeBlock", "analysis"), ("MCFakeBlock", "production"), (None, "analysis"), ("MCFakeBlock", None)]
    df = spark.createDataFrame(data, f"{S.BLOCK} STRING, {S.JOB_TYPE} STRING").select(C.mc_class(), C.is_mc_job())
    assert rows(df) == [("mc", True), ("mc", False), ("notMc", False), ("mc", False)]


def test_efficiency_over_nothing_is_null(spark):
    schema = f"{S.RECORD_TIME} BIGINT, {S.INPUT_DATA} STRING, {S.CPU_HR} DOUBLE, {S.WALL_HR} DOUBLE, {S.CPUS} BIGINT, {S.CORE_HR} DOUBLE"
    df = spark.createDataFrame([(0, "Onsite", 1.0, 2.0, None, 0.0), (3_600_000, "Onsite", 1.0, 2.0, 2, 4.0)], schema)
    got = rows(A.efficiency_by_hour(df).orderBy("hour").select("hour", "cpu_eff_wall", "cpu_eff_core"))
    assert got == [(0, None, None), (1, 0.25, 0.25)]
    assert rows(df.select(C.cpu_efficiency())) == [(None,), (0.25,)]


def test_calendar_keys_are_utc_in_any_session_zone(spark):
    ms = 1651357800000  # 2022-04-30T22:30Z
    spark.conf.set("spark.sql.session.timeZone", "Europe/Zurich")
    try:
        df = column(spark, [ms, -1], "t").select(T.record_date("t"), T.hour_of_day("t"), T.day_of_month("t"))
        assert rows(df) == [(date(2022, 4, 30), 22, "30"), (date(1969, 12, 31), 23, "31")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_epoch_text(spark):
    df = column(spark, [1651440241000], "t").select(T.ms_text("t"), T.hour_label(T.hour_of_day("t")))
    assert rows(df) == [("2022-05-01 21:24:01", "21")]


# --- shares and labels ---------------------------------------------------------

def animals(spark, values=(45, 454, 90)):
    return spark.createDataFrame(list(zip(("cat", "dog", "bird"), values)), "key STRING, n BIGINT")


def test_percent_labels(spark):
    df = shares.with_label(shares.with_percent(animals(spark), percent="n"), "key").orderBy("key")
    assert [r["text"] for r in df.collect()] == ["bird: 15.280%", "cat: 7.640%", "dog: 77.080%"]


@pytest.mark.parametrize("below, kept, others", [
    (10, {"dog": 77.080, "bird": 15.280}, 7.640), (1, {"cat": 7.640, "dog": 77.080, "bird": 15.280}, 0.0),
    (100, {}, 100.0)])
def test_fold_small(spark, below, kept, others):
    got = rows(shares.fold_small(animals(spark), "key", "n", below))
    assert {k: round(p, 3) for k, p, o in got if not o} == kept
    assert [(k, round(p, 3)) for k, p, o in got if o] == [("Others", others)]
    members = rows(shares.folded_members(animals(spark), "key", "n", below))
    assert len(members) == 3 - len(kept) and abs(sum(p for _, p in members) - others) < 1e-3


def test_share_equal_to_the_limit_is_kept(spark):
    got = rows(shares.fold_small(animals(spark, (50, 25, 25)), "key", "n", 25))
    assert len(got) == 4 and got[-1][1] == 0.0


def test_null_values_and_zero_totals(spark):
    df = spark.createDataFrame([("a", 1), (None, 3), ("c", None)], "key STRING, n BIGINT")
    got = dict((k, p) for k, p, _ in rows(shares.fold_small(df, "key", "n", 30)))
    assert got == {"Null": 75.0, "Others": 25.0}
    zero = rows(shares.with_percent(animals(spark, (0, 0, 0)), percent="n"))
    assert all(r[2] is None for r in zero)


def test_fold_small_of_nothing(spark):
    assert rows(shares.fold_small(animals(spark).where("n < 0"), "key", "n", 5)) == [("Others", 0.0, True)]


@pytest.mark.parametrize("cut", [False, True])
def test_short_dataset_names(spark, cut):
    def expected(name):
        parts = (name or "").split("/")
        if len(parts) < 4:
            return None
        a, b, c = parts[1:4]
        if len(a) < 15 and len(b) < 15:
            return f"/{a}/{b}/{c}"
        if len(a) < 15 and len(b) > 15:
            return f"/{a}/{b[:15]}.../{c}"
        if len(a) > 15 and len(b) < 15:
            return f"/{a[:15]}.../{b}/{c}"
        return f"/{a[:15]}.../{b[:15]}.../{c}" if cut else f"/{a}.../{b}.../{c}"

    names = [f"/{'a' * i}/{'b' * j}/RAW" for i in (14, 15, 16) for j in (14, 15, 16)] + ["/a/b", "x", "", None, "/a/b/c/d"]
    got = rows(column(spark, names, "n", "STRING").select("n", L.short_dataset_name("n", cut)))
    assert got == [(n, expected(n)) for n in names]


def test_probe_datasets_are_dropped_by_exact_case(spark):
    df = column(spark, ["/a/HC/x", "/a/hc/x", None, "/HCal/b"], S.DATASET, "STRING")
    assert rows(clean.without_mark(df, S.DATASET)) == [("/a/hc/x",)]


# --- top lists, hierarchy, series ----------------------------------------------

def daily(spark):
    data = [(date(2022, 5, d), f"/ds{i}", float(10 * d + i)) for d in (1, 2) for i in range(8)]
    data += [(date(2022, 5, 1), None, 500.0), (date(2022, 5, 3), "/only", 1.0)]
    return spark.createDataFrame(data, f"{S.RECORD_DATE} DATE, {S.DATASET} STRING, Sum_CpuTimeHr DOUBLE")


def test_top_per_group_equals_one_limit_per_day(spark):
    df = daily(spark)
    got = topk.top_per_group(df, [S.RECORD_DATE], "Sum_CpuTimeHr", 5, [S.DATASET]).drop("rank")
    days = [r[0] for r in df.select(S.RECORD_DATE).distinct().collect()]
    branches = topk.stack(*(topk.top_rows(df.where(F.col(S.RECORD_DATE) == d), "Sum_CpuTimeHr", 5, [S.DATASET])
                            for d in days))
    assert sorted(rows(got), key=str) == sorted(rows(branches), key=str) and got.count() == 11


def test_hierarchy_and_balance(spark):
    nodes = hierarchy.usage_hierarchy(daily(spark), "May 1st Week").orderBy("level", S.RECORD_DATE, "rank")
    got = rows(nodes.select("label", "parent", "value", "hover"))
    total = sum(r["Sum_CpuTimeHr"] for r in daily(spark).collect())
    assert got[0] == ("May 1st Week", "", total, f"May 1st Week - CPU Time: {total:.3f}")
    assert [g[:2] for g in got[1:4]] == [(f"0{d}/05", "May 1st Week") for d in (1, 2, 3)]
    assert got[4] == ("01 - Top1", "01/05", 500.0, "Null - CPU Time: 500.000")
    assert len(got) == 1 + 3 + 11
    balance = hierarchy.hierarchy_balance(nodes).collect()[0]
    assert abs(balance["days_minus_period"]) < 1e-9 and balance["nodes_minus_root"] > balance["period"]
    assert abs(balance["top_part"] - sum(g[2] for g in got[4:])) < 1e-9


def test_series_show_hours_without_jobs(spark):
    df = spark.createDataFrame([(3, "Onsite", 0.5), (5, "Onsite", 0.7), (5, "Offsite", 0.1), (6, None, 0.9)],
                               f"hour INT, {S.INPUT_DATA} STRING, eff DOUBLE")
    got = rows(series.with_mean_lines(series.align_hours(df, "eff")).orderBy("hour"))
    assert len(got) == 24 and got[0] == (0, None, None, 0.6, 0.1) and got[5] == (5, 0.7, 0.1, 0.6, 0.1)


def test_success_rates_ignore_jobs_without_code(spark):
    df = spark.createDataFrame([(0, 6.0), (0, 2.0), (7, 8.0), (None, 100.0)], f"{S.WRAPPER_EXIT_CODE} BIGINT, {S.CORE_HR} DOUBLE")
    r = A.success_rates(df).collect()[0]
    assert (r.count_success, r.count_fail, r.pct_core_success, r.pct_core_fail) == (2, 1, 50.0, 50.0)
    assert abs(r.pct_jobs_success - 200 / 3) < 1e-9
    empty = A.success_rates(df.where("false")).collect()[0]
    assert empty.count_success == 0 and empty.pct_jobs_success is None


# --- accesses and lookups ------------------------------------------------------

def test_access_tables_match_the_window_form(spark):
    data = [(f"j{i}", i * 7 % 50, "RAW", f"/d{i % 3}", f"/d{i % 3}#{i % 5}", f"t{i % 4}") for i in range(200)]
    jobs = spark.createDataFrame(data, f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT, {S.TIER} STRING, {S.DATASET} STRING, "
                                       f"{S.BLOCK} STRING, {S.TASK} STRING")
    blocks = catalogue.active_blocks(catalogue.accesses(jobs))
    block = Window.partitionBy(S.BLOCK)
    window = jobs.withColumns({S.FIRST_ACCESS: F.min(S.RECORD_TIME).over(block),
                               S.LAST_ACCESS: F.max(S.RECORD_TIME).over(block)})
    assert sorted(rows(catalogue.with_block_access(jobs))) == sorted(rows(window))
    window = window.select(S.BLOCK, S.FIRST_ACCESS, S.LAST_ACCESS).distinct()
    assert sorted(rows(blocks.select(S.BLOCK, S.FIRST_ACCESS, S.LAST_ACCESS))) == sorted(rows(window))
    assert blocks.where(F.col(S.FIRST_ACCESS) > F.col(S.LAST_ACCESS)).count() == 0
    assert rows(catalogue.active_datasets(catalogue.accesses(jobs)).orderBy(S.DATASET)) == [
        ("RAW", "/d0"), ("RAW", "/d1"), ("RAW", "/d2")]


def test_null_block_is_a_group_of_its_own(spark):
    jobs = spark.createDataFrame([("a", 1, None), ("b", 5, None), ("c", 3, "x")],
                                 f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT, {S.BLOCK} STRING")
    assert sorted(rows(catalogue.with_block_access(jobs))) == [
        ("a", 1, None, 1, 5), ("b", 5, None, 1, 5), ("c", 3, "x", 3, 3)]


def hot_rows(spark, n=3000):
    """A third of the rows has one key, a few rows have none, the others have one of 500."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    return spark.range(n).select("id", key.alias("key"))


def test_split_lookup_equals_a_plain_join(spark):
    left = hot_rows(spark, 1000)
    lookup = spark.createDataFrame([("hot", 1, 7), ("k1", 2, 8), ("k2", 3, 9), (None, 4, 1)], "key STRING, size INT, id INT")
    for how in ("left", "inner"):
        split = joins.split_lookup(left, lookup, ["key"], how=how, hot_rows=50).select("id", "key", "size")
        plain = left.alias("l").join(lookup.alias("r"), F.col("l.key").eqNullSafe(F.col("r.key")), how).select("l.id", "l.key", "size")
        assert sorted(rows(split), key=str) == sorted(rows(plain), key=str)
        assert joins.split_lookup(left.limit(0), lookup, ["key"], how=how).count() == 0
        assert joins.split_lookup(left, lookup.limit(0), ["key"], how=how).count() == (1000 if how == "left" else 0)


def test_split_lookup_spreads_hot_keys_alone(spark):
    left = hot_rows(spark)
    counts = joins.key_counts(left, ["key"])
    assert rows(joins.hot_keys(counts, ["key"], hot_rows=100)) == [("hot", 10)]
    # At most most_hot - 1 keys can be hot, however small hot_rows is.
    assert joins.hot_keys(counts, ["key"], hot_rows=1, most_hot=4).count() < 4
    lookup = counts.withColumnRenamed("__n", "size")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("false", "-1", "64")):
            spark.conf.set(k, v)
        found = joins.split_lookup(left, lookup, ["key"], size="size", hot_rows=20)
        by_task = [r[1] for r in rows(found.groupBy(F.spark_partition_id()).count())]
        assert sum(by_task) == 3000 and max(by_task) < 200  # the hot key has 1000 rows, in 50 parts
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_the_lookup_takes_the_size_of_a_key_from_the_lookup(spark):
    left = hot_rows(spark, 300)
    lookup = joins.key_counts(left, ["key"]).withColumn("v", F.length("key"))
    found = joins.split_lookup(left, lookup, ["key"], size="__n", hot_rows=10)
    assert found.columns == ["id", "key", "v"] and found.count() == 300
    assert found.where("key <=> 'hot' AND v != 3").count() == 0


def test_popularity_counts_null_users_as_none(spark):
    schema = f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT, {S.DATASET} STRING, {S.CPU_HR} DOUBLE, {S.USER_NAME} STRING, {S.WORKFLOW} STRING"
    jobs = spark.createDataFrame([("1", 1, "/a", 1.0, "u", "w"), ("2", 1, "/a", 2.0, None, "w"), ("3", 1, "/a", 4.0, "u", None),
                                  ("4", 1, None, 8.0, "u", "w")], schema)
    sizes = spark.createDataFrame([("/b", 5)], "dataset STRING, sum_file_size BIGINT")
    assert rows(popularity.dataset_popularity(jobs, sizes)) == [("/a", 1, 1, None, 7.0)]


def test_approximate_counts_are_close(spark):
    jobs = spark.range(20_000).select(
        F.concat(F.lit("j"), "id").alias(S.JOB_ID), F.lit(1).cast("bigint").alias(S.RECORD_TIME), F.lit("/a").alias(S.DATASET),
        F.lit(1.0).alias(S.CPU_HR), (F.col("id") % 3000).cast("string").alias(S.USER_NAME), F.col("id").cast("string").alias(S.WORKFLOW))
    exact, close = (A.dataset_usage(jobs, approximate=a).collect()[0] for a in (False, True))
    assert (exact.distinct_CRAB_UserHN, exact.distinct_Workflow) == (3000, 20_000)
    assert abs(close.distinct_CRAB_UserHN - 3000) < 450 and abs(close.distinct_Workflow - 20_000) < 3000


def test_rates_by_dimension_totals_agree(spark, sf_dir):
    from verification.bindings import jobs
    got = usage.rates_by_dimension(jobs(spark, sf_dir)).groupBy("dimension").agg(
        F.sum("jobs").alias("jobs"), F.round(F.sum("sum_cpu_hr"), 3).alias("cpu"))
    assert len({r[1:] for r in rows(got)}) == 1 and got.count() == 4


def test_shares_add_up_to_hundred(spark, sf_dir):
    from verification.bindings import jobs
    r = usage.tier_hours(jobs(spark, sf_dir)).agg(F.sum("wall_pct"), F.sum("core_pct")).collect()[0]
    assert abs(r[0] - 100) < 1e-6 and abs(r[1] - 100) < 1e-6


# --- against brute force -------------------------------------------------------

def test_deduplication_against_brute_force_with_hot_ids(spark):
    """A third of the records have no id, another third share one."""
    rng = random.Random(7)
    data = [(rng.choice([None, "hot", f"j{i % 90}"]), rng.randrange(40), rng.choice([*S.FINAL_STATUSES, "Running", None]),
             rng.choice([None, 1.5, 2.5]), rng.choice([None, "x", "y"])) for i in range(3000)]
    schema = f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT, {S.STATUS} STRING, {S.WALL_HR} DOUBLE, {S.SITE} STRING"
    got = rows(clean.clean_jobs(spark.createDataFrame(data, schema).repartition(6), [S.WALL_HR, S.SITE],
                                statuses=S.FINAL_STATUSES))

    def order(record):  # newest first, then site and hours, NULLs first
        _, time, wall, site = record
        return (-time, (site is not None, site or ""), (wall is not None, wall or 0.0))

    best = {}
    for job, time, status, wall, site in data:
        record = (job, time, wall, site)
        if status in S.FINAL_STATUSES and (job not in best or order(record) < order(best[job])):
            best[job] = record
    assert sorted(got, key=str) == sorted(best.values(), key=str)


def test_daily_tables_equal_one_run_per_day(spark, sf_dir):
    """Dates in one job: the same rows as a loop over the days."""
    from datetime import datetime, timedelta

    from jobtally.plans import extracts
    from jobtally.sources.windows import TimeWindow
    from verification import bindings as B, popularity as P

    jobs = B.events_as_jobs(spark, sf_dir).cache()
    sizes, blocks = P.sizes_by_dataset(spark, sf_dir).cache(), P.sizes_by_block(spark, sf_dir).cache()
    all_days = extracts.dataset_blocks(jobs, sizes, blocks, per_day=True).cache()
    extract = extracts.clean_extract(jobs).cache()
    for day in (datetime(2024, 1, 3), datetime(2024, 1, 17)):
        one = TimeWindow(day, day + timedelta(days=1))
        single = extracts.dataset_blocks(jobs, sizes, blocks, window=one)
        part = all_days.where(F.col(S.RECORD_DATE) == F.lit(day.date())).drop(S.RECORD_DATE)
        assert sorted(rows(part), key=str) == sorted(rows(single.select(*part.columns)), key=str) != []
        loop = clean.clean_jobs(jobs, S.EXTRACT_COLUMNS, statuses=S.FINAL_STATUSES, window=one)
        part = extract.where(F.col(S.RECORD_DATE) == F.lit(day.date())).select(*loop.columns)
        assert sorted(rows(part), key=str) == sorted(rows(loop), key=str) != []
    for df in (jobs, sizes, blocks, all_days, extract):
        df.unpersist()


def test_written_accesses_give_the_same_table(spark, sf_dir):
    from jobtally.plans import extracts
    from jobtally.session import shared_folder
    from verification import popularity as P

    args = P.access_jobs(spark, sf_dir), P.sizes_by_dataset(spark, sf_dir), P.sizes_by_block(spark, sf_dir)
    own = extracts.dataset_blocks(*args)
    written = extracts.dataset_blocks(*args, access_path=shared_folder(spark, "accesses"))
    assert sorted(rows(own), key=str) == sorted(rows(written), key=str) != []


def test_top_lists_against_brute_force(spark):
    rng = random.Random(3)
    data = [(f"/d{i}", rng.randrange(5), rng.randrange(9), rng.choice([None, 1, 2, 3]), rng.random()) for i in range(60)]
    schema = f"{S.DATASET} STRING, distinct_CRAB_UserHN BIGINT, distinct_Workflow BIGINT, sum_file_size BIGINT, sum_CpuTimeHr DOUBLE"
    got = rows(popularity.top_lists(spark.createDataFrame(data, schema), k=20).drop("short_name"))
    expected = []
    for i, metric in enumerate(popularity.METRICS, 1):
        ranked = sorted(data, key=lambda r: (r[i] is None, -(r[i] or 0), r[0]))[:20]
        expected += [(metric, n, r[0], None if r[i] is None else float(round(r[i], 9))) for n, r in enumerate(ranked, 1)]
    assert sorted((m, n, d, None if v is None else float(v)) for m, n, d, v in got) == sorted(expected)
