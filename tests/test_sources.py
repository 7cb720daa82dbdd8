"""Readers and writers on small hand-made folders."""

import json
from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException

from conftest import rows
from jobtally import schemas as S, sinks
from jobtally.operators import catalogue, clean
from jobtally.plans import extracts
from jobtally.session import shared_folder
from jobtally.sources import catalogue as dumps, jobs as source
from jobtally.sources.windows import TimeWindow, calendar_of, days_of, month_window

MAY_1 = TimeWindow(datetime(2022, 5, 1), datetime(2022, 5, 2))


def put(base, folder, *records):
    path = base / folder
    path.mkdir(parents=True, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps({"data": r}) for r in records]
    (path / f"part-{len(list(path.iterdir()))}.json").write_text("\n".join(lines) + "\n")


def record(job, ms, **fields):
    return {S.JOB_ID: job, S.RECORD_TIME: ms, **fields}


def ids(df):
    return sorted(r[S.JOB_ID] for r in df.collect())


def test_folders_reach_three_days_either_side():
    folders = source.candidate_folders(MAY_1)
    assert folders == [f"2022/04/{d}" for d in (28, 29, 30)] + [f"2022/05/0{d}" for d in (1, 2, 3, 4)]
    assert source.candidate_folders(MAY_1, slack=0) == ["2022/05/01"]


def test_tmp_folders_are_named_only_on_request():
    assert source.candidate_folders(MAY_1, 0, include_tmp=True) == ["2022/05/01", "2022/05/01.tmp"]


def test_window_is_half_open_and_reads_neighbour_folders(spark, tmp_path):
    start, end = MAY_1.start_ms, MAY_1.end_ms
    put(tmp_path, "2022/04/30", record("start", start), record("before", start - 1))
    put(tmp_path, "2022/05/01", record("end", end), record("last", end - 1))
    put(tmp_path, "2022/05/04", record("late", start + 5))
    put(tmp_path, "2022/05/05", record("too far", start + 6))
    assert ids(source.read_jobs(spark, str(tmp_path), MAY_1, [])) == ["last", "late", "start"]


def test_missing_days_and_tmp_days(spark, tmp_path):
    put(tmp_path, "2022/05/01", record("a", MAY_1.start_ms))
    put(tmp_path, "2022/05/01.tmp", record("b", MAY_1.start_ms))
    assert ids(source.read_jobs(spark, str(tmp_path), MAY_1, [])) == ["a"]
    assert ids(source.read_jobs(spark, str(tmp_path), MAY_1, [], include_tmp=True)) == ["a", "b"]


def test_no_folder_at_all_gives_no_rows(spark, tmp_path):
    df = source.read_jobs(spark, str(tmp_path), MAY_1, [S.STATUS])
    assert df.columns == [S.RECORD_TIME, S.JOB_ID, S.STATUS] and df.count() == 0


def test_bad_lines_and_missing_fields(spark, tmp_path):
    put(tmp_path, "2022/05/01", "{not json", record("a", MAY_1.start_ms), {S.JOB_ID: "no time"},
        {S.RECORD_TIME: MAY_1.start_ms, S.STATUS: "Held"})
    nested = source.scan_json(spark, str(tmp_path), MAY_1, [S.RECORD_TIME, S.JOB_ID, S.STATUS])
    assert nested.count() == 4
    got = rows(source.read_jobs(spark, str(tmp_path), MAY_1, [S.STATUS]))
    assert sorted(got, key=str) == [(MAY_1.start_ms, "a", None), (MAY_1.start_ms, None, "Held")]


def test_read_schema_holds_the_asked_columns_only():
    assert S.job_schema([S.RECORD_TIME, S.JOB_ID])["data"].dataType.names == [S.RECORD_TIME, S.JOB_ID]
    assert len(S.job_schema()["data"].dataType) == 25
    with pytest.raises(ValueError):
        S.job_schema(["NoSuchField"])


def test_filter_runs_before_deduplication(spark):
    """A running and a final record: the final one stays although it is older."""
    df = spark.createDataFrame(
        [("j", 10, "Completed"), ("j", 20, "Running"), (None, 1, "Held"), (None, 2, "Held")],
        f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT, {S.STATUS} STRING")
    got = rows(clean.clean_jobs(df, [S.STATUS], statuses=S.FINAL_STATUSES))
    assert sorted(got, key=str) == [("j", 10, "Completed"), (None, 2, "Held")]


def test_deduplication_scope(spark):
    day = 86_400_000
    df = spark.createDataFrame([("j", 10), ("j", day + 10), ("j", 20)], f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT")
    assert sorted(r[S.RECORD_TIME] for r in clean.clean_jobs(df, per_day=True).collect()) == [20, day + 10]
    assert [r[S.RECORD_TIME] for r in clean.clean_jobs(df).collect()] == [day + 10]


def test_deduplication_is_idempotent_and_ignores_row_order(spark):
    data = [(f"j{i % 7}", i % 3, float(i % 5)) for i in range(60)]
    schema = f"{S.JOB_ID} STRING, {S.RECORD_TIME} BIGINT, {S.WALL_HR} DOUBLE"
    once = clean.clean_jobs(spark.createDataFrame(data, schema).repartition(5))
    other = clean.clean_jobs(spark.createDataFrame(data[::-1], schema).repartition(3))
    assert sorted(rows(once)) == sorted(rows(other)) == sorted(rows(clean.clean_jobs(once)))
    assert once.count() == 7


def test_csv_null_token_and_bad_rows(spark, tmp_path):
    (tmp_path / "good.csv").write_text("f1,10,1,1\nf2,null,1,2\nf3,5,null,3\n")
    files = dumps.read_files(spark, str(tmp_path / "good.csv"))
    assert rows(files.select(S.FILE_SIZE, S.FILE_DATASET_ID)) == [(10, 1), (None, 1), (5, None)]
    (tmp_path / "bad.csv").write_text("f1,ten,1,1\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        dumps.read_files(spark, str(tmp_path / "bad.csv")).collect()


def test_catalogue_reads_all_parts_of_a_folder(spark, tmp_path):
    (tmp_path / "part-m-00000").write_text("1,/a/b/RAW\n")
    (tmp_path / "part-m-00001").write_text("2,/c/d/RAW\n")
    assert dumps.read_datasets(spark, str(tmp_path)).count() == 2


def test_orphans_of_both_size_tables(spark):
    files = spark.createDataFrame([("f1", 10, 1, 1), ("f2", 20, 9, 1), ("f3", 5, None, 1), ("f4", None, 3, 1)],
                                  S.FILES_SCHEMA)
    datasets = spark.createDataFrame([(1, "/a"), (2, "/empty"), (3, "/nosize"), (4, "/a")], S.DATASETS_SCHEMA)
    assert sorted(rows(catalogue.dataset_sizes(datasets, files))) == [("/a", 10), ("/empty", None), ("/nosize", None)]
    assert sorted(rows(catalogue.file_sizes(files, datasets)), key=str) == [
        ("/a", 10), ("/nosize", None), (None, 25)]


@pytest.mark.parametrize("year, month, days", [(2022, 2, 28), (2024, 2, 29), (2022, 12, 31), (2022, 6, 30)])
def test_month_boundaries(spark, year, month, days):
    window = month_window(year, month)
    got = rows(days_of(spark, window))
    assert len(got) == days
    assert got[0][0] == date(year, month, 1) and got[0][1] == window.start_ms and got[-1][2] == window.end_ms


def test_calendar_fills_whole_months(spark):
    df = spark.createDataFrame([(date(2023, 2, 10),), (date(2023, 12, 31),), (None,)], f"{S.RECORD_DATE} DATE")
    assert calendar_of(df).count() == 28 + 31


def test_local_bounds_with_utc_days(spark):
    """Late evening of 30 April UTC is already 1 May two hours further east."""
    east = TimeWindow(datetime(2022, 5, 1), datetime(2022, 5, 8), "Europe/Zurich")
    ms = TimeWindow(datetime(2022, 4, 30, 22, 30), datetime(2022, 5, 1)).start_ms
    df = spark.createDataFrame([(ms,)], f"{S.RECORD_TIME} BIGINT")
    assert df.where(east.contains()).count() == 1
    assert df.where(TimeWindow(east.start, east.end).contains()).count() == 0


def test_parquet_write_refuses_an_existing_path(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_parquet(spark.range(3), path, compression="gzip")
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        sinks.write_parquet(spark.range(3), path)
    assert list((tmp_path / "out").glob("*.gz.parquet")) and spark.read.parquet(path).count() == 3


def test_daily_extract_replaces_only_its_own_days(spark, tmp_path):
    path = str(tmp_path / "days")

    def day_of(day, n):
        return spark.createDataFrame([(date(2022, 5, day), i) for i in range(n)], f"{S.RECORD_DATE} DATE, x INT")

    sinks.write_by(day_of(1, 3).unionAll(day_of(2, 4)), path)
    sinks.write_by(day_of(2, 1), path, replace=True)
    assert sorted(rows(spark.read.parquet(path).groupBy(S.RECORD_DATE).count())) == [
        (date(2022, 5, 1), 3), (date(2022, 5, 2), 1)]


def test_extract_has_a_job_on_each_of_its_days_or_once(spark):
    day = 86_400_000
    data = [{**dict.fromkeys(S.EXTRACT_COLUMNS), S.JOB_ID: "j", S.RECORD_TIME: ms, S.STATUS: "Held"}
            for ms in (1, 2, day + 1)]
    df = spark.createDataFrame(data, S.job_schema(S.EXTRACT_COLUMNS)["data"].dataType)
    assert extracts.clean_extract(df).count() == 2
    assert extracts.clean_extract(df, once=True).count() == 1


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a.startswith(base) and a != b


def test_part_day_zone_and_empty_windows_name_their_days(spark):
    noon = TimeWindow(datetime(2022, 5, 1, 12), datetime(2022, 5, 2, 6))
    assert source.candidate_folders(noon, slack=0) == ["2022/05/01", "2022/05/02"]
    assert source.candidate_folders(noon)[0] == "2022/04/28" and source.candidate_folders(noon)[-1] == "2022/05/05"
    west = TimeWindow(datetime(2022, 5, 1), datetime(2022, 5, 2), "America/Los_Angeles")
    assert source.candidate_folders(west, slack=0) == ["2022/05/01", "2022/05/02"]
    hour = TimeWindow(datetime(2022, 5, 1), datetime(2022, 5, 1, 1))
    assert [str(r[0]) for r in days_of(spark, hour).collect()] == ["2022-05-01"]
    none = TimeWindow(datetime(2022, 5, 1), datetime(2022, 5, 1))
    assert source.candidate_folders(none) == [] and days_of(spark, none).count() == 0
    with pytest.raises(ValueError):
        TimeWindow(datetime(2022, 5, 2), datetime(2022, 5, 1))


def test_part_day_window_reads_its_records(spark, tmp_path):
    noon = TimeWindow(datetime(2022, 5, 1, 12), datetime(2022, 5, 2, 6))
    put(tmp_path, "2022/05/01", record("early", noon.start_ms - 1), record("in", noon.start_ms))
    put(tmp_path, "2022/05/02", record("next day", noon.end_ms - 1), record("after", noon.end_ms))
    assert ids(source.read_jobs(spark, str(tmp_path), noon, [], slack=0)) == ["in", "next day"]


def test_a_missing_base_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        source.read_jobs(spark, str(tmp_path / "mistyped"), MAY_1, [])


def test_windows_that_a_table_cannot_hold_are_refused(spark, tmp_path):
    spark.sql("SELECT DATE'2022-05-01' record_date, 1 n UNION ALL SELECT DATE'2022-05-02', 2").write.parquet(str(tmp_path / "d"))
    spark.sql("SELECT DATE'2022-05-01' period, 1 n").write.parquet(str(tmp_path / "m"))
    assert [r.n for r in source.read_extract(spark, str(tmp_path / "d"), MAY_1).collect()] == [1]
    noon = TimeWindow(datetime(2022, 5, 1, 12), datetime(2022, 5, 2))
    for path, window in (("d", noon), ("m", MAY_1)):
        with pytest.raises(ValueError):
            source.read_extract(spark, str(tmp_path / path), window)


def test_replace_refuses_parts_of_partitions():
    noon = TimeWindow(datetime(2022, 5, 1, 12), datetime(2022, 5, 2))
    with pytest.raises(ValueError):
        extracts.write_clean_extract(None, "unused", replace=True, window=noon)
    with pytest.raises(ValueError):
        extracts.write_daily_dataset_blocks(None, None, None, "unused", replace=True, window=noon)
    with pytest.raises(ValueError):
        extracts.write_period_dataset_sizes(None, None, "unused", replace=True, window=MAY_1)
