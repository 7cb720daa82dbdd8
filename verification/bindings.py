"""The test tables seen as job records and catalogue, in Spark and as SQL text.

Job records come from ``lineitem`` with its orders and parts (ids repeat, days
only), and a second kind from ``events`` (times of day, two records per id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtally import schemas as S

# --- job records from lineitem -------------------------------------------------
# column -> (tables besides lineitem, expression); the text runs on both engines.
_BRAND = "CASE WHEN p_brand = 'Brand#13' THEN 'HC_' || p_brand ELSE p_brand END"
_DATASET_NAME = f"'/' || {_BRAND} || '/' || p_type || '/RAW'"
_TAX = "CAST(round(l_tax * 100) AS INT)"
_CODE = (f"CASE {_TAX} WHEN 4 THEN 134 WHEN 5 THEN 9999 WHEN 6 THEN 8021 WHEN 7 THEN 50660 "
         "WHEN 8 THEN NULL ELSE 0 END")
JOB_COLUMNS = {
    S.JOB_ID: ((), "CAST(l_orderkey AS STRING) || '#' || CAST(l_linenumber AS STRING)"),
    S.SITE: ((), "'T2_' || CAST(l_suppkey % 20 AS STRING)"),
    S.INPUT_DATA: ((), "CASE l_returnflag WHEN 'A' THEN 'Onsite' WHEN 'R' THEN 'Offsite' END"),
    S.TIER: (("part",), "CASE WHEN p_type = 'PROMO' THEN 'Unknown' ELSE p_type END"),
    S.STATUS: (("orders",), "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Removed' ELSE 'Running' END"),
    S.OVERFLOW: ((), "'kind' || CAST(l_linenumber % 3 AS STRING)"),
    S.WALL_HR: ((), "l_quantity"),
    S.CPUS: ((), "CAST(l_linenumber AS BIGINT)"),
    S.CORE_HR: ((), "l_quantity * l_linenumber"),
    S.CPU_HR: ((), "l_quantity * (1 - l_discount)"),
    S.JOB_TYPE: ((), "CASE l_linestatus WHEN 'F' THEN 'analysis' ELSE 'production' END"),
    S.DATASET: (("part",), f"CASE WHEN l_partkey % 97 <> 0 THEN {_DATASET_NAME} END"),
    S.BLOCK: (("part",), "CASE WHEN l_partkey % 10 = 0 THEN 'MCFakeBlock' WHEN l_partkey % 97 <> 0 THEN "
                         f"{_DATASET_NAME} || '#' || CAST(l_partkey AS STRING) END"),
    S.EXIT_CODE: ((), f"CAST({_CODE} AS BIGINT)"),
    S.WRAPPER_EXIT_CODE: ((), f"CAST(CASE WHEN l_linenumber < 7 THEN {_CODE} END AS BIGINT)"),
    S.RUN_EXIT_CODE: ((), f"CAST(CASE WHEN {_TAX} IN (0, 6) THEN {_CODE} END AS BIGINT)"),
    S.JOB_EXIT_CODE: ((), f"CAST(coalesce({_CODE}, 1) AS BIGINT)"),
    S.TOOL: (("orders",), "CASE o_orderpriority WHEN '1-URGENT' THEN 'InteractiveTool' ELSE 'CRAB' END"),
    S.TASK: ((), "'task_' || CAST(l_orderkey % 5000 AS STRING)"),
    S.CMS_TASK_TYPE: (("orders",), "lower(o_orderpriority)"),
    S.TASK_TYPE: (("orders",), "o_orderpriority"),
    S.USER: (("orders",), "CAST(o_custkey AS STRING)"),
    S.USER_NAME: (("orders",), "CAST(o_custkey % 500 AS STRING)"),
    S.WORKFLOW: ((), "CAST(l_orderkey AS STRING)"),
}
_JOIN = {"orders": "l_orderkey = o_orderkey", "part": "l_partkey = p_partkey"}


def jobs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Job records with ``columns`` (all by default), id and time; only the tables
    those columns come from are joined."""
    names = list(dict.fromkeys([S.JOB_ID, *(columns or JOB_COLUMNS)]))
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for table in sorted({t for n in names if n != S.RECORD_TIME for t in JOB_COLUMNS[n][0]}):
        df = df.join(spark.read.parquet(f"{sf_dir}/{table}.parquet"), F.expr(_JOIN[table]))
    return df.select(F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias(S.RECORD_TIME),
                     *(F.expr(JOB_COLUMNS[n][1]).alias(n) for n in names if n != S.RECORD_TIME))


JOBS_CTE = ("raw AS (SELECT epoch_ms(l_shipdate) AS RecordTime, "
            + ", ".join(f"{sql} AS {name}" for name, (_, sql) in JOB_COLUMNS.items())
            + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)")

# --- job records from events ---------------------------------------------------
# Each user works on one part: its dataset and block.
EVENT_COLUMNS = {
    S.JOB_ID: "'e' || CAST((event_id - event_id % 2) AS STRING)",
    S.SITE: "'T1_' || CAST(user_id % 5 AS STRING)",
    S.INPUT_DATA: "CASE user_id % 3 WHEN 0 THEN 'Onsite' WHEN 1 THEN 'Offsite' END",
    S.TIER: "CASE user_id % 4 WHEN 0 THEN 'RAW' WHEN 1 THEN 'AOD' WHEN 2 THEN 'MINIAOD' ELSE 'Unknown' END",
    S.STATUS: "CASE event_type WHEN 'click' THEN 'Completed' WHEN 'view' THEN 'Removed' "
              "WHEN 'purchase' THEN 'Held' WHEN 'error' THEN 'Error' ELSE 'Running' END",
    S.OVERFLOW: "CASE WHEN user_id % 6 = 0 THEN 'Frontier' END",
    S.WALL_HR: "value",
    S.CPUS: "1 + event_id % 8",
    S.CORE_HR: "value * (1 + event_id % 8)",
    S.CPU_HR: "value * 0.25 * (1 + user_id % 4)",
    S.JOB_TYPE: "CASE WHEN user_id % 2 = 0 THEN 'analysis' ELSE 'production' END",
    S.DATASET: f"CASE WHEN user_id % 97 <> 0 THEN {_DATASET_NAME} END",
    S.BLOCK: f"CASE WHEN user_id % 7 = 0 THEN 'MCFakeBlock' ELSE {_DATASET_NAME} || '#' || CAST(p_partkey AS STRING) END",
    S.TASK: "'task_' || CAST(event_id % 100 AS STRING)",
    S.EXIT_CODE: "CAST(CASE event_type WHEN 'error' THEN 8028 WHEN 'view' THEN 50660 "
                 "WHEN 'purchase' THEN NULL ELSE 0 END AS BIGINT)",
    S.TOOL: "CASE WHEN user_id % 5 = 0 THEN 'InteractiveTool' ELSE 'CRAB' END",
}


def events_as_jobs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    names = list(dict.fromkeys([S.JOB_ID, *(columns or EVENT_COLUMNS)]))
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    if any("p_" in EVENT_COLUMNS[n] for n in names if n != S.RECORD_TIME):
        df = df.join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.expr("user_id = p_partkey"))
    return df.select(F.unix_millis(F.col("ts").cast("timestamp")).alias(S.RECORD_TIME),
                     *(F.expr(EVENT_COLUMNS[n]).alias(n) for n in names if n != S.RECORD_TIME))


EVENTS_CTE = ("raw AS (SELECT epoch_us(ts) // 1000 AS RecordTime, "
              + ", ".join(f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items()) + " FROM events JOIN part ON user_id = p_partkey)")

# --- catalogue from part -------------------------------------------------------
# Some file sizes are NULL, some files have no dataset, some datasets no file.
_BRAND_NO = "CAST(substr(p_brand, 7) AS BIGINT)"
_DATASET_NO = (f"{_BRAND_NO} * 10 + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 "
               "WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END")
_SIZE = "CAST(CASE WHEN p_partkey % 50 <> 0 THEN p_size END AS BIGINT)"
FILES_SQL = (f"SELECT p_name || '_' || CAST(p_partkey AS STRING) AS f_logical_file_name, {_SIZE} AS f_file_size, "
             f"{_DATASET_NO} AS f_dataset_id, p_partkey AS f_block_id FROM part")
DATASETS_SQL = (f"SELECT DISTINCT {_DATASET_NO} AS d_dataset_id, {_DATASET_NAME} AS d_dataset FROM part "
                f"WHERE {_BRAND_NO} % 7 <> 0 UNION ALL "
                "SELECT 1000 + CAST(n_nationkey AS BIGINT), '/empty/' || n_name || '/RAW' FROM nation")
BLOCKS_SQL = (f"SELECT {_DATASET_NAME} || '#' || CAST(p_partkey AS STRING) AS b_block_name, "
              "CAST(p_size AS BIGINT) * 1000 AS b_block_size FROM part WHERE p_partkey % 11 <> 0")


def _catalogue(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "nation") if f"FROM {t}" in sql}
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **tables)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir, FILES_SQL)


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir, DATASETS_SQL)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir, BLOCKS_SQL)


CATALOGUE_CTES = (f"files AS ({FILES_SQL}), datasets AS ({DATASETS_SQL}), blocks AS ({BLOCKS_SQL}), "
                  "dataset_size AS (SELECT d_dataset, CAST(sum(f_file_size) AS BIGINT) AS Dataset_Size "
                  "FROM datasets LEFT JOIN files ON d_dataset_id = f_dataset_id GROUP BY d_dataset), "
                  "file_size AS (SELECT d_dataset AS dataset, CAST(sum(f_file_size) AS BIGINT) AS sum_file_size "
                  "FROM files LEFT JOIN datasets ON f_dataset_id = d_dataset_id GROUP BY d_dataset), "
                  "block_size AS (SELECT b_block_name, b_block_size AS Block_Size FROM blocks)")

# --- the cleaning step as SQL --------------------------------------------------
FINAL = "Status IN ('Completed', 'Removed', 'Held', 'Error')"


def clean_cte(keep: list[str], where: str = "TRUE", keys: str = "GlobalJobId", name: str = "clean",
              extra: str = "") -> str:
    """Filter, then the newest record per key, ties by all other columns in name order."""
    columns = list(dict.fromkeys(["GlobalJobId", "RecordTime", *keep]))
    listed = ", ".join(columns) + (f", {extra}" if extra else "")
    skip = {"RecordTime", *(k.strip() for k in keys.split(","))}
    ties = "".join(f", {c} ASC NULLS FIRST" for c in sorted(columns) if c not in skip)
    return (f"{name}_kept AS (SELECT {listed} FROM raw WHERE {where}), {name} AS (SELECT * FROM {name}_kept "
            f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY RecordTime DESC NULLS LAST{ties}) = 1)")


DAY = "CAST(make_timestamp(RecordTime * 1000) AS DATE)"
