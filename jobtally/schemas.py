"""Record layouts: field names, types and domain values of the inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# Field names of the job records. They are the input format.
RECORD_TIME = "RecordTime"
JOB_ID = "GlobalJobId"
SITE = "CMSSite"
INPUT_DATA = "InputData"
TIER = "CMSPrimaryDataTier"
STATUS = "Status"
OVERFLOW = "OverflowType"
WALL_HR = "WallClockHr"
CORE_HR = "CoreHr"
CPU_HR = "CpuTimeHr"
CPUS = "RequestCpus"
JOB_TYPE = "Type"
BLOCK = "CRAB_DataBlock"
EXIT_CODE = "ExitCode"
WRAPPER_EXIT_CODE = "Chirp_CRAB3_Job_ExitCode"
RUN_EXIT_CODE = "Chirp_WMCore_cmsRun_ExitCode"
JOB_EXIT_CODE = "JobExitCode"
TOOL = "CMS_SubmissionTool"
DATASET = "DESIRED_CMSDataset"
TASK = "CRAB_Workflow"
CMS_TASK_TYPE = "CMS_TaskType"
TASK_TYPE = "TaskType"
USER = "USER"
USER_NAME = "CRAB_UserHN"
WORKFLOW = "Workflow"

# Domain values the analyses test for.
FINAL_STATUSES = ("Completed", "Removed", "Held", "Error")
PRODUCTION, ANALYSIS = "production", "analysis"
ONSITE, OFFSITE = "Onsite", "Offsite"
MC_BLOCK = "MCFakeBlock"
UNKNOWN_TIER = "Unknown"
ANALYSIS_TOOL = "CRAB"
PROBE_MARK = "HC"  # part of the name of datasets used by site-test jobs

_STRINGS = (
    JOB_ID, SITE, INPUT_DATA, TIER, STATUS, OVERFLOW, JOB_TYPE, BLOCK, TOOL, DATASET,
    TASK, CMS_TASK_TYPE, TASK_TYPE, USER, USER_NAME, WORKFLOW,
)
_LONGS = (RECORD_TIME, CPUS, EXIT_CODE, WRAPPER_EXIT_CODE, RUN_EXIT_CODE, JOB_EXIT_CODE)
_DOUBLES = (WALL_HR, CORE_HR, CPU_HR)

JOB_TYPES = {
    **dict.fromkeys(_STRINGS, StringType()),
    **dict.fromkeys(_LONGS, LongType()),
    **dict.fromkeys(_DOUBLES, DoubleType()),
}

#: The fourteen columns of the daily clean extract.
EXTRACT_COLUMNS = (
    RECORD_TIME, SITE, INPUT_DATA, EXIT_CODE, TIER, STATUS, OVERFLOW, CPU_HR, WALL_HR,
    CPUS, CORE_HR, JOB_TYPE, BLOCK, JOB_ID,
)


def job_schema(columns: Iterable[str] | None = None) -> StructType:
    """Read schema of the nested records, with only ``columns`` under ``data``.

    A JSON scan parses every declared field, so the narrow schema is what prunes
    columns. A file source makes all fields nullable whatever is declared here.
    """
    names = list(JOB_TYPES) if columns is None else list(dict.fromkeys(columns))
    unknown = [n for n in names if n not in JOB_TYPES]
    if unknown:
        raise ValueError(f"not job-record fields: {unknown}")
    return StructType([StructField("data", StructType(
        [StructField(n, JOB_TYPES[n], n not in (RECORD_TIME, JOB_ID)) for n in names]
    ))])


# Catalogue tables. Dumps with more columns are read by passing their own schema.
FILE_NAME, FILE_SIZE = "f_logical_file_name", "f_file_size"
FILE_DATASET_ID, FILE_BLOCK_ID = "f_dataset_id", "f_block_id"
DATASET_ID, DATASET_NAME = "d_dataset_id", "d_dataset"
BLOCK_NAME, BLOCK_BYTES = "b_block_name", "b_block_size"

FILES_SCHEMA = StructType([
    StructField(FILE_NAME, StringType()), StructField(FILE_SIZE, LongType()),
    StructField(FILE_DATASET_ID, LongType()), StructField(FILE_BLOCK_ID, LongType()),
])
DATASETS_SCHEMA = StructType([
    StructField(DATASET_ID, LongType()), StructField(DATASET_NAME, StringType()),
])
BLOCKS_SCHEMA = StructType([
    StructField(BLOCK_NAME, StringType()), StructField(BLOCK_BYTES, LongType()),
])

# Columns our tables add.
DATASET_SIZE, BLOCK_SIZE = "Dataset_Size", "Block_Size"
FIRST_ACCESS, LAST_ACCESS = "First_Access", "Last_Access"
RECORD_DATE = "record_date"
