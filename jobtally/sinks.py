"""Writers: Parquet extracts, one job for all days, and session views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from jobtally import schemas as S
from jobtally.operators import packing


def write_parquet(df: DataFrame, path: str, compression: str | None = None,
                  mode: str = "errorifexists") -> None:
    """Write as Parquet; by default an existing path is an error."""
    writer = df.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows, written once and read back: what stands above is computed one time, and a lost executor costs no more
    than its own tasks. The table lives until :func:`remove_inputs` or whoever owns the folder deletes it."""
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_inputs(df: DataFrame, below: str) -> list[str]:
    """Delete the folders below ``below`` that ``df`` reads, once nothing needs it any more. Gives the deleted folders."""
    spark = df.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = paths(below)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = fs.makeQualified(top).toString().rstrip("/") + "/"
    mine = {"/".join(f.split("/")[: own.count("/") + 1]) for f in (fs.makeQualified(paths(x)).toString() for x in df.inputFiles())
            if f.startswith(own)}
    for folder in sorted(mine):
        fs.delete(paths(folder), True)
    return sorted(mine)


def write_by(df: DataFrame, path: str, keys: Sequence[str] = (S.RECORD_DATE,),
             compression: str | None = None, replace: bool = False, *, pack: bool = True, begun: bool = False,
             complete: bool = True) -> None:
    """Write one partition per key value, all of them in one job.

    The rebalance gathers each value's rows into files of the advisory size: small
    days share no needless files, a very big day is split over several tasks. Texts and
    whole numbers of a wide table go there as one column, taken apart before the writing.
    ``replace`` overwrites just the partitions that the rows fall into. Without ``pack`` the rows go as they are, which
    takes less CPU. A table written in several calls is ``begun`` after the first and ``complete`` with the last,
    which leaves the mark of success.
    """
    whole = [c for c in df.columns if c not in keys and packing.packable(df.schema[c])]
    narrow, _, unpacked = packing.packed(df, [whole] if pack and len(whole) >= packing.LEAST else [])
    balanced = df.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(keys)}) */ * FROM {{rows}}", rows=narrow)
    writer = unpacked(balanced).write.partitionBy(*keys)
    if compression:
        writer = writer.option("compression", compression)
    if replace:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append" if begun else "errorifexists")
    if not complete:
        writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    writer.parquet(path)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """Add the rows to a table on its way: a folder per value of ``part``, as many files as tasks, no shuffle."""
    df.write.mode("append").option("compression", "zstd").partitionBy(part).parquet(path)


def read_part(like: DataFrame, path: str) -> DataFrame:
    """The rows of one folder of :func:`write_parts`, with the columns of ``like``; none if nothing was written there."""
    spark = like.sparkSession
    return spark.read.schema(like.schema).parquet(path) if exists(spark, path) else like.limit(0)


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all below it."""
    _file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def _file_system(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json_by(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Nested records as JSON in one folder per key value."""
    balanced = df.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(keys)}) */ * FROM {{rows}}", rows=df)
    balanced.write.mode("errorifexists").partitionBy(*keys).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A catalogue dump: no header, ``null`` for NULL."""
    df.write.mode("errorifexists").option("nullValue", "null").csv(path)


def register_view(df: DataFrame, name: str) -> SparkSession:
    """Make the rows known to SQL text of this session under ``name``."""
    df.createOrReplaceTempView(name)
    return df.sparkSession
