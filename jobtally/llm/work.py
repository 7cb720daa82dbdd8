"""Where intermediate tables go, and small helpers that the operators share.

Tables that cut lineage are Parquet in the folder of ``spark.checkpoint.dir``, which all executors see, so a lost
executor costs no more than the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtally.llm import arrays as A
from jobtally.session import shared_folder

def written(frame: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read again."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path, partitionBy=by)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(frame: DataFrame) -> None:
    """Delete a table made by `written` that nothing reads any more."""
    spark = frame.sparkSession
    jvm = spark.sparkContext._jvm
    tops = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
    for top in tops:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


MARK_BITS = 1 << 27
SLICE = 1 << 19  # bytes of text that a task looks at together, so that work arrays stay small


class Marks:
    """Which of many whole numbers may be in a set: one bit for each place a hash can take, 16 MB at most.

    A number of the set is always found; of the others one in sixteen is found too while the set is small against the
    bits, and more as it grows. So it only spares work: what it lets through has to be joined with the set itself.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        return (A.mixed(keys.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)

    @classmethod
    def of(cls, keys: DataFrame) -> Marks:
        """Marks of the one long column of `keys`; tasks send the words they set, which are put together before the driver sees them."""
        bits = min(MARK_BITS, 1 << max(10, (16 * keys.count()).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(cls.places(batch.column(0).drop_null().to_numpy(), bits))
                if len(at):
                    word, first = np.unique(at >> 6, return_index=True)
                    value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                    yield pa.record_batch([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

        found = keys.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
        return cls(words)

    def hold(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, 64 * len(self.words))
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def sent(self, spark: SparkSession) -> Callable[[np.ndarray], np.ndarray]:
        """A function for tasks, which get the bits once each executor."""
        held = spark.sparkContext.broadcast(self.words)
        return lambda keys: Marks(held.value).hold(keys)


def marked(column: Column | str, holds: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Whether a long may be in the set of the marks sent; null is not."""
    @F.arrow_udf("boolean")
    def run(keys: pa.Array) -> pa.Array:
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(known & holds(keys.fill_null(0).to_numpy(zero_copy_only=False)))

    return run(column)


def unit(column: Column | str, seed: str = "") -> Column:
    """A fixed number in [0, 1) from a value: the same in every run and on every layout."""
    column = F.col(column) if isinstance(column, str) else column
    return (F.xxhash64(F.lit(seed), column.cast("string")).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `most` bytes of text, so that work arrays stay small. A longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.large_string()).fill_null("")
        ends = pa.compute.cumulative_sum(pa.compute.binary_length(sizes)).to_numpy()
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def by_runs(values: Callable, kind: str, rows: int = 256) -> Callable:
    """An Arrow function of several columns, made from a function of a few rows of them, whose result is given back at once."""
    @F.arrow_udf(kind)
    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in columns:
            for first in range(0, len(batch[0]), rows):
                yield values(*(c.slice(first, rows) for c in batch))
            pa.default_memory_pool().release_unused()

    return run


def by_slices(values: Callable, kind: str, most: int = SLICE) -> Callable:
    """An Arrow function of one text column, made from a function of small batches, of about `most` bytes, that gives an array.

    Every small batch is given back as soon as it is done: a task holds the result of one, not of all.
    """
    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            for part in slices(iter([pa.record_batch([column], ["text"])]), "text", most):
                yield pa.array(values(part))
            # What a worker has used once it keeps for its next task; idle ones should not hold much.
            pa.default_memory_pool().release_unused()

    return run
