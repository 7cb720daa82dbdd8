"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of the pivots by nearness to it. Pivots are vectors of the table itself, a bounded
sample chosen by a hash. Every vector is posted in the inverted files of its `POSTED` nearest pivots; long files are cut
into slices of about `SLICE` vectors. A query is sent to the files of its nearest pivots only, ranks what it finds there by
footrule distance (the sum of differences of pivot positions), and what is near enough by it is ranked again by cosine in
double precision on the original vectors. A vector met in several files counts in the one whose pivot is nearest to the query.

How many files a query reads and which footrule is near enough are measured, not fixed: for at most `MEASURED` queries,
chosen by a hash, the true neighbours are found by comparing them with the whole table, in time proportional to it, and the
smallest bounds are taken that hold for `COVERED` of these neighbours each. So a table in clusters is read in a few files,
and one without structure in many, at the same recall. Every query reads as many files as hold `LEAST` vectors, and as
many of these as it has to give are ranked again at any footrule. A table with no more vectors than pivots is compared whole.

The vectors are moved `POSTED` times, whatever the number of queries. A task holds one slice and lets the queries
that read it stream by. Equal vectors are one entry that holds its smallest ids, so copies neither crowd a file nor a task.

Cases: null, empty or zero vectors and those with null or non-finite components take no part; vectors of each length are
searched among themselves, since there is no cosine between different ones; rows without an id take no part; repeated rows
count once, rows of one id with different vectors are separate candidates, and such queries share one ranking; with fewer
candidates than asked for, all are given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobtally.llm.work import removed, tasks, unit, written

PIVOTS, POSTED = 256, 2
MEASURED, COVERED = 128, 0.98
LEAST = 64  # vectors that a query finds at least: all, if there are fewer
SLICE = 8_192
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite, complete and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def positions(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The position of every pivot (0 to 255) in the order of pivots by nearness to each vector."""
    order = np.argsort(-(_unit(vectors) @ pivots.T), axis=1, kind="stable")
    place = np.empty(order.shape, np.uint8)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return place


def files_of(place: np.ndarray, posted: int = POSTED) -> np.ndarray:
    """The pivots in whose files each vector stands."""
    posted = min(posted, place.shape[1])
    return np.nonzero(place < posted)[1].reshape(len(place), posted)


def footrule(place: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The footrule distance of many orders from one: 32,768 at most for 256 pivots."""
    return (np.maximum(place, one) - np.minimum(place, one)).sum(axis=1, dtype=np.uint16)


class Codes:
    """Vectors and positions as bytes, which is how they travel."""

    def __init__(self, width: int, kind: str, pivots: np.ndarray):
        self.width, self.kind, self.pivots = width, np.dtype(kind), pivots

    def column(self, vector: str) -> Column:
        @F.arrow_udf("struct<vector: binary, place: binary>")
        def run(column: pa.Array) -> pa.Array:
            flat = np.asarray(column.flatten()).astype(self.kind, copy=False).reshape(-1, self.width)
            place = positions(flat, self.pivots) if len(flat) else flat
            return pa.StructArray.from_arrays([pa.array([row.tobytes() for row in part], pa.binary()) for part in (flat, place)],
                                              names=["vector", "place"])

        return run(vector)

    def of(self, batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and positions of a batch."""
        vector, place = (b"".join(batch.column(name).to_pylist()) for name in ("vector", "place"))
        return (_unit(np.frombuffer(vector, self.kind).reshape(-1, self.width)),
                np.frombuffer(place, np.uint8).reshape(-1, len(self.pivots)))


def bounds(index: DataFrame, asked: DataFrame, codes: Codes, k: int, seed: str) -> tuple[int, int]:
    """(files to read, footrule that is near enough), measured on the true neighbours of a bounded sample of queries."""
    sample = asked.orderBy(unit("id", seed), "id", "vector").limit(MEASURED).select("vector", "place").toArrow()
    if not len(sample):
        return 0, 0
    questions, places = codes.of(sample)

    def nearest_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, place = codes.of(batch)
            posts = files_of(place)
            keep = min(k + 1, len(x))
            rows = []
            for nr, (q, mine) in enumerate(zip(questions, places)):
                cosine = x @ q
                at = np.argpartition(-cosine, keep - 1)[:keep]
                rows.append((np.full(keep, nr), cosine[at], mine[posts[at]].min(axis=1).astype(np.int32),
                             footrule(place[at], mine).astype(np.int32)))
            yield pa.record_batch([pa.array(np.concatenate(part)) for part in zip(*rows)], ["nr", "cosine", "file", "footrule"])

    # The nearest vector of a query of the table is the query itself.
    order = W.partitionBy("nr").orderBy(F.desc("cosine"), "footrule", "file")
    near = (index.select("vector", "place").mapInArrow(nearest_in, "nr long, cosine double, file int, footrule int")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank").between(2, k + 1))
            .select("file", "footrule").toArrow())
    if not len(near):
        return 0, 0
    file, far = (int(np.quantile(near.column(name).to_numpy(), COVERED, method="higher")) for name in ("file", "footrule"))
    return file + 1, far


def answers(questions: tuple[np.ndarray, np.ndarray], pivot: int, sure: np.ndarray, entries: tuple[np.ndarray, np.ndarray],
            near: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query that reads the file of a pivot: which entries are ranked again, and their cosines.

    Of a sure file `least` entries are, or all, even if they are not `near`.
    """
    x, place = entries
    posts = files_of(place)
    for q, mine, certain in zip(*questions, sure):
        here = np.flatnonzero(mine[posts].min(axis=1) == mine[pivot])
        far = footrule(place[here], mine)
        limit = near
        if certain and len(here):
            limit = max(limit, int(np.partition(far, min(least, len(here)) - 1)[min(least, len(here)) - 1]))
        chosen = here[far <= limit]
        yield chosen, x[chosen] @ q


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding",
            seed: str = "pivots") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every row where `is_query`."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    parts = [_nearest(rows.filter(F.size("vector") == d), d, k, seed) for d in lengths]
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, parts) if parts else none


def _nearest(rows: DataFrame, width: int, k: int, seed: str) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    kind = "f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "f8"
    rows = rows.distinct()
    first = W.partitionBy("vector").orderBy("id")
    entries = written(rows.select("id", "vector").withColumn("nr", F.dense_rank().over(first)).filter(F.col("nr") <= k + 1)
                      .groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")), "entries")
    sample = (entries.select("vector", F.col("ids")[0].alias("id")).orderBy(unit("id", seed), "id", "vector").limit(PIVOTS)
              .select("vector").collect())
    codes = Codes(width, kind, _unit(np.array([r.vector for r in sample], float)))
    n_pivots = len(sample)

    @F.arrow_udf("array<int>")
    def posted(place: pa.Array) -> pa.Array:
        found = np.frombuffer(b"".join(place.to_pylist()), np.uint8).reshape(-1, n_pivots)
        return pa.array(files_of(found).tolist(), pa.list_(pa.int32()))

    index = written(entries.select("ids", codes.column("vector").alias("code")).select("ids", "code.*"), "index")
    removed(entries)
    asked = written(rows.filter("asks").select("id", codes.column("vector").alias("code")).select("id", "code.*"), "queries")
    posts = index.withColumn("pivot", F.explode(posted("place")))
    sizes = np.zeros(n_pivots, int)
    for r in posts.groupBy("pivot").count().collect():
        sizes[r["pivot"]] = r["count"]
    # No more vectors than pivots: nothing to choose from.
    depth, near = bounds(index, asked, codes, k, seed) if sizes.sum() > n_pivots * min(POSTED, n_pivots) else (n_pivots, 1 << 15)
    enough = LEAST * min(POSTED, n_pivots)

    @F.arrow_udf("array<struct<pivot: int, sure: boolean>>")
    def read(place: pa.Array) -> pa.Array:
        out = []
        for mine in np.frombuffer(b"".join(place.to_pylist()), np.uint8).reshape(-1, n_pivots):
            order = np.argsort(mine)
            sure = np.cumsum(sizes[order]) - sizes[order] < enough
            out.append([{"pivot": int(p), "sure": bool(s)} for at, (p, s) in enumerate(zip(order, sure)) if (s or at < depth) and sizes[p]])
        return pa.array(out, pa.list_(pa.struct([("pivot", pa.int32()), ("sure", pa.bool_())])))

    slices = F.element_at(F.array(*(F.lit(int(-(-n // SLICE))) for n in sizes)), F.col("pivot") + 1)
    left = (posts.withColumn("slice", F.pmod(F.xxhash64("vector"), slices).cast("int"))
            .select("pivot", "slice", F.lit(False).alias("asks"), F.lit(False).alias("sure"), "ids", "vector", "place"))
    right = (asked.withColumn("read", F.explode(read("place"))).select("id", "vector", "place", "read.*")
             .withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
             .select("pivot", "slice", F.lit(True).alias("asks"), "sure", F.array("id").alias("ids"), "vector", "place"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: the vectors of a slice, then the queries that read it, then the next slice."""
        at, held, entries = None, [], None
        for batch in batches:
            key = np.stack([batch.column(name).cast(pa.int32()).to_numpy(zero_copy_only=False) for name in ("pivot", "slice", "asks")])
            starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if (key[0, start], key[1, start]) != at:
                    at, held, entries = (key[0, start], key[1, start]), [], None
                if not key[2, start]:
                    held.append(part)
                    continue
                if entries is None and held:
                    table = pa.Table.from_batches(held)
                    entries, ids, held = codes.of(table), table.column("ids").to_pylist(), []
                if entries is None:
                    continue
                out = []
                sure = part.column("sure").to_numpy(zero_copy_only=False)
                found = answers(codes.of(part), at[0], sure, entries, near, k + 1)
                for (own,), (chosen, cosine) in zip(part.column("ids").to_pylist(), found):
                    # As far as k + 1 entries that tie with the last may go, their smallest ids decide.
                    if len(cosine) > k + 1:
                        keep = cosine >= np.partition(cosine, -(k + 1))[-(k + 1)]
                        chosen, cosine = chosen[keep], cosine[keep]
                    hits = sorted((-c, i) for e, c in zip(chosen, cosine.tolist()) for i in ids[e] if i != own)[:k]
                    out.extend((own, i, -c) for c, i in hits)
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
                                          ["query_id", "vec_id", "score"])

    found = (left.union(right).repartition(tasks(spark), "pivot", "slice")
             .sortWithinPartitions("pivot", "slice", "asks").mapInArrow(compared, FOUND))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
