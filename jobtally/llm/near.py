"""Near duplicates by SetSketch registers.

A text's set of word shingles is kept as registers: for each of `REGISTERS` hash functions, the exponentially spaced
and truncated level of the smallest value in the set. Registers of a union are the larger of both, and similar sets
share registers. Groups of registers are bands; texts that agree in a band are candidates. For a candidate pair the
Jaccard index is estimated by the likelihood of its larger, smaller and equal registers given both set sizes, pairs
that are clearly below the bound are dropped, and the rest is verified on the full sets.

No bucket is expanded into all its pairs. Texts with equal sets are one class. Every class is first compared with the
one hub of its buckets that shares most buckets with others. What is then still in more than one component of a bucket
is compared with the rest of the bucket, in blocks, so that no link is lost.

Cases: a null or wordless text has an empty set and no link; fewer words than a shingle make one shingle; repeated rows
are copies of each other; different texts under one id are documents of their own, each with its own links; rows without an id are
counted, but take no part in links (component null, kept).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtally.llm import arrays as A
from jobtally.llm.components import components
from jobtally.llm.work import by_slices, removed, tasks, written
from jobtally.operators.joins import split_lookup

REGISTERS, BANDS = 240, 40
BASE, RATE, LEVELS = 1.02, 20.0, 60_000
DEVIATIONS = 4.0
BLOCK, BLOCK_SHINGLES = 256, 1 << 18

_draw = np.random.default_rng(20250801)
_TIMES = _draw.integers(0, 1 << 64, REGISTERS, np.uint64) | np.uint64(1)
_PLUS = _draw.integers(0, 1 << 64, REGISTERS, np.uint64)
_ORDER = _draw.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, by row and hash. A-Z count as a-z."""
    data, bounds = A.utf8(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    spans = A.runs(A.not_white()[data], bounds)
    own = A.Hashes(data).of(spans.start, spans.end)
    n = len(bounds) - 1
    size = A.counts(spans.row, n)
    first = np.cumsum(size) - size
    total = np.zeros(max(0, len(own) - words + 1), np.uint64)
    for k in range(words):
        total += own[k : k + len(total)] * _ORDER[k]
    inside = spans.row[: len(total)] == spans.row[words - 1 : words - 1 + len(total)]
    rows, hashes = [spans.row[: len(total)][inside]], [A.mixed(total[inside])]
    for few in range(1, words):
        short = np.flatnonzero(size == few)
        total = np.full(len(short), few, np.uint64)
        for k in range(few):
            total += own[first[short] + k] * _ORDER[k]
        rows.append(short)
        hashes.append(A.mixed(total))
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[once], value[once]


def registers(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The SetSketch of every row as (rows, REGISTERS) levels; 0 for an empty set."""
    out = np.zeros((n, REGISTERS), np.uint16)
    if not len(row):
        return out
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    filled = row[first]
    least = np.empty((REGISTERS, len(first)), np.uint64)
    work = np.empty_like(value)
    for j in range(REGISTERS):
        np.multiply(value, _TIMES[j], out=work)
        work += _PLUS[j]
        least[j] = np.minimum.reduceat(work, first)
    share = (least.astype(np.float64) + 0.5) / 2.0**64
    level = np.floor(1 - np.log(-np.log1p(-np.minimum(share, 1 - 1e-16)) / RATE) / np.log(BASE))
    out[filled] = np.clip(level, 0, LEVELS).astype(np.uint16).T
    return out


def sketch(text: Column | str, words: int) -> Column:
    """Set size, two sums that name the set, and its registers."""
    def values(part: pa.RecordBatch) -> pa.Array:
        n = part.num_rows
        row, value = shingles(part.column("text"), words)
        size = A.counts(row, n)
        names = []
        for salt in (1, 2):
            total = np.zeros(n, np.uint64)
            if len(row):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                total[row[first]] = np.add.reduceat(A.mixed(value * np.uint64(2 * salt + 1)), first)
            names.append(pa.array(total.view(np.int64)))
        levels = registers(row, value, n)
        bounds = pa.array(np.arange(n + 1, dtype=np.int32) * 2 * REGISTERS)
        packed = pa.Array.from_buffers(pa.binary(), n, [None, bounds.buffers()[1], pa.py_buffer(levels.tobytes())])
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), *names, packed],
                                          ["n", "name1", "name2", "registers"])

    return by_slices(values, "n long, name1 long, name2 long, registers binary")(text)


def _levels(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(registers: Column | str) -> Column:
    """One key for every band of a sketch: equal where all registers of the band are."""
    @F.arrow_udf("array<long>")
    def keys_of(column: pa.Array) -> pa.Array:
        levels = _levels(column).astype(np.uint64).reshape(-1, BANDS, REGISTERS // BANDS)
        keys = np.zeros(levels.shape[:2], np.uint64)
        for k in range(levels.shape[2]):
            keys = A.mixed(keys * np.uint64(31) + levels[:, :, k] + np.uint64(1))
        keys = A.mixed(keys + np.arange(BANDS, dtype=np.uint64))
        bounds = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
        return pa.ListArray.from_arrays(bounds, pa.array(keys.ravel().view(np.int64)))

    return keys_of(registers)


def _spaced(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def plausible(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether a Jaccard index of `least` or more is likely enough, given the counts of larger and smaller registers.

    The joint likelihood of the counts is maximised over the index; a pair is dropped if the maximum lies below `least`
    by more than `DEVIATIONS` standard deviations of the likelihood ratio, or if the sizes alone forbid it.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    equal = REGISTERS - larger - smaller

    def likelihood(j):
        up, down = _spaced(u - v * j), _spaced(v - u * j)
        logs = [np.log(np.maximum(x, 1e-12)) for x in (up, down, 1 - up - down)]
        return larger * logs[0] + smaller * logs[1] + equal * logs[2]

    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0, 1, 33):
        now = likelihood(top * share)
        better = now > best
        best, at = np.where(better, now, best), np.where(better, top * share, at)
    bound = likelihood(np.minimum(top, least))
    return (top >= least - 1e-9) & ((at >= least) | (best - bound <= DEVIATIONS**2 / 2))


def _plausible_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the bound."""
    @F.arrow_udf("boolean")
    def test(reg_a: pa.Array, reg_b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        a, b = _levels(reg_a), _levels(reg_b)
        return pa.array(plausible((a > b).sum(axis=1), (a < b).sum(axis=1), n_a.to_numpy().astype(float),
                                  n_b.to_numpy().astype(float), least))

    side = lambda x: sets.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"reg_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(test("reg_a", "reg_b", "n_a", "n_b")).select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the bound."""
    side = lambda x: sets.select(F.col("v").alias(x), F.col("set").alias(f"set_{x}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * common >= percent * union).select("a", "b")


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """Every class with the most connected other class of its buckets."""
    rank = buckets.groupBy("v").agg(F.sum("size").alias("weight"))
    ranked = buckets.join(rank, "v").select("key", "v", F.struct("weight", (-F.col("v")).alias("minus")).alias("rank"))
    top = ranked.groupBy("key").agg(F.max("rank").alias("top"))
    best = ranked.join(top, "key").groupBy("v").agg(F.max("top").alias("top"))
    return best.select(F.col("v").alias("a"), (-F.col("top.minus")).alias("b")).filter("a <> b")


def _blocks(member: DataFrame) -> DataFrame:
    """Members (key, band, v, component, n, ...) of open buckets, dealt into blocks (i, j) of bounded rows and shingles.

    The left side of the blocks holds what is outside a bucket's largest component, the right side all members.
    """
    held = member.groupBy("key", "component").agg(F.count("*").alias("held"), F.sum("n").alias("width"))
    main = held.groupBy("key").agg(F.max(F.struct("held", "component", "width")).alias("main"),
                                   F.sum("held").alias("total"), F.sum("width").alias("all"))
    parts = lambda rows, width: F.ceil(F.greatest(rows / BLOCK, width / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    main = main.select("key", F.col("main.component").alias("main"), parts(F.col("total"), F.col("all")).alias("columns"),
                       parts(F.col("total") - F.col("main.held"), F.col("all") - F.col("main.width")).alias("rows"))
    dealt = member.join(main, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n, salt: F.pmod(F.xxhash64("v", F.lit(salt)), n).cast("int")
    left = dealt.filter("component <> main").select(
        *member.columns, F.lit(True).alias("left"), place("rows", 1).alias("i"), every("columns").alias("j"))
    right = dealt.select(
        *member.columns, F.lit(False).alias("left"), every("rows").alias("i"), place("columns", 2).alias("j"))
    # By number: little data, but much work in each block, so tasks should not be merged for their small size.
    return left.union(right).repartition(tasks(member.sparkSession), "key", "i", "j")


def _cross(block: pd.DataFrame, least: float):
    """For every left row of a block: the plausible right rows of other components that share no earlier band, best first."""
    enough = REGISTERS * least - DEVIATIONS * np.sqrt(REGISTERS * least * (1 - least))
    a, b = block[block["left"]], block[~block["left"]]
    if not len(a) or not len(b):
        return
    own, levels = (np.frombuffer(b"".join(side["registers"]), np.uint16).reshape(-1, REGISTERS) for side in (a, b))
    part_a, part_b = a["component"].to_numpy(), b["component"].to_numpy()
    band, rows, hits, equal = int(block["band"].iloc[0]), [], [], []
    for at in range(len(a)):
        same = levels == own[at]
        n_same = np.count_nonzero(same, axis=1)
        hit = np.flatnonzero((n_same >= enough) & (part_b != part_a[at]))
        hit = hit[~same[hit, : band * (REGISTERS // BANDS)].reshape(len(hit), band, REGISTERS // BANDS).all(axis=2).any(axis=1)]
        rows.append(np.full(len(hit), at))
        hits.append(hit)
        equal.append(n_same[hit])
    rows, hits, equal = (np.concatenate(x) for x in (rows, hits, equal))
    larger = (own[rows] > levels[hits]).sum(axis=1)
    good = plausible(larger, REGISTERS - equal - larger, a["n"].to_numpy(float)[rows], b["n"].to_numpy(float)[hits], least)
    rows, hits, equal = rows[good], hits[good], equal[good]
    order = np.lexsort((-equal, rows))
    rows, hits = rows[order], hits[order]
    for at in np.unique(rows):
        yield a.iloc[at], b, hits[rows == at]


def _open_links(buckets: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components in buckets that hold several: at least one for every two components so linked.

    First the sketches alone tell which members have a plausible partner; only those bring their full sets.
    """
    least = percent / 100
    member = buckets.join(found, "v", "left").select("key", "band", "v", F.coalesce("component", "v").alias("component"))
    ends = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    member = member.join(ends.filter("low <> high").select("key"), "key")

    def partners(block: pd.DataFrame) -> pd.DataFrame:
        key, band = block["key"].iloc[0], block["band"].iloc[0]
        hit = set()
        for own, right, hits in _cross(block, least):
            hit.add(own["v"])
            hit.update(right["v"].to_numpy()[hits])
        return pd.DataFrame({"key": key, "band": band, "v": np.array(sorted(hit), np.int64)}, columns=["key", "band", "v"])

    def verified(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, right, hits in _cross(block, least):
            done = set()
            for v, part, other in zip(*(right[c].to_numpy()[hits] for c in ("v", "component", "set"))):
                if part not in done:
                    common = len(np.intersect1d(own["set"], other, assume_unique=True))
                    if 100 * common >= percent * (len(own["set"]) + len(other) - common):
                        done.add(part)
                        out.append((own["v"], v))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    blocks = ["key", "i", "j"]
    light = member.join(sets.select("v", "n", "registers"), "v")
    plausible_members = written(_blocks(light).groupBy(*blocks).applyInPandas(partners, "key long, band int, v long")
                                .distinct(), "open")
    full = plausible_members.join(found, "v", "left").select(
        "key", "band", "v", F.coalesce("component", "v").alias("component")).join(sets, "v")
    return _blocks(full).groupBy(*blocks).applyInPandas(verified, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept and a digest of the text, for links of at least `percent` Jaccard index.

    `component_id` is the smallest id that can be reached over links, the row's own included; `kept` marks it.
    """
    rows = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    digest = F.xxhash64("text").alias("digest")
    sketches = written(rows.select("doc", digest, sketch("text", words).alias("s")).select("doc", "digest", "s.*"), "sketches")
    named = ["n", "name1", "name2"]
    # Classes are numbered once, when they are written: an id can have texts of several.
    classes = written(sketches.filter("n > 0 AND doc IS NOT NULL").groupBy(*named).agg(F.min("doc").alias("of"))
                      .withColumn("v", F.monotonically_increasing_id()), "classes")
    first = sketches.join(classes, named).filter("doc = of").select("v", "n", "registers").dropDuplicates(["v"])
    keyed = first.select("v", F.posexplode(bands("registers")).alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = written(keyed.join(shared, "key"), "buckets")
    wanted = classes.join(buckets.select("v").distinct(), "v").select("v", "of", *(F.col(c).alias(f"of_{c}") for c in named))
    texts = rows.filter("doc IS NOT NULL").join(wanted, F.col("doc") == F.col("of"))
    own = texts.select("v", *(f"of_{c}" for c in named), sketch("text", words).alias("s"), shingle_set("text", words).alias("set"))
    own = own.filter(" AND ".join(f"s.{c} = of_{c}" for c in named))
    sets = written(own.select("v", "s.n", "s.registers", "set").dropDuplicates(["v"]), "sets")
    least = percent / 100
    near = written(_verified(_plausible_pairs(_hub_pairs(buckets), sets, least), sets, percent), "links")
    found = written(components(near), "components")
    all_links = written(near.union(_open_links(buckets, found, sets, percent)), "links")
    final = written(components(all_links), "components")
    for table in (buckets, sets, near, found):
        removed(table)
    members = classes.join(final, "v", "left").select(*named, "of", F.coalesce("component", "v").alias("component"))
    smallest = members.groupBy("component").agg(F.min("of").alias("of_class"), F.count("*").alias("members"))
    classes = split_lookup(members.select(*named, "component"), smallest, ["component"], size="members").select(*named, "of_class")
    return (sketches.join(classes, named, "left")
            .select(F.col("doc").alias(id), F.col("n").alias("n_shingles"), "digest",
                    F.when(F.col("n") > 0, F.col("of_class")).otherwise(F.col("doc")).alias("component"))
            .select(id, "n_shingles", F.when(F.col(id).isNotNull(), F.col("component")).alias("component_id"), "digest")
            .withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
            .select(id, "n_shingles", "component_id", "kept", "digest"))


def shingle_set(text: Column | str, words: int) -> Column:
    """The distinct shingle hashes of a text, sorted."""
    def values(part: pa.RecordBatch) -> pa.Array:
        row, value = shingles(part.column("text"), words)
        bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64)))

    return by_slices(values, "array<long>")(text)
