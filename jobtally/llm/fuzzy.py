"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over windows of seven UTF-8 bytes; where it is a multiple of the block size, a chunk ends. Every chunk
gives one of 64 characters, so a fingerprint is `block:signature:signature of twice the block`. The block size is the
smallest `LEAST_BLOCK * 2**k` that keeps the signature within `LENGTH` characters. Two fingerprints are compared where
their block sizes are equal or one is twice the other: by the edit distance (insertions and deletions cost one, a
replacement two) over the summed lengths, as a likeness from 0 to 1. Signatures without a common run of `RUN`
characters (or the whole, if shorter) have likeness 0.

Cases: null counts as empty; empty texts have no characters in their signatures and are alike only to each other; equal
texts have equal fingerprints and likeness 1; a text may be of any length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtally.llm import arrays as A
from jobtally.llm.work import tasks

LEAST_BLOCK, LENGTH, WINDOW, RUN = 3, 64, 7, 4
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
MOST_BYTES = 1 << 21
LEAST_ROWS = 1_000
DRAWN, LEAD = 100, 64  # texts looked at for each range of a hot id, and how many characters of each
LAST = -(1 << 63)  # null ids come after all others


def _levels(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often the rolling value at every byte, divided by LEAST_BLOCK, can be halved; -1 where LEAST_BLOCK doesn't divide it."""
    value = np.zeros(len(data), np.uint32)
    own = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    for k in range(WINDOW):
        shifted = own >> np.uint32(k + 3) ^ own << np.uint32(2 * k)
        value[k:] += shifted[: max(len(data) - k, 0)]
    # Bytes of the text before must not reach into the first windows of a text.
    reach = A.spread(bounds[:-1], np.minimum(np.diff(bounds), WINDOW - 1))
    value[reach] = own[reach] * np.uint32(40503) + np.uint32(1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    whole, rest = np.divmod(value, np.uint32(LEAST_BLOCK))
    whole |= np.uint32(1 << 31)
    low = (whole & (~whole + np.uint32(1))).astype(np.float64)
    return np.where(rest == 0, np.log2(low).astype(np.int8), np.int8(-1))


def fingerprints(texts: list[bytes]) -> list[str]:
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    level = _levels(data, bounds)
    hashes = A.Hashes(data)
    at = np.flatnonzero(level >= 0)
    row = np.searchsorted(bounds, at, side="right") - 1
    of = level[at]
    n = len(texts)
    # Ends of chunks by text and level, summed from the highest level down: signatures of every block size.
    depth = 33
    ends = np.bincount(row * depth + of, minlength=n * depth).reshape(n, depth)[:, ::-1].cumsum(axis=1)[:, ::-1]
    block = (ends + 1 > LENGTH).sum(axis=1)
    first, last = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), side="right")
    out = []
    for i in range(n):
        signatures = []
        for k in (block[i], block[i] + 1):
            end = at[first[i]:last[i]][of[first[i]:last[i]] >= k] + 1
            start = np.concatenate([bounds[i:i + 1], end])
            stop = np.concatenate([end, bounds[i + 1:i + 2]])
            if len(end) and stop[-1] == start[-1]:
                start, stop = start[:-1], stop[:-1]
            if bounds[i + 1] == bounds[i]:
                start = stop = start[:0]
            signatures.append(SIGNS[(hashes.of(start, stop) >> np.uint64(58)).astype(np.int64)].tobytes().decode())
        out.append(f"{LEAST_BLOCK << int(block[i])}:{signatures[0]}:{signatures[1]}")
    return out


def _padded(texts: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), LENGTH), filler, np.uint8)
    if len(texts):
        out.ravel()[A.spread(np.arange(len(texts)) * LENGTH, size)] = np.frombuffer("".join(texts).encode(), np.uint8)
    return out, size


def signature_likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of every pair of signatures. The common subsequence is found 64 positions at a time, one bit for each."""
    n = len(a)
    left, size_a = _padded(a, 0)
    right, size_b = _padded(b, 255)
    where = np.zeros((n, 256), np.uint64)
    every = np.arange(n)
    for k in range(LENGTH):
        where[every, left[:, k]] |= np.uint64(1) << np.uint64(k)
    where[:, 0] = 0
    state = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(LENGTH):
        hit = state & where[every, right[:, k]]
        state = (state + hit) | (state - hit)
    zeros = LENGTH - np.bitwise_count(state).astype(np.int64)
    total = size_a + size_b
    likeness = np.where(total > 0, 2 * zeros / np.maximum(total, 1), 1.0)
    # A common run: the same RUN characters anywhere in both.
    code_a, code_b = (sum(x[:, k:LENGTH - RUN + 1 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(RUN)) for x in (left, right))
    common = np.zeros(n, bool)
    for part in np.array_split(every, max(1, n // 256)):
        x, y = np.sort(code_a[part], axis=1), code_b[part]
        both = np.sort(np.concatenate([_once(x, 0), _once(np.sort(y, axis=1), 1)], axis=1), axis=1)
        common[part] = (both[:, 1:] == both[:, :-1]).any(axis=1)
    few = np.minimum(size_a, size_b) < RUN
    same = np.array([x == y for x, y in zip(a, b)], bool) if n else np.zeros(0, bool)
    return np.where(same, 1.0, np.where(~common | few, 0.0, likeness))


def _once(codes: np.ndarray, side: int) -> np.ndarray:
    """Sorted codes with repeats and incomplete runs replaced by values that occur nowhere else."""
    codes = codes.copy()
    unique = (np.uint64(1) << np.uint64(62)) + np.uint64(2 * LENGTH * side) + np.arange(codes.shape[1], dtype=np.uint64)
    again = np.zeros(codes.shape, bool)
    again[:, 1:] = codes[:, 1:] == codes[:, :-1]
    parts = codes[:, :, None] >> (np.arange(RUN, dtype=np.uint64) * np.uint64(8)) & np.uint64(255)
    open_end = ((parts == 0) | (parts == 255)).any(axis=2)
    return np.where(again | open_end, unique, codes)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of fingerprints, at the block size that both have."""
    split_a, split_b = ([x.split(":") for x in side] for side in (a, b))
    block_a, block_b = (np.array([int(x[0]) for x in side], np.int64) for side in (split_a, split_b))
    out = np.zeros(len(a))
    for ratio, pairs in ((0, ((1, 1), (2, 2))), (1, ((1, 2),)), (-1, ((2, 1),))):
        chosen = {0: block_a == block_b, 1: block_a == 2 * block_b, -1: block_b == 2 * block_a}[ratio]
        at = np.flatnonzero(chosen)
        for p, q in pairs if len(at) else ():
            got = signature_likeness([split_a[i][p] for i in at], [split_b[i][q] for i in at])
            out[at] = np.maximum(out[at], np.where(np.array([bool(split_a[i][p] or split_a[i][1] == split_b[i][1]) for i in at]), got, 0))
    return out


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by as many code points from the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _described(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    prints = fingerprints([t.encode() for t in [*texts, *changed, *following]])
    n = len(texts)
    own, new, following_print = prints[:n], prints[n:2 * n], prints[2 * n:]
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]), pa.array(own), pa.array(new),
         pa.array(likeness(own, new)), pa.array(likeness(own, following_print))],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _pairs(batches):
    """Rows come by bucket, then falling id; a row's next is the one behind it, in its own bucket."""
    held: tuple | None = None
    ids, texts, following, size = [], [], [], 0
    for batch in batches:
        for bucket, id_, text, guest in zip(*(batch.column(k).to_pylist() for k in ("bucket", "id", "text", "guest"))):
            if held is not None and held[0] == bucket:
                ids.append(held[1]), texts.append(held[2]), following.append(text)
                size += len(held[2]) + len(text)
            if size > MOST_BYTES:
                yield _described(ids, texts, following)
                ids, texts, following, size = [], [], [], 0
            held = None if guest else (bucket, id_, text)
    if ids:
        yield _described(ids, texts, following)


def _starts(rows: DataFrame) -> tuple[list[tuple[int, str]], list[int]]:
    """Where ranges of about as many rows each should start, as (down, lead), and the ids found hot, as `down`.

    An id that fills whole ranges is hot: its rows are cut again by the first characters of their texts, a bounded sample of
    which is looked at. Where the cuts lie decides only how even the ranges are.
    """
    downs = rows.select("down")
    n = downs.count()
    count = max(1, min(tasks(rows.sparkSession), -(-n // LEAST_ROWS)))
    if count == 1:
        return [], []
    shares = [(k + 1) / count for k in range(count - 1)]
    times = Counter(downs.agg(F.percentile_approx("down", shares, max(10_000, 20 * count))).first()[0])
    hot = sorted(m for m, r in times.items() if r > 1)
    leads: dict[int, list[str]] = {m: [] for m in hot}
    if hot:
        drawn = rows.filter(F.col("down").isin(hot)).sample(min(1.0, DRAWN * count / n), seed=1)
        for r in drawn.select("down", F.substring("text", 1, LEAD).alias("lead")).collect():
            leads[r.down].append(r.lead)
    starts = {(m, "") for m in times}
    for m, found in leads.items():
        found.sort()
        starts.update((m, found[len(found) * k // (times[m] + 1)]) for k in range(1, times[m] + 1) if found)
    return sorted(starts), hot


def fingerprinted(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: code points, fingerprints of the text and of the edited text, and their likeness to each other and to
    the next row's, in falling order of id (null last; rows with equal ids by their text); the last row's next is the first.

    Rows are cut into ranges of about the same number: by id, and inside an id that many rows share by the first characters
    of the text. The first row of each range visits the range before as a guest, so one exchange by range, sorted inside,
    gives every row its next; no row is collected. Rows of a hot id with equal first characters stay in one range.
    """
    rows = documents.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("down", F.bitwise_not(F.coalesce("id", F.lit(LAST))))  # rises as ids fall, null last
    starts, hot = _starts(rows)
    lead = F.when(F.col("down").isin(hot), F.substring("text", 1, LEAD)).otherwise("") if hot else F.lit("")

    @F.arrow_udf("int")
    def range_of(down: pa.Array, lead: pa.Array) -> pa.Array:
        return pa.array([bisect_right(starts, at) for at in zip(down.to_pylist(), lead.to_pylist())], pa.int32())

    # The first place of every range that has rows: from here on these are the ranges.
    firsts = rows.select("down", lead.alias("lead")).groupBy(range_of("down", "lead")).agg(F.min(F.struct("down", "lead")).alias("first"))
    heads = sorted((r.first.down, r.first.lead) for r in firsts.select("first").collect())

    @F.arrow_udf("array<int>")
    def places(down: pa.Array, lead: pa.Array) -> pa.Array:
        out = []
        for at in zip(down.to_pylist(), lead.to_pylist()):
            own = bisect_right(heads, at) - 1
            out.append([own, (own - 1) % len(heads)] if heads[own] == at else [own])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = (rows.select("id", "text", "down", F.posexplode(places("down", lead)).alias("guest", "bucket"))
             .repartitionById(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "guest", "down", "text"))
    pairs = dealt.select("bucket", "id", "text", (F.col("guest") == 1).alias("guest"))
    return pairs.mapInArrow(_pairs, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                            "edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id)
