"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: every step shifts it left by a bit and adds the byte's table value,
so with 16 bits it depends on the last 16 bytes alone. A text is cut where the hash is the largest within `RADIUS`
bytes on either side: cuts move with the content, and an insertion shifts no others. Chunks are counted by digest. A
chunk is a repeat if an earlier document (smaller id) holds it. Repeats are anchors: each is laid on the text of the
first document that holds it and extended to both sides as far as the texts are equal, byte for byte. What has at least
`words` whole words is taken out of the later document. A stretch of `words` words in which no chunk is certain to be cut
alike everywhere is an anchor itself, so every passage of that many words has one.

Texts move as little as they can: marks of the shared digests let only repeated chunks through to the join with their
first holders, and only texts that may change, or are held against one that may, are written once and moved. All others
go from the input to the result. Marks have a fixed size and only spare work, see `work.Marks`.

Cases: null and empty texts stay as they are; repeats within one document stay; rows without an id stay whole and make
no other row a repeat; rows that repeat an id count as one document, each with spans of its own text; a long text
without cuts is one chunk. A chunk that several earlier documents hold is extended in the first of them alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtally.llm import arrays as A
from jobtally.llm.work import SLICE, Marks, by_runs, marked, slices, written

RADIUS = 16
WINDOW = 16
CERTAIN = WINDOW + 2 * RADIUS, 2 * RADIUS + 1  # bytes before and after a cut that settle it, its lonely neighbours included
GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, doubled up from windows of 1, 2, 4, 8 bytes."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint16(width)
        h, width = wider, 2 * width
    return h


def cuts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every chunk of all texts. No cut looks over the ends of a text."""
    n = len(data)
    h = gear(data).astype(np.int32) << np.int32(1)
    top = np.full(n + 2 * RADIUS, -1, np.int32)
    top[RADIUS : RADIUS + n] = h
    best, width = top, 1
    while width < 2 * RADIUS + 1:
        step = min(width, 2 * RADIUS + 1 - width)
        best = np.maximum(best[:-step], best[step:])
        width += step
    peak = np.flatnonzero(h == best)
    row = np.searchsorted(bounds, peak, side="right") - 1
    inside = (peak - bounds[row] >= WINDOW + RADIUS) & (bounds[row + 1] - peak > RADIUS)
    peak = peak[inside]
    if len(peak):  # equal largest values side by side, as in a text of one letter: no cut between them
        lonely = np.r_[True, np.diff(peak) > RADIUS] & np.r_[np.diff(peak) > RADIUS, True]
        peak = peak[lonely]
    full = bounds[:-1][bounds[1:] > bounds[:-1]]
    start = np.sort(np.concatenate([full, peak]))
    end = np.append(start[1:], n)
    return start, end


def _bare(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all stretches of `words` words without a chunk that is cut alike wherever they stand."""
    found = A.runs(A.not_white()[data], bounds)
    first = np.flatnonzero(found.row[: len(found.row) - words + 1] == found.row[words - 1 :]) if len(found.row) >= words else []
    begin, end = found.start[first], found.end[np.asarray(first, np.int64) + words - 1]
    inner = start[~np.isin(start, bounds)]
    held = np.searchsorted(inner, end - CERTAIN[1], side="right") - np.searchsorted(inner, begin + CERTAIN[0])
    return begin[held < 2], end[held < 2]


def _anchors(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and digest of the chunks, and of the stretches without one."""
    start, end = cuts(data, bounds)
    begin, stop = _bare(data, bounds, start, words)
    start, end = np.concatenate([start, begin]), np.concatenate([end, stop])
    return start, end, A.Hashes(data).of(start, end).view(np.int64)


def _in_long_runs(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, hit: np.ndarray, words: int) -> np.ndarray:
    """Which of the hit anchors can lie in a passage of `words` words: `_promising` for all texts of a batch at once.

    Chunks come first, in order, then stretches. A run of hit chunks reaches as far as the chunks beside it may be cut
    otherwise elsewhere; a passage lies inside that, so it has to hold enough words.
    """
    n = int(np.searchsorted(np.maximum.accumulate(end), len(data), side="left")) + 1 if len(end) else 0
    first, last = start[:n], end[:n]
    text = np.searchsorted(bounds, first, side="right") - 1
    fresh = np.r_[True, text[1:] != text[:-1]] if n else np.zeros(0, bool)
    ends = np.r_[fresh[1:], True] if n else fresh
    mine = hit[:n]
    opens = np.flatnonzero(mine & (fresh | ~np.r_[False, mine[:-1]])) if n else np.zeros(0, np.int64)
    closes = np.flatnonzero(mine & (ends | ~np.r_[mine[1:], False])) if n else opens
    low = np.where(fresh[opens], bounds[text[opens]], np.maximum(bounds[text[opens]], first[opens - 1] - CERTAIN[0]))
    high = np.where(ends[closes], bounds[text[closes] + 1], np.minimum(bounds[text[closes] + 1], last[np.minimum(closes + 1, n - 1)] + CERTAIN[1]))
    found = A.runs(A.not_white()[data], bounds)
    held = np.searchsorted(found.start, high) - np.searchsorted(found.end, low, side="right")
    run = np.cumsum(np.bincount(opens, minlength=n)) - 1
    keep = hit.copy()
    keep[:n][mine] = (held >= words)[run[mine]]
    return keep


def _chunk_rows(words: int, holds=None):
    def rows(batches):
        for part in slices(batches, "text", SLICE // 2):
            data, bounds = A.utf8(part.column("text"))
            start, end, digest = _anchors(data, bounds, words)
            if holds:
                may = _in_long_runs(data, bounds, start, end, holds(digest), words)
                start, end, digest = start[may], end[may], digest[may]
            row = np.searchsorted(bounds, start, side="right") - 1
            doc, hashed = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "hash"))
            yield pa.record_batch([pa.array(doc), pa.array(hashed), pa.array((start - bounds[row]).astype(np.int32)),
                                   pa.array((end - start).astype(np.int32)), pa.array(digest)],
                                  ["doc", "hash", "start", "size", "digest"])

    return rows


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """The number of leading bytes that are equal."""
    n, at, step = min(len(a), len(b)), 0, 256
    while at < n:
        differs = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, 2 * step
    return n


def _promising(text: bytes, starts: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """Which anchors can lie in a passage of `words` words. A run of repeats is one of its chunks cut alike; the passage
    ends inside the chunks beside the run, or else their cuts would be certain and they repeats."""
    data = np.frombuffer(text, np.uint8)
    start, end = cuts(data, np.array([0, len(data)]))
    at = np.minimum(np.searchsorted(start, starts), len(start) - 1)
    chunk = (start[at] == starts) & (end[at] == starts + sizes)
    hit = np.zeros(len(start) + 2, bool)
    hit[at[chunk] + 1] = True
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    good = np.zeros(len(start), bool)
    for i, j in zip(edges[::2], edges[1::2]):  # the run of chunks i to j - 1
        low = max(0, int(start[i - 1]) - CERTAIN[0]) if i else 0
        high = int(end[j]) + CERTAIN[1] if j < len(end) else len(data)
        good[i:j] = len(text[low:high].split()) >= words
    return ~chunk | good[at]


def _places(text: bytes, words: int) -> dict[int, list[int]]:
    """Where the anchors of a text start, by digest."""
    where: dict[int, list[int]] = {}
    begin, _, known = _anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words)
    for s, d in zip(begin.tolist(), known.tolist()):
        where.setdefault(d, []).append(s)
    return where


def _extended(text: bytes, earlier: bytes, where: dict[int, list[int]], starts: np.ndarray, sizes: np.ndarray, digests: np.ndarray,
              words: int) -> list[tuple[int, int]]:
    """Spans of `text` around the anchors that `earlier`, with its places, holds as well, of at least `words` words that are whole in both."""
    a, b, view = np.frombuffer(text, np.uint8), np.frombuffer(earlier, np.uint8), memoryview(text)
    white, spans, reached, begun, covered = A.WHITE, set(), {}, 0, 0
    for k in np.argsort(starts, kind="stable"):
        s, size = int(starts[k]), int(sizes[k])
        # Inside a stretch already found (begun to covered) a place adds nothing unless it is equal as far as one of its ends.
        inside = begun <= s and s + size <= covered
        for o in where.get(int(digests[k]), ()):
            if s + size <= reached.get(o - s, 0):
                continue
            if inside and not earlier.startswith(view[s:covered], o) and (
                    o < s - begun or not earlier.startswith(view[begun : s + size], o - s + begun)):
                continue
            n = _equal(a[s:], b[o:])
            if n < size:
                continue
            back = _equal(a[:s][::-1], b[:o][::-1])
            first, last, shift = s - back, s + n, o - s
            reached[shift] = last
            whole = first, last
            if first > 0 and a[first - 1] not in white or first + shift > 0 and b[first + shift - 1] not in white:
                while first < last and a[first] not in white:
                    first += 1
            if last < len(a) and a[last] not in white or last + shift < len(b) and b[last + shift] not in white:
                while last > first and a[last - 1] not in white:
                    last -= 1
            while first < last and a[first] in white:
                first += 1
            while last > first and a[last - 1] in white:
                last -= 1
            if last > first and len(text[first:last].split()) >= words:
                spans.add((first, last))
                if whole[1] > covered:
                    begun, covered = whole
                    inside = begun <= s and s + size <= covered
    return sorted(spans)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined = []
    for s, e in sorted(spans):
        if joined and s <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(e, joined[-1][1])
        else:
            joined.append((s, e))
    return joined


SPANS = "array<struct<start:int,end:int>>"


def deduplicated(documents: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] = (), words: int = 50) -> DataFrame:
    """(id, text, spans, removed, first), then the `carry` columns: the texts without repeats, the byte spans taken out of the original, the code
    points taken out, and the smallest id of a document that held a part of them before."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"),
                            F.struct(F.lit(0), *carry).alias("carried"))
    texts = rows.filter("doc IS NOT NULL AND text IS NOT NULL").select("doc", "hash", "text")
    kind = "doc long, hash long, start int, size int, digest long"
    firsts = (texts.mapInArrow(_chunk_rows(words), kind).groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
              .filter("first < last").select("digest", "first"))
    firsts = written(firsts, "shared-chunks")
    shared = Marks.of(firsts.select("digest")).sent(spark)
    chunks = texts.mapInArrow(_chunk_rows(words, shared), kind)
    repeats = (chunks.join(firsts, "digest").filter("doc > first").groupBy("doc", "hash")
               .agg(F.collect_set(F.struct("start", "size", "digest", "first")).alias("at")))
    repeats = written(repeats, "repeats")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def sifted(texts: pa.Array, at: pa.Array) -> pa.Array:
        keep = [np.zeros(0, bool)]
        for given, where in zip(texts, at):
            start, size = (where.values.field(k).to_numpy() for k in (0, 1))
            keep.append(_promising(given.as_py().encode(), start, size, words))
        ends = np.cumsum([len(k) for k in keep])
        kept = np.concatenate([[0], np.cumsum(np.concatenate(keep))])[ends]
        return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), at.flatten().filter(pa.array(np.concatenate(keep))))

    def extended(texts: pa.Array, earlier: pa.Array, at: pa.Array) -> pa.Array:
        out, held, places = [], None, {}
        for given, holder, where in zip(texts, earlier, at):
            other = holder.as_py().encode()
            if other != held:  # the join brings the pairs of a holder one after another
                held, places = other, _places(other, words)
            spans = _extended(given.as_py().encode(), other, places, *(where.values.field(k).to_numpy() for k in range(3)), words)
            out.append([{"start": s, "end": e} for s, e in spans])
        return pa.array(out, pa.list_(span))

    sifted = by_runs(sifted, "array<struct<start:int,size:int,digest:long,first:long>>")
    extended = by_runs(extended, SPANS)

    # Few texts have anchors that can lie in a passage: from here on only those and the ones they repeat are moved.
    with_repeats = texts.filter(marked("doc", Marks.of(repeats.select("doc")).sent(spark)))
    sift = (with_repeats.join(repeats, ["doc", "hash"]).select("doc", "hash", sifted("text", "at").alias("anchors"))
            .filter("size(anchors) > 0").dropDuplicates(["doc", "hash"]))
    sift = written(sift, "anchors")
    holders = sift.select(F.explode("anchors.first").alias("doc")).distinct()
    wanted = Marks.of(holders.union(sift.select("doc"))).sent(spark)
    moved = written(texts.filter(marked("doc", wanted)), "moved-texts")
    holders = (moved.join(holders, "doc", "left_semi").dropDuplicates(["doc", "hash"])
               .select(F.col("doc").alias("holder"), F.col("text").alias("earlier")))
    pairs = (sift.select("doc", "hash", F.explode("anchors").alias("a")).groupBy("doc", "hash", F.col("a.first").alias("holder"))
             .agg(F.collect_list(F.struct("a.start", "a.size", "a.digest")).alias("at"))
             .join(moved.dropDuplicates(["doc", "hash"]), ["doc", "hash"]))
    # A text that very many repeat is one row of the right side; the pairs, which hold their own texts, can be split.
    known = (pairs.join(holders, "holder").select("doc", "hash", "holder", extended("text", "earlier", "at").alias("more"))
             .filter("size(more) > 0").groupBy("doc", "hash").agg(F.flatten(F.collect_list("more")).alias("at"), F.min("holder").alias("first")))
    known = written(known, "spans")

    def without(texts: pa.Array, at: pa.Array) -> pa.Array:
        out = []
        for given, where in zip(texts, at):
            if not given.is_valid or not where.is_valid:
                out.append({"text": given.as_py(), "spans": [], "removed": 0})
                continue
            whole = given.as_py().encode()
            spans = _joined([(s["start"], s["end"]) for s in where.as_py()])
            kept, at_byte = [], 0
            for s, e in spans:
                kept.append(whole[at_byte:s])
                at_byte = e
            left = b"".join([*kept, whole[at_byte:]]).decode()
            out.append({"text": left, "spans": [{"start": s, "end": e} for s, e in spans],
                        "removed": len(given.as_py()) - len(left)})
        return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                                        ("removed", pa.int64())]))

    without = by_runs(without, "text string, spans array<struct<start:int,end:int>>, removed long")
    changes = marked("doc", Marks.of(known.select("doc")).sent(spark))
    touched = rows.filter(changes).join(known, ["doc", "hash"], "left").withColumn("new", without(F.when(F.col("at").isNotNull(), F.col("text")), "at"))
    changed = F.coalesce(F.size("new.spans"), F.lit(0)) > 0
    carried = [F.col("carried").getField(c).alias(c) for c in carry]
    touched = touched.select(F.col("doc").alias(id), F.when(changed, F.col("new.text")).otherwise(F.col("text")).alias(text),
                             F.when(changed, F.col("new.spans")).alias("spans"), F.coalesce("new.removed", F.lit(0)).cast("long").alias("removed"),
                             F.when(changed, F.col("first")).alias("first"), *carried)
    rest = rows.filter(~changes).select(F.col("doc").alias(id), F.col("text").alias(text), F.lit(None).cast(SPANS).alias("spans"),
                                        F.lit(0).cast("long").alias("removed"), F.lit(None).cast(rows.schema["doc"].dataType).alias("first"), *carried)
    return touched.union(rest)
