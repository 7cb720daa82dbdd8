"""Ranked lexical search: term at a time, rarest first, with a limit on accumulators.

Every task ranks its own documents for every item and keeps each item's best; the best of all tasks are ranked again.
Inside a task the terms of an item come in order of rising document frequency. Each term has a bound: its weight times the
largest factor that one of its postings here has. A document gets an accumulator when one of the first terms finds it. Once
the bounds of the terms still to come add up to less than the k-th best score known so far, no document without an accumulator can
reach the list, and no more are made: the postings of the remaining, common terms only update the survivors, exactly.
The k-th best is the larger of what earlier documents of the task reached and what the accumulators hold by now.
Scores are whole numbers, so nothing depends on the order of additions.

Documents are tokenised once: the first pass writes, for each, its number of terms and the items' terms it holds. Nothing is
dealt out by term, so a word in every document makes no large group. Items are taken in blocks of about `BLOCK_BYTES` of text,
which bounds what a task holds of them; each block is one pass over the documents.

Cases: null or term-less documents are never listed and not counted; null or term-less items list nothing; repeated rows of
either table are documents or items of their own; equal scores go by rising id, documents without an id last; extra columns
play no part; empty tables give an empty list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from jobtally.llm.work import slices, written

BLOCK_BYTES = 4 << 20
POSTINGS = 1 << 21
SCALE, SATURATION, SHARE = 1_000_000_000, 20, 50
#: What a byte becomes: A-Z small, 0-9, a-z and all of a longer character kept, everything else a gap.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NO_ID = (1 << 63) - 1


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Item(NamedTuple):
    id: int | None
    terms: list[int]


class Search(NamedTuple):
    """What a task needs: the items with their terms, rarest first, the weight of every term, and the size of the collection."""

    items: list[Item]
    weight: np.ndarray
    n_docs: int
    n_terms: int
    k: int


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """The postings of a run of documents, by term, with the factor of each and the largest factor of every term."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, size: np.ndarray, search: Search):
        m = 100 - SHARE + (SHARE * size * search.n_docs) // max(search.n_terms, 1)
        order = np.argsort(term, kind="stable")
        self.doc, tf, of = doc[order], tf[order], term[order]
        self.factor = (SCALE * tf) // (1000 * tf + SATURATION * m[self.doc])
        self.at = np.searchsorted(of, np.arange(len(search.weight) + 1))
        self.bound = np.zeros(len(search.weight), np.int64)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            self.bound[some] = search.weight[some] * np.maximum.reduceat(self.factor, self.at[some])


def best(terms: list[int], weights: np.ndarray, postings: Postings, n: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of 0..n-1 that may be among the k best, given that `floor` is already reached by k; their scores; and how many got an accumulator."""
    score, live = np.zeros(n, np.int64), np.zeros(n, bool)
    left = int(postings.bound[terms].sum())
    making, survivors = True, None
    for t in terms:
        a, b = postings.at[t], postings.at[t + 1]
        if a == b or not weights[t]:
            continue
        if making and left < floor:
            making, survivors = False, live & (score + left >= floor)
        docs, gain = postings.doc[a:b], weights[t] * postings.factor[a:b]
        if making:
            score[docs] += gain
            live[docs] = True
            left -= int(postings.bound[t])
            held = score[live]
            if len(held) >= k:
                floor = max(floor, int(np.partition(held, -k)[-k]))
        else:
            mine = survivors[docs]
            score[docs[mine]] += gain[mine]
            left -= int(postings.bound[t])
    found = np.flatnonzero((live if survivors is None else survivors) & (score > 0))
    return found, score[found], int(live.sum())


def _ranked(batches: Iterator[pa.RecordBatch], search: Search) -> Iterator[pa.RecordBatch]:
    """The k best documents of the task for every item."""
    k = search.k
    top = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),) for _ in search.items]
    for batch in batches:
        terms = batch.column("terms")
        ends = np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + POSTINGS, side="right")))
            part, first = batch.slice(first, last - first), last
            lists = [part.column(c) for c in ("terms", "tfs")]
            per_doc = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            n = part.num_rows
            postings = Postings(term, np.repeat(np.arange(n), per_doc), tf, part.column("n").to_numpy().astype(np.int64), search)
            known = part.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = part.column("id").fill_null(NO_ID).to_numpy()
            for i, item in enumerate(search.items):
                scores, names, valid = top[i]
                floor = int(scores[k - 1]) if len(scores) >= k else 0
                found, gained, _ = best(item.terms, search.weight, postings, n, k, floor)
                if len(found):
                    scores, names, valid = np.r_[scores, gained], np.r_[names, ids[found]], np.r_[valid, known[found]]
                    order = np.lexsort((names, ~valid, -scores))[:k]
                    top[i] = scores[order], names[order], valid[order]
    sizes = [len(s) for s, _, _ in top]
    if sum(sizes):
        scores, names, valid = (np.concatenate(x) for x in zip(*top))
        at = np.repeat(np.arange(len(top)), sizes)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array([search.items[i].id for i in at], pa.int64()),
                               pa.array(names, pa.int64(), mask=~valid), pa.array(scores, pa.int64())],
                              ["nr", "item_id", "doc_id", "score"])


def indexed(docs: DataFrame, vocabulary: dict[bytes, int], id: str, text: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: all its terms counted, those of the vocabulary listed."""
    names = pa.array(list(vocabulary), pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words: list[bytes] = []
            size = np.zeros(part.num_rows, np.int64)
            for i, x in enumerate(part.column("text").cast(pa.large_binary()).to_pylist()):
                mine = terms_of(x)
                words += mine
                size[i] = len(mine)
            found = pc.index_in(pa.array(words, pa.large_binary()), value_set=names).fill_null(-1).to_numpy().astype(np.int64)
            key = np.repeat(np.arange(part.num_rows), size) * max(len(names), 1) + found
            key, tf = np.unique(key[found >= 0], return_counts=True)
            row, term = np.divmod(key, max(len(names), 1))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
            out = pa.record_batch([part.column("id"), pa.array(size), *lists], ["id", "n", "terms", "tfs"])
            yield out.filter(pa.array(size > 0))

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def _block(docs: DataFrame, items: list, k: int, id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    asked = [(r.id, set(terms_of(bytes(r.text)) if r.text else ())) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(t for _, t in asked))))}
    index = written(indexed(docs, vocabulary, id, text), "terms")
    held = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r.t] = r.n
    weights = np.array([weight(held.docs, int(n)) for n in df], np.int64)
    chosen = [Item(i, sorted((vocabulary[t] for t in terms), key=lambda t: (df[t], t))) for i, terms in asked]
    search = Search(chosen, weights, held.docs, held.terms, k)
    found = index.filter(F.size("terms") > 0).mapInArrow(lambda b: _ranked(b, search), "nr int, item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Many tasks' lists of one item meet in a few tasks first.
    some = found.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
    near = some.withColumn("rank", F.row_number().over(W.partitionBy("nr", "some").orderBy(*order))).filter(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(W.partitionBy("nr").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, by rising rank from 1."""
    asked = items.select(F.col(item).cast("long").alias("id"), F.col(item_text).cast("binary").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    number = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    parts = [_block(docs, asked.filter(number == b).collect(), k, id, text) for b in range(blocks)]
    return reduce(DataFrame.union, parts)
