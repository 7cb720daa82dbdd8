"""Toxicity by non-negative positive-unlabelled learning.

Known toxic texts are the positives, every other text is unlabelled. A linear model over which words and word
beginnings a text holds is trained in numpy with the class-prior-corrected risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l(z) = log(1 + exp(-z)),

and where the second part falls below zero, the step goes against its gradient. Several such models, each on its own
half of the unlabelled texts, are averaged.

Cases: a null, empty or letterless text gets the score of a text without features; upper and lower case are one; a
feature counts once in a text, however often it is repeated; without positives or without texts every score is 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtally.llm import arrays as A
from jobtally.llm.work import by_slices, slices, unit

BEGINNINGS = (4, 5, 6)
SURE = float(np.log(1e6))
MODELS = 3
PREFILTER_BITS = 20


class Detector(NamedTuple):
    """Sorted feature hashes, their weights in each model, and the models' offsets."""

    keys: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and word beginning, repeats included."""
    codes, bounds = A.code_points([t.lower() for t in texts])
    words = A.runs(A.letters()[codes], bounds)
    hashes = A.Hashes(codes)
    rows, keys = [words.row], [hashes.of(words.start, words.end)]
    for n in BEGINNINGS:
        long = words.end - words.start >= n
        rows.append(words.row[long])
        keys.append(hashes.of(words.start[long], words.start[long] + n) + np.uint64(n))
    return np.concatenate(rows), np.concatenate(keys)


def _present(texts: list[str], keys: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index into keys) pairs; `maybe` drops most other hashes before the search."""
    rows, found = features(texts)
    likely = maybe[found >> np.uint64(64 - PREFILTER_BITS)]
    rows, found = rows[likely], found[likely]
    at = np.searchsorted(keys, found)
    at[at == len(keys)] = 0
    same = keys[at] == found
    pairs = np.unique(rows[same] * len(keys) + at[same])
    return pairs // len(keys), pairs % len(keys)


def _maybe(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << PREFILTER_BITS, bool)
    table[keys >> np.uint64(64 - PREFILTER_BITS)] = True
    return table


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(name).fill_null("").to_pylist()


def _feature_counts(batches):
    for part in slices(batches, "text"):
        rows, keys = features(_texts(part))
        order = np.lexsort((rows, keys))
        rows, keys = rows[order], keys[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        rows, keys = rows[once], keys[once]
        positive = part.column("positive").to_numpy(zero_copy_only=False)[rows]
        distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
        hits = np.add.reduceat(positive.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(hits), pa.array(n - hits)],
                              ["key", "in_positive", "in_other"])


def fit(texts: DataFrame, positives: DataFrame, prior: float, most_positive: int = 4_000, most_unlabelled: int = 8_000,
        least_documents: int = 3, most_features: int = 2048, steps: int = 200, seed: str = "toxicity") -> Detector:
    """Train on a bounded sample of `texts` (id, text), of which `positives` (id) are known to be toxic.

    About `most_positive` positives and `most_unlabelled` rows of the whole, each chosen by a hash of its id, are looked
    at; of the features that tell both apart the `most_features` with the most evidence are learned from, which bounds the
    model that every task gets; `prior` is the share of toxic texts among all. The chosen positives are so few that every task gets them all,
    and no text is exchanged.
    """
    ids = positives.select("id").filter("id IS NOT NULL").distinct()
    n, n_positive = texts.count(), ids.count()
    if not n_positive or not n:
        return Detector(np.zeros(0, np.uint64), np.zeros((0, MODELS)), np.full(MODELS, -np.inf))
    chosen = ids.filter(unit("id", seed) < min(1.0, most_positive / n_positive)).withColumn("positive", F.lit(True))
    as_unlabelled = F.coalesce(unit("id", f"{seed}-u") < min(1.0, most_unlabelled / n), F.lit(False))
    sample = (texts.join(F.broadcast(chosen), "id", "left")
              .select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("positive", F.lit(False)).alias("positive"),
                      as_unlabelled.alias("unlabelled")).filter("positive OR unlabelled"))
    counts = (sample.mapInArrow(_feature_counts, "key long, in_positive long, in_other long")
              .groupBy("key").agg(F.sum("in_positive").alias("p"), F.sum("in_other").alias("o"))
              .filter(F.col("p") >= least_documents))
    n_sampled, n_flagged = sample.agg(F.count("*"), F.count_if("positive")).first()
    share = n_flagged / n_sampled
    # How unlikely the split of a feature over both groups is by chance: what one in a million features reaches, stays.
    surprise = lambda n, part: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("p") + F.col("o")) * part))).otherwise(0.0)
    evidence = surprise("p", share) + surprise("o", max(1 - share, 1e-9))
    sure = counts.withColumn("evidence", evidence).filter((F.col("evidence") > SURE) & (F.col("p") > (F.col("p") + F.col("o")) * share))
    best = sure.orderBy(F.desc("evidence"), "key").select("key").limit(most_features).toPandas()["key"]
    keys = np.sort(best.to_numpy(np.int64).view(np.uint64))
    if not len(keys):
        return Detector(keys, np.zeros((0, MODELS)), np.full(MODELS, -np.inf))
    maybe = _maybe(keys)

    def found(batches):
        for part in slices(batches, "text"):
            rows, at = _present(_texts(part), keys, maybe)
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
            yield pa.record_batch([part.column("positive"), part.column("unlabelled"),
                                   pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))],
                                  ["positive", "unlabelled", "at"])

    rows = sample.mapInArrow(found, "positive boolean, unlabelled boolean, at array<int>").toArrow()
    at = rows.column("at").combine_chunks()
    sizes = at.value_lengths().to_numpy()
    columns = at.flatten().to_numpy()
    positive = rows.column("positive").to_numpy()
    unlabelled = rows.column("unlabelled").to_numpy()
    # The order in which tasks deliver rows is open: a fixed order makes the sums, and so the model, the same each time.
    order = np.lexsort((_signatures(columns, sizes), unlabelled, positive))
    starts = np.cumsum(sizes) - sizes
    columns, sizes = columns[A.spread(starts[order], sizes[order])], sizes[order]
    return train(columns, sizes, positive[order], unlabelled[order], keys, prior, steps)


def _signatures(columns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(sizes), np.uint64)
    np.add.at(out, row, A.mixed(columns.astype(np.uint64) + np.uint64(1)))
    return out


def train(columns, sizes, positive, unlabelled, keys, prior: float, steps: int, rate: float = 0.1,
          shrink: float = 1e-4) -> Detector:
    """Averaged non-negative PU models over rows that are lists of feature indices."""
    n, width = len(sizes), len(keys)
    row = np.repeat(np.arange(n), sizes)
    weights, offsets = np.zeros((width, MODELS)), np.zeros(MODELS)
    chosen = np.flatnonzero(unlabelled)
    for m in range(MODELS):
        drawn = np.random.default_rng(m).permutation(chosen)[: max(1, len(chosen) // 2)] if len(chosen) > 1 else chosen
        from_p = positive / max(1, positive.sum())
        from_u = np.zeros(n)
        from_u[drawn] = 1 / max(1, len(drawn))
        w, b = np.zeros(width), np.log(prior / (1 - prior))
        first, second = np.zeros(width + 1), np.zeros(width + 1)
        for step in range(1, steps + 1):
            g = b + np.bincount(row, w[columns], n)
            toxic = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            loss_as_negative = np.logaddexp(0, g)
            negative_part = from_u @ loss_as_negative - prior * (from_p @ loss_as_negative)
            slope = (from_u - prior * from_p) * toxic
            slope = slope - prior * from_p * (1 - toxic) if negative_part >= 0 else -slope
            grad = np.append(np.bincount(columns, slope[row], width) + shrink * w, slope.sum())
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        weights[:, m], offsets[m] = w, b
    return Detector(keys, weights, offsets)


def score(text: Column | str, detector: Detector) -> Column:
    """The mean toxicity, 0 to 1, that the models give to a text."""
    maybe = _maybe(detector.keys)

    def values(part: pa.RecordBatch) -> np.ndarray:
        n = part.num_rows
        if not len(detector.keys):
            return np.zeros(n)
        logits = np.tile(detector.offsets, (n, 1))
        rows, at = _present(_texts(part), detector.keys, maybe)
        for m in range(MODELS):
            logits[:, m] += np.bincount(rows, detector.weights[at, m], n)
        return (1 / (1 + np.exp(-np.clip(logits, -700, 700)))).mean(axis=1)

    return by_slices(values, "double")(text)

