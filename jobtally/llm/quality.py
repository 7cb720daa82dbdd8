"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages: `PASSAGE` words each, the last one shorter. Every passage is encoded as a vector of
proportions and of hashed words. Only the text has a label. Gated attention

    a_k  proportional to  exp(w . (tanh(V h_k) * sigmoid(U h_k)))

weighs the passages, z = sum of a_k h'_k with h' = tanh(H h + c) represents the text, and a logistic unit scores z. All
parts are learned together in numpy from labelled texts by gradient descent (Adam).

Cases: a null or wordless text is one passage without words and has its score like any other; labels other than 0 and 1
are not learned from; without both labels every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtally.llm import arrays as A
from jobtally.llm.work import by_slices, slices, unit

PASSAGE = 64
BUCKETS = 48
HIDDEN, ATTENTION = 24, 12
# Byte classes, in the order of the features: upper case, lower case or beyond ASCII, digits, white space, line feed,
# end of sentence, bars, and each other sign of ASCII on its own group.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",;:", "!", "?", "|", "#$%&*@^~", "<>{}[]()=+/\\_", "\"'`-"]


class Model(NamedTuple):
    """Feature means and scales, then the learned arrays by name; `constant` is the score where nothing was learned."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    constant: float | None


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for k, signs in enumerate(CLASSES):
        table[[ord(s) for s in signs]] = k
    return table


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of every passage and its features; each row has at least one."""
    data, bounds = A.utf8(column)
    n = len(bounds) - 1
    words = A.runs(A.not_white()[data], bounds)
    per_row = A.counts(words.row, n)
    first_word = np.cumsum(per_row) - per_row
    count = np.maximum(1, -(-per_row // PASSAGE))
    row = np.repeat(np.arange(n), count)
    nr = A.spread(np.zeros(n, np.int64), count)
    begin = first_word[row] + nr * PASSAGE
    stop = np.minimum(begin + PASSAGE, first_word[row] + per_row[row])
    p = len(row)
    some = stop > begin
    start_byte, end_byte = bounds[row].copy(), bounds[row + 1].copy()
    start_byte[some] = words.start[begin[some]]
    later = np.r_[row[1:] == row[:-1], False] if p else np.zeros(0, bool)
    end_byte[later] = start_byte[np.flatnonzero(later) + 1]
    size = np.maximum(end_byte - start_byte, 1)
    kinds = _class_table()[data]
    shares = np.empty((p, len(CLASSES)))
    for k in range(len(CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        shares[:, k] = (sums[end_byte] - sums[start_byte]) / size
    n_words = np.maximum(stop - begin, 1)
    of_word = np.repeat(np.arange(p), stop - begin)
    hashes = A.Hashes(data).of(words.start, words.end)
    length = (words.end - words.start).astype(float)
    mean_length = np.bincount(of_word, length, p) / n_words
    spread = np.sqrt(np.maximum(np.bincount(of_word, length**2, p) / n_words - mean_length**2, 0))
    order = np.lexsort((hashes, of_word))
    new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])] if len(order) else np.zeros(0, bool)
    distinct = np.bincount(of_word[order][new], minlength=p) / n_words
    same_as_next = np.r_[(hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1]), False] if len(hashes) else np.zeros(0, bool)
    repeated = np.bincount(of_word[same_as_next], minlength=p) / n_words
    bucket = np.bincount(of_word * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=p * BUCKETS)
    hashed = np.sqrt(bucket.reshape(p, BUCKETS) / n_words[:, None])
    shape = np.column_stack([np.sqrt(shares), mean_length, spread, distinct, repeated, np.log1p(stop - begin)])
    return row, np.column_stack([shape, hashed])


def _forward(x: np.ndarray, first: np.ndarray, row: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    hidden = np.tanh(x @ w["H"] + w["c"])
    gate_t, gate_s = np.tanh(x @ w["V"]), 1 / (1 + np.exp(-(x @ w["U"])))
    energy = (gate_t * gate_s) @ w["w"]
    energy = np.exp(energy - np.maximum.reduceat(energy, first)[row])
    attention = energy / np.add.reduceat(energy, first)[row]
    z = np.add.reduceat(attention[:, None] * hidden, first, axis=0)
    logit = z @ w["o"] + w["b"]
    return {"hidden": hidden, "t": gate_t, "s": gate_s, "a": attention, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def train(row: np.ndarray, x: np.ndarray, label: np.ndarray, steps: int = 300, rate: float = 0.01,
          shrink: float = 1e-4) -> Model:
    """`row` rises from 0 without gaps; `label` has one value for each row."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - mean) / scale, -8, 8)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rng = np.random.default_rng(0)
    f = x.shape[1]
    w = {"H": rng.normal(0, f**-0.5, (f, HIDDEN)), "c": np.zeros(HIDDEN), "V": rng.normal(0, f**-0.5, (f, ATTENTION)),
         "U": rng.normal(0, f**-0.5, (f, ATTENTION)), "w": rng.normal(0, 0.1, ATTENTION), "o": rng.normal(0, 0.1, HIDDEN),
         "b": np.array(np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6)))}
    one, two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        s = _forward(x, first, row, w)
        d_logit = (s["p"] - label) / len(label)
        d_z = np.outer(d_logit, w["o"])[row]
        d_hidden = s["a"][:, None] * d_z * (1 - s["hidden"] ** 2)
        pull = (d_z * s["hidden"]).sum(axis=1)
        d_energy = s["a"] * (pull - np.add.reduceat(s["a"] * pull, first)[row])
        d_gate = np.outer(d_energy, w["w"])
        grads = {"H": x.T @ d_hidden, "c": d_hidden.sum(axis=0), "o": s["z"].T @ d_logit, "b": d_logit.sum(),
                 "w": (s["t"] * s["s"]).T @ d_energy, "V": x.T @ (d_gate * s["s"] * (1 - s["t"] ** 2)),
                 "U": x.T @ (d_gate * s["t"] * s["s"] * (1 - s["s"]))}
        for k, g in grads.items():
            g = g + (shrink * w[k] if k in "HVUo" else 0)
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            w[k] = w[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, None)


def fit(texts: DataFrame, labels: DataFrame, most: int = 8_000, seed: str = "quality") -> Model:
    """Learn from `texts` (id, text) and `labels` (id, label): about `most` labelled ids, chosen by a hash of the id.

    The chosen labels are so few that every task gets them all, and no text is exchanged. An id with both labels has 0.
    """
    known = labels.filter("label IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))
    held = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(held) < 2:
        share = 0.5 if not held else float(next(iter(held)))
        return Model(np.zeros(0), np.zeros(0), {}, share)
    total = sum(held.values())
    chosen = known.filter(unit("id", seed) < min(1.0, most / total))
    sample = texts.join(F.broadcast(chosen), "id").select("text", F.col("label").cast("int").alias("label"))

    def encoded(batches):
        for part in slices(batches, "text"):
            row, x = passages(part.column("text"))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32) * x.shape[1]
            yield pa.record_batch([part.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.float32).ravel()))],
                                  ["label", "x"])

    rows = sample.mapInArrow(encoded, "label int, x array<float>").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(0), np.zeros(0), {}, held[1] / total)
    x = rows.column("x").combine_chunks()
    width = len(CLASSES) + 5 + BUCKETS
    size = x.value_lengths().to_numpy() // width
    flat = x.flatten().to_numpy().reshape(-1, width).astype(float)
    first = np.cumsum(size) - size
    # Tasks deliver rows in an open order; sorting them by content makes every run learn the same.
    order = np.lexsort((flat[first] @ np.arange(1, width + 1), size))
    flat = flat[A.spread(first[order], size[order])]
    label = rows.column("label").to_numpy()[order].astype(float)
    return train(np.repeat(np.arange(len(size)), size[order]), flat, label)


def score(text: Column | str, model: Model) -> Column:
    """How likely a text has label 1."""
    def values(part: pa.RecordBatch) -> np.ndarray:
        if model.constant is not None:
            return np.full(part.num_rows, model.constant)
        row, x = passages(part.column("text"))
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        x = np.clip((x.astype(np.float32) - model.mean) / model.scale, -8, 8)
        return _forward(x, first, row, model.parts)["p"]

    return by_slices(values, "double")(text)
