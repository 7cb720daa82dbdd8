"""Language identification with segmentation-marginalised unigrams.

A word, marked in front, can be cut into pieces of a fixed public vocabulary in many ways. Under a language it has the
probability of all ways together: the sum, over segmentations, of the product of the pieces' probabilities in that
language, found by the forward algorithm. The probabilities come from expectation maximisation (forward and backward)
over words counted in texts of known language. A text scores the sum of its words' log probabilities plus the log
share of the language; the result is the likeliest language and its posterior. Words are runs of letters, in lower
case; all words of a batch that have the same length are computed together.

Cases: null texts and texts without a letter are `und` with score 0; a letter outside the vocabulary has a small
probability of its own; equal scores go to the smaller language name; without known languages everything is `und`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtally.llm import arrays as A
from jobtally.llm.work import by_slices, slices, unit

MARK = "▁"
UNDETERMINED = "und"
CACHE = 600_000
RESCALE = 16
SMOOTH = 0.1
UNSEEN_LETTERS = 1_000  # what the probability of a letter outside the vocabulary is divided by
MAYBE_BITS = 20


class Pieces(NamedTuple):
    """By length, the sorted hashes of the pieces and their rows in the table of probabilities."""

    keys: dict[int, np.ndarray]
    rows: dict[int, np.ndarray]
    count: int


class Model(NamedTuple):
    languages: list[str]
    pieces: Pieces
    chance: np.ndarray  # (pieces + 1, languages); the last row is a letter without a piece
    share: np.ndarray


def load_pieces(path: str) -> Pieces:
    """The lower-case letter pieces of a vocabulary file, with and without the mark in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.vocab_size())
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    texts = [t for t in texts if t.lstrip(MARK).isalpha() and t == t.lower() and t.count(MARK) == t.startswith(MARK)]
    texts.append(MARK)
    texts = sorted(set(texts))
    codes, bounds = A.code_points(texts)
    hashes, size = A.Hashes(codes).of(bounds[:-1], bounds[1:]), np.diff(bounds)
    keys, rows = {}, {}
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        order = at[np.argsort(hashes[at])]
        keys[int(n)], rows[int(n)] = hashes[order], order
    return Pieces(keys, rows, len(texts))


class Lattice:
    """The pieces that fit into each of a set of marked words of one length: for every end and length, words and rows."""

    def __init__(self, words: np.ndarray, pieces: Pieces):
        n, self.length = words.shape
        codes = words.ravel()
        hashes = A.Hashes(codes)
        base = np.arange(n) * self.length
        self.arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.length + 1)]
        for end in range(1, self.length + 1):
            for size in pieces.keys:
                if size > end:
                    continue
                h = hashes.of(base + end - size, base + end)
                at = np.searchsorted(pieces.keys[size], h)
                at[at == len(pieces.keys[size])] = 0
                fits = pieces.keys[size][at] == h
                word = np.flatnonzero(fits)
                if len(word):
                    self.arcs[end].append((size, word, pieces.rows[size][at[word]]))
                if size == 1:
                    other = np.flatnonzero(~fits)
                    if len(other):
                        self.arcs[end].append((1, other, np.full(len(other), pieces.count)))

    def forward(self, chance: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scaled sums over the segmentations of every prefix, and the log of what each was scaled by, by language."""
        alpha, scale = [np.ones((n, chance.shape[1]))], [np.zeros((n, chance.shape[1]))]
        for end in range(1, self.length + 1):
            now, level = np.zeros_like(alpha[0]), scale[-1]
            for size, word, row in self.arcs[end]:
                now[word] += alpha[end - size][word] * chance[row] * _rescaled(scale[end - size], level, word)
            if end % RESCALE == 0 and end < self.length:
                top = np.maximum(now, 1e-300)
                now, level = now / top, level + np.log(top)
            alpha.append(now)
            scale.append(level)
        return alpha, scale

    def expected(self, chance: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, by language, in words that occur `weight` times."""
        n = len(weight)
        alpha, scale = self.forward(chance, n)
        beta = [np.zeros_like(alpha[0]) for _ in range(self.length)] + [weight / np.maximum(alpha[-1], 1e-300)]
        out = np.zeros_like(chance)
        for end in range(self.length, 0, -1):
            for size, word, row in self.arcs[end]:
                flow = chance[row] * beta[end][word] * _rescaled(scale[end - size], scale[end], word)
                beta[end - size][word] += flow
                used = alpha[end - size][word] * flow
                for k in range(chance.shape[1]):
                    out[:, k] += np.bincount(row, used[:, k], len(chance))
        return out


def _rescaled(one: np.ndarray, other: np.ndarray, word: np.ndarray) -> np.ndarray | float:
    """What a sum at one scale is multiplied by at another; positions between two rescalings share theirs."""
    return 1.0 if one is other else np.exp(one[word] - other[word])


def _words(texts: list[str]) -> tuple[np.ndarray, A.Words, np.ndarray]:
    codes, bounds = A.code_points([t.lower() for t in texts])
    words = A.runs(A.letters()[codes], bounds)
    return codes, words, A.Hashes(codes).of(words.start, words.end)


def _matrices(codes: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each length: which words have it, and the marked words as rows."""
    size = end - start
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        for part in np.array_split(which, max(1, -(-len(which) * int(n) // (1 << 18)))):
            rows = np.empty((len(part), n + 1), np.uint32)
            rows[:, 0] = ord(MARK)
            rows[:, 1:] = codes[start[part][:, None] + np.arange(n)]
            yield part, rows


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column("text").fill_null("").to_pylist()


def _word_counts(batches):
    for part in slices(batches, "text"):
        codes, words, _ = _words(_texts(part))
        where = part.column("lang")
        seen: dict[tuple, int] = {}
        langs = where.to_pylist()
        for s, e, r in zip(words.start.tolist(), words.end.tolist(), words.row.tolist()):
            key = (langs[r], codes[s:e].tobytes())
            seen[key] = seen.get(key, 0) + 1
        yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1].decode("utf-32-le") for k in seen], pa.string()),
                               pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])


def fit(texts: DataFrame, path: str, most: int = 600, rounds: int = 3, seed: str = "language") -> Model:
    """Learn from `texts` (id, text, lang): about `most` texts of every language, chosen by a hash of the id."""
    pieces = load_pieces(path)
    known = texts.filter("lang IS NOT NULL AND text IS NOT NULL")
    held = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not held:
        return Model([], pieces, np.zeros((pieces.count + 1, 0)), np.zeros(0))
    languages = sorted(held, key=str.encode)
    spark = texts.sparkSession
    chance = spark.createDataFrame([(k, min(1.0, most / n)) for k, n in held.items()], "lang string, keep double")
    sample = known.join(F.broadcast(chance), "lang").filter(unit("id", seed) < F.col("keep")).select("text", "lang")
    counts = (sample.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word")
              .agg(F.sum("n").alias("n")).toPandas())
    which, names = counts["word"].factorize(sort=True)  # as objects: one long word must not widen all others
    weight = np.zeros((len(names), len(languages)))
    np.add.at(weight, (which, [languages.index(k) for k in counts["lang"]]), counts["n"])
    share = np.array([held[k] for k in languages], float)
    return Model(languages, pieces, learned(list(names), weight, pieces, rounds), share / share.sum())


def learned(words: list[str], weight: np.ndarray, pieces: Pieces, rounds: int) -> np.ndarray:
    codes, bounds = A.code_points(words)
    lattices = [(part, Lattice(rows, pieces)) for part, rows in _matrices(codes, bounds[:-1], bounds[1:])]
    chance = np.full((pieces.count + 1, weight.shape[1]), 1 / (pieces.count + 1))
    for _ in range(rounds):
        uses = np.zeros_like(chance)
        for part, lattice in lattices:
            uses += lattice.expected(chance, weight[part])
        chance = (uses + SMOOTH) / (uses + SMOOTH).sum(axis=0)
        chance[-1] /= UNSEEN_LETTERS
    return chance


_KEPT: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _word_scores(codes, start, end, hashes, model: Model) -> np.ndarray:
    """Log probabilities of words by language; what a Python worker has computed serves its later batches."""
    name = str(A.mixed(model.chance.view(np.uint64).ravel()).sum())
    if name not in _KEPT or len(_KEPT[name][0]) > CACHE:
        _KEPT.clear()
        _KEPT[name] = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))
    keys, scores = _KEPT[name]
    distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    at = np.searchsorted(keys, distinct)
    known = np.zeros(len(distinct), bool)
    if len(keys):
        known = keys[np.minimum(at, len(keys) - 1)] == distinct
    new = np.flatnonzero(~known)
    if len(new):
        fresh = np.empty((len(new), len(model.languages)))
        for part, rows in _matrices(codes, start[first[new]], end[first[new]]):
            alpha, scale = Lattice(rows, model.pieces).forward(model.chance, len(part))
            fresh[part] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1]
        keys, scores = np.insert(keys, at[new], distinct[new]), np.insert(scores, at[new], fresh, axis=0)
        _KEPT[name] = keys, scores
    return scores[np.searchsorted(keys, distinct)][back]


def identify(text: Column | str, model: Model) -> Column:
    """Struct of the likeliest language of a text and its posterior."""
    def values(part: pa.RecordBatch) -> pa.Array:
        n, k = part.num_rows, len(model.languages)
        found, score = np.full(n, UNDETERMINED, object), np.zeros(n)
        codes, words, hashes = _words(_texts(part))
        if k and len(hashes):
            each = _word_scores(codes, words.start, words.end, hashes, model)
            first = np.flatnonzero(np.r_[True, words.row[1:] != words.row[:-1]])
            total = np.add.reduceat(each, first, axis=0) + np.log(model.share)
            best = total.argmax(axis=1)
            at = words.row[first]
            found[at] = np.array(model.languages, object)[best]
            score[at] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score)], ["lang", "score"])

    return by_slices(values, "lang string, score double")(text)
