"""Encoding into vocabulary pieces and back, by a Viterbi search that shares the work of common prefixes.

A text is marked (a mark in front and for every space) and split into marked words, which no piece can cross. The
distinct marked words of a batch that were not met before are sorted, which lays them out as a trie walked depth first:
a word keeps the best scores and back pointers of the prefix it has in common with the one before, and only the
positions below are searched anew. The best segmentation has the greatest sum of piece scores; among equals the longer
last piece wins. Characters without a piece are spelled in byte pieces.

Scores are logarithms of piece probabilities. A file of merges has ranks in their place, which mean nothing when added; they
become the probabilities of a Zipf-Mandelbrot law, 1 / (rank + FLAT) over its sum. With FLAT this large two pieces never
beat one, and among equally many the frequent ones win.

Cases: a null text has null pieces, an empty one no pieces. The mark itself in a text is spelled in bytes, so every text
comes back exactly. Runs of any length are searched whole.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from jobtally.llm.work import by_slices

MARK = "▁"
UNKNOWN_BELOW_WORST = 10.0
FLAT = 1_000
CACHE = 200_000  # words that a worker remembers
# A marked word: marks and what follows up to the next mark. A line feed is in no piece but its byte, so it ends one, too.
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
HELD = "\udfff"  # stands for a mark that the text itself contains: no text can hold a lone surrogate


class Vocabulary(NamedTuple):
    """Id and score of every piece, the ids of the 256 byte pieces, the bytes of every id, and the score of a character
    without a piece."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    spelled: list[bytes]
    unknown: float


def trie(pieces: dict[str, tuple[int, float]]) -> tuple:
    """Nodes of (children by character, id or -1, score)."""
    def node(below: dict[str, tuple[int, float]]) -> tuple:
        heads: dict[str, dict] = {}
        for rest, value in below.items():
            if rest:
                heads.setdefault(rest[0], {})[rest[1:]] = value
        return {c: node(x) for c, x in heads.items()}, *below.get("", (-1, 0.0))

    return node(pieces)


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file, read on the driver and sent along with the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, spelled = {}, [0] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i):
            spelled.append(b"")
        else:
            pieces[piece] = (i, model.get_score(i))
            spelled.append(piece.replace(MARK, " ").encode())
    if all(float(s).is_integer() for _, s in pieces.values()):
        pieces = _from_ranks(pieces)
    crossing = [p for p in pieces if re.search(f"[^{MARK}]{MARK}|.\n|\n.", p)]
    if crossing:
        raise ValueError(f"pieces cross marked words: {crossing[:5]}")
    return Vocabulary(pieces, byte_ids, spelled, min(s for _, s in pieces.values()) - UNKNOWN_BELOW_WORST)


def _from_ranks(pieces: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    """The pieces with log probabilities by their order; equal ranks go by id."""
    order = sorted(pieces, key=lambda p: (-pieces[p][1], pieces[p][0]))
    total = sum(1 / (rank + FLAT) for rank in range(len(order)))
    return {p: (pieces[p][0], -math.log((rank + FLAT) * total)) for rank, p in enumerate(order)}


def segment(words: list[str], vocabulary: Vocabulary, root: tuple) -> dict[str, list[int]]:
    """Ids of every marked word. `words` are walked in sorted order, as a trie; the stack holds the current path."""
    byte_ids, unknown = vocabulary.byte_ids, vocabulary.unknown
    lowest = -np.inf
    # At every depth of the path: best score, start and id of its last piece, and the pieces that may still go on.
    score, back, ids, alive = [0.0], [0], [-1], [[(root[0], 0, 0.0)]]
    out, before = {}, ""
    for word in sorted(words):
        common, most = 0, min(len(word), len(before))
        while common < most and word[common] == before[common]:
            common += 1
        del score[common + 1:], back[common + 1:], ids[common + 1:], alive[common + 1:]
        open_pieces = alive[common]
        for end, char in enumerate(word[common:], common + 1):
            best, at, own, still = lowest, end - 1, -1, []
            for children, start, so_far in open_pieces:
                below = children.get(char)
                if below is not None:
                    if below[0]:
                        still.append((below[0], start, so_far))
                    if below[1] >= 0 and so_far + below[2] > best:
                        best, at, own = so_far + below[2], start, below[1]
            if score[-1] + unknown > best and (char not in root[0] or root[0][char][1] < 0):
                best, at, own = score[-1] + unknown, end - 1, -1
            still.append((root[0], end, best))
            score.append(best)
            back.append(at)
            ids.append(own)
            alive.append(still)
            open_pieces = still
        path, end = [], len(word)
        while end:
            start = back[end]
            if ids[end] >= 0:
                path.append(ids[end])
            else:
                char = MARK if word[start] == HELD else word[start:end]
                path.extend(byte_ids[b] for b in reversed(char.encode()))
            end = start
        path.reverse()
        out[word] = path
        before = word
    return out


def marked_words(text: str) -> list[str]:
    return MARKED_WORD.findall(MARK + text.replace(MARK, HELD).replace(" ", MARK))


def encoder(vocabulary: Vocabulary):
    """A function from texts to (ids of all texts one after another, sizes). It remembers words between calls."""
    root = trie(vocabulary.pieces)
    known: dict[str, int] = {}
    flat, first = array("i"), array("q")

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > CACHE:
            known.clear()
            del flat[:], first[:]
        split = [marked_words(t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in known}
        for word, ids in segment(list(new), vocabulary, root).items():
            known[word] = len(first)
            first.append(len(flat))
            flat.extend(ids)
        starts = np.append(np.array(first, np.int64), len(flat))
        sizes = np.diff(starts)
        use = np.fromiter((known[w] for words in split for w in words), np.int64)
        per_text = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in split], out=per_text[1:])
        total = np.concatenate([[0], np.cumsum(sizes[use])])
        count = np.diff(total[per_text])
        spread = np.repeat(starts[use] - total[:-1], sizes[use]) + np.arange(total[-1])
        return np.array(flat, np.int32)[spread], count

    return encode


_KEPT: dict[int, Callable] = {}


def _ids_of(vocabulary: Vocabulary) -> Callable[[pa.RecordBatch], pa.ListArray]:
    """The piece ids of a batch. A Python worker keeps the words it has met for its next tasks."""
    name = zlib.crc32(repr((vocabulary.pieces, vocabulary.unknown)).encode())

    def ids_of(part: pa.RecordBatch) -> pa.ListArray:
        column = part.column("text")
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = encoder(vocabulary)
        ids, count = _KEPT[name](column.to_pylist())
        bounds = np.zeros(len(count) + 1, np.int32)
        np.cumsum(count, out=bounds[1:])
        ends = pa.array(bounds, mask=np.r_[column.is_null().to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))

    return ids_of


def _texts_of(spelled: list[bytes]) -> Callable[[pa.Array], pa.Array]:
    count = len(spelled)

    def texts_of(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            if not row.is_valid:
                out.append(None)
                continue
            whole = b"".join([spelled[i] if 0 <= i < count else b"" for i in row.values.to_numpy().tolist()])
            out.append(whole[1:].decode("utf-8", "replace") if whole[:1] == b" " else whole.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return texts_of


def encoded(text: Column | str, vocabulary: Vocabulary) -> Column:
    """Piece ids of a text."""
    return by_slices(_ids_of(vocabulary), "array<int>")(text)


def decoded(ids: Column | str, vocabulary: Vocabulary) -> Column:
    """The text of piece ids: their bytes one after another, without the first mark. Ids outside the vocabulary have none."""
    return F.arrow_udf("string")(_texts_of(vocabulary.spelled))(ids)


def coded(text: Column | str, vocabulary: Vocabulary) -> Column:
    """A struct of the piece ids of a text and the text that they decode to, both made by one Python worker."""
    ids_of, texts_of = _ids_of(vocabulary), _texts_of(vocabulary.spelled)

    def both(part: pa.RecordBatch) -> pa.StructArray:
        ids = ids_of(part)
        return pa.StructArray.from_arrays([ids, texts_of(ids)], ["ids", "back"])

    return by_slices(both, "struct<ids:array<int>,back:string>")(text)
