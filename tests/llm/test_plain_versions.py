"""Learning, signatures and searches against versions without arrays, and held-out labels that must change nothing."""

import math
import random
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobtally.llm import arrays as A, chunks, fuzzy, neighbours, preference, quality, queries, toxicity

MASK = (1 << 64) - 1


def plain_hash(data):
    x = sum((c + 1) * pow(A.BASE, j, 1 << 64) for j, c in enumerate(data)) & MASK
    x ^= x >> 33
    for f in A.FINISH:
        x = x * f & MASK
        x ^= x >> 33
    return x


# --- held-out labels ----------------------------------------------------------------

@pytest.mark.parametrize("name, column, table", [("op1_language", "lang", "documents"), ("op2_quality", "quality", "labels"), ("op5_toxicity", "toxic", "labels")])
def test_held_out_labels_change_no_score(spark, tmp_path, name, column, table):
    folder = "/root/testdata/sf0.01"
    shutil.copytree(folder, tmp_path / "other", ignore=shutil.ignore_patterns(f"{table}.parquet"))
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    folds, fold = (5, 0) if name == "op2_quality" else (3, 1)
    other = F.lit("xx") if column == "lang" else 1 - F.col(column)
    changed = rows.withColumn(column, F.when(queries.held_out(folds, fold), other).otherwise(F.col(column)).cast(rows.schema[column].dataType))
    changed.write.parquet(str(tmp_path / "other" / f"{table}.parquet"))
    assert rows.exceptAll(changed).count() > 0
    keep = ["doc_id", "held_out", *(c for c in ("lang_pred", "score", "predicted") if c in queries.QUERIES[name](spark, folder).columns)]
    before, after = (sorted(map(tuple, queries.QUERIES[name](spark, f).select(keep).collect())) for f in (folder, str(tmp_path / "other")))
    assert before == after


# --- quality ---------------------------------------------------------------------------

def plain_passages(text):
    data = text.encode()
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    parts = [words[k:k + quality.PASSAGE] for k in range(0, len(words), quality.PASSAGE)] or [[]]
    out = []
    for k, part in enumerate(parts):
        start = part[0][0] if part else 0
        end = parts[k + 1][0][0] if k + 1 < len(parts) else len(data)
        size, n = max(end - start, 1), max(len(part), 1)
        shares = [math.sqrt(sum(chr(c) in signs for c in data[start:end]) / size) for signs in quality.CLASSES]
        hashes = [plain_hash(data[a:b]) for a, b in part]
        lengths = [b - a for a, b in part]
        mean = sum(lengths) / n
        spread = math.sqrt(max(sum(x * x for x in lengths) / n - mean**2, 0))
        buckets = Counter(h % quality.BUCKETS for h in hashes)
        out.append(shares + [mean, spread, len(set(hashes)) / n, sum(a == b for a, b in zip(hashes, hashes[1:])) / n, math.log1p(len(part))]
                   + [math.sqrt(buckets[b] / n) for b in range(quality.BUCKETS)])
    return out


def plain_quality(x, model):
    w = model.parts
    x = np.clip((np.array(x, np.float32) - model.mean) / model.scale, -8, 8)
    energy = [float((np.tanh(r @ w["V"]) / (1 + np.exp(-(r @ w["U"])))) @ w["w"]) for r in x]
    top = max(energy)
    a = [math.exp(e - top) for e in energy]
    z = sum(k / sum(a) * np.tanh(r @ w["H"] + w["c"]) for k, r in zip(a, x))
    return 1 / (1 + math.exp(-float(z @ w["o"] + w["b"])))


def test_quality_scores_match_a_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter(~queries.held_out(5, 0)).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = quality.fit(docs.select(F.col("doc_id").alias("id"), "text"), known)
    texts = docs.filter("doc_id % 9 = 0 AND length(text) < 6000").select("doc_id", "text").collect()
    for r in texts[:30]:
        row, x = quality.passages(pa.array([r.text]))
        assert np.allclose(x, plain_passages(r.text or ""), atol=1e-9) and set(row) == {0}
    got = {r.doc_id: r.score for r in queries.op2_quality(spark, folder).collect()}
    assert all(got[r.doc_id] == pytest.approx(plain_quality(plain_passages(r.text or ""), model), abs=1e-5) for r in texts)
    assert np.allclose(quality.passages(pa.array([None, "", "a"]))[1], [p for t in ("", "", "a") for p in plain_passages(t)])


# --- positive-unlabelled learning --------------------------------------------------------

def plain_training(lists, positive, width, prior, steps, rate=0.1, shrink=1e-4):
    """The same models with a risk written down as it is and gradients by differences."""
    n, out = len(lists), []
    for m in range(toxicity.MODELS):
        drawn = set(np.random.default_rng(m).permutation(n)[: n // 2].tolist())

        def parts(v):
            g = [v[-1] + sum(v[i] for i in x) for x in lists]
            as_positive = sum(math.log1p(math.exp(-g[i])) for i in range(n) if positive[i]) / sum(positive)
            as_negative = sum(math.log1p(math.exp(g[i])) for i in range(n) if positive[i]) / sum(positive)
            of_unlabelled = sum(math.log1p(math.exp(g[i])) for i in drawn) / len(drawn)
            return prior * as_positive, of_unlabelled - prior * as_negative

        v = np.append(np.zeros(width), math.log(prior / (1 - prior)))
        first, second = np.zeros(width + 1), np.zeros(width + 1)
        for step in range(1, steps + 1):
            below = parts(v)[1] < 0
            risk = lambda u: -parts(u)[1] if below else sum(parts(u))  # noqa: B023, E731
            grad = np.array([(risk(v + d) - risk(v - d)) / 2e-5 for d in 1e-5 * np.eye(width + 1)]) + shrink * np.append(v[:-1], 0)
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            v = v - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        out.append(v)
    return np.array(out).T


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_training_follows_the_nonnegative_risk(prior):
    rng = np.random.default_rng(3)
    lists = [sorted(rng.choice(6, rng.integers(1, 5), replace=False).tolist()) for _ in range(40)]
    positive = np.array([0 in x and i % 2 == 0 for i, x in enumerate(lists)])
    found = toxicity.train(np.concatenate(lists), np.array([len(x) for x in lists]), positive, np.ones(40, bool), np.arange(6, dtype=np.uint64), prior, 12)
    expected = plain_training(lists, positive, 6, prior, 12)
    assert np.allclose(found.weights, expected[:-1], atol=2e-3) and np.allclose(found.offsets, expected[-1], atol=2e-3)


# --- fingerprints ----------------------------------------------------------------------------

def plain_fingerprint(data):
    own = [(c + 1) * 2654435761 & 0xFFFFFFFF for c in data]
    level = []
    for i in range(len(data)):
        v = sum((own[i - k] >> k + 3 ^ own[i - k] << 2 * k) & 0xFFFFFFFF for k in range(fuzzy.WINDOW)) if i >= fuzzy.WINDOW - 1 else own[i] * 40503 + 1
        v &= 0xFFFFFFFF
        v ^= v >> 15
        v = v * 0x2C1B3C6D & 0xFFFFFFFF
        v ^= v >> 12
        whole, rest = divmod(v, fuzzy.LEAST_BLOCK)
        whole |= 1 << 31
        level.append((whole & -whole).bit_length() - 1 if rest == 0 else -1)
    block = 0
    while sum(x >= block for x in level) + 1 > fuzzy.LENGTH:
        block += 1
    signs = []
    for k in (block, block + 1):
        ends = [i + 1 for i, x in enumerate(level) if x >= k]
        cut = [0, *ends] if ends and ends[-1] == len(data) else [0, *ends, len(data)]
        signs.append("".join(chr(fuzzy.SIGNS[plain_hash(data[a:b]) >> 58]) for a, b in zip(cut, cut[1:])) if data else "")
    return f"{fuzzy.LEAST_BLOCK << block}:{signs[0]}:{signs[1]}"


def test_fingerprints_match_a_plain_version():
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abcdef \n", k=n)) for n in [*range(12), 40, 200, 700, 3000]] + ["ünïcode".encode() * 30, b"a" * 500]
    assert fuzzy.fingerprints(texts) == [plain_fingerprint(t) for t in texts]
    for n in range(9):  # alone, a text may be shorter than the window
        assert fuzzy.fingerprints([b"x" * n]) == [plain_fingerprint(b"x" * n)]
    assert fuzzy.fingerprints([b"a", b""]) == [plain_fingerprint(b"a"), plain_fingerprint(b"")]


@pytest.mark.parametrize("texts", [["a"], ["a", ""], ["abcd"], [None], ["ab", "cd", "e"]])
def test_fingerprints_of_tiny_tables(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fuzzy.fingerprinted(docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: plain_fingerprint((t or "").encode()) for i, t in enumerate(texts)}


# --- preference ------------------------------------------------------------------------------

def test_every_conversation_has_a_row(spark, sf_dir):
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().collect()} - {None}
    got = queries.op6_preference(spark, sf_dir).collect()
    assert sorted(r.conv_id for r in got) == sorted(ids)


def test_conversations_without_a_partner_or_an_answer(spark):
    turns = [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "more"), (4, 0, "user", "alone"), (6, 0, "user", "q"), (6, 1, "assistant", "x"),
             (7, 0, "user", "r"), (7, 1, "assistant", "y"), (7, 2, "assistant", None)]
    talks = preference.conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    got = {r.id: r for r in preference.formatted(preference.swapped_answers(talks)).collect()}
    assert (got[2].n_common, got[2].rejected_text, got[2].rejected_spans) == (1, "", []) and got[2].chosen_text.startswith("<|assistant|>\na<|end|>")
    assert (got[4].n_common, got[4].chosen_text, got[4].rejected_text) == (1, "", "")
    assert got[6].n_common == 1 and got[6].rejected_text == "<|assistant|>\n<|end|>\n" and "x<|end|>" in got[6].chosen_text
    assert got[7].n_common == 2 and "x<|end|>" in got[7].rejected_text


def test_inputs_named_like_outputs_give_way(spark):
    kind = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, [("user", "q")], [("user", "q")], 9, "old", "kept")], f"id int, chosen {kind}, rejected {kind}, n_common int, prompt string, __a string")
    got = preference.formatted(pairs)
    assert got.columns == ["id", "__a", *preference.OUTPUTS]
    r = got.first()
    assert (r.n_common, r.prompt, r["__a"]) == (1, "<|user|>\nq<|end|>\n", "kept")


# --- nearest ---------------------------------------------------------------------------------

def plain_nearest(rows, is_query, k=5):
    out = {}
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and any(v)})
    for i, v in good:
        if is_query(i):
            near = [(-float(np.dot(v, o) / np.linalg.norm(v) / np.linalg.norm(o)), j) for j, o in good if j != i and len(o) == len(v)]
            out[i] = [j for _, j in sorted((round(c, 12), j) for c, j in near)[:k]]
    return out


@pytest.mark.parametrize("n", [2, 3, 6, 7, 40, 64, 65])
def test_few_candidates_are_all_given(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(n)] + [(1000 + i, [float(c) for c in rng.normal(size=3)]) for i in range(4)]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == plain_nearest(rows, lambda i: True)
    assert all(len(got[i]) == min(5, n - 1) for i in range(n)) and all(len(got[1000 + i]) == 3 for i in range(4))


def test_bounds_are_measured_and_far_files_stay_unread(spark):
    """In clusters few files are read; every query still gets its neighbours, an outlier and a copied vector too."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 6
    x = centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16))
    x[7] = -x[7] * 3
    x[2000:3300] = x[2000]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, read = defaultdict(list), []
    bounds = neighbours.bounds
    neighbours.bounds = lambda *a: read.append(bounds(*a)) or read[-1]
    try:
        for r in neighbours.nearest(table, (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == 7)).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
    finally:
        neighbours.bounds = bounds
    files, near = read[0]
    assert files < 64 and near < 32768
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for i in got:
        c = u @ u[i]
        c[i] = -9
        assert [j for j, _ in got[i]] == sorted((j for j, _ in got[i]), key=lambda j: (-round(c[j], 12), j))
        assert len(got[i]) == 5 and all(abs(c[j] - s) < 1e-12 for j, s in got[i])
        hits.append(sum(s >= np.sort(c)[-5] - 1e-12 for _, s in got[i]) / 5)
    assert len(got) == 81 and np.mean(hits) >= 0.95
    assert [j for j, _ in got[2050]] == [2000, 2001, 2002, 2003, 2004]  # ties go to smaller ids


def test_footrule_and_files():
    rng = np.random.default_rng(0)
    pivots = neighbours._unit(rng.normal(size=(256, 8)))
    place = neighbours.positions(rng.normal(size=(50, 8)), pivots)
    assert (np.sort(place, axis=1) == np.arange(256)).all()
    assert neighbours.footrule(place, place[3]).tolist() == [sum(abs(int(a) - int(b)) for a, b in zip(p, place[3])) for p in place]
    assert neighbours.footrule(np.arange(256, dtype=np.uint8)[None, :], np.arange(256, dtype=np.uint8)[::-1])[0] == 32768
    assert all(set(f) == {int(np.flatnonzero(p == 0)[0]), int(np.flatnonzero(p == 1)[0])} for f, p in zip(neighbours.files_of(place), place))


# --- chunks ----------------------------------------------------------------------------------

def plain_extended(text, earlier, where, anchors, words):
    """What every anchor at every place covers."""
    white, out = b" \n", set()
    for s, size, digest in anchors:
        for o in where.get(digest, ()):
            first, last, shift = s, s, o - s
            while last < len(text) and last + shift < len(earlier) and text[last] == earlier[last + shift]:
                last += 1
            if last < s + size:
                continue
            while first > 0 and first + shift > 0 and text[first - 1] == earlier[first + shift - 1]:
                first -= 1
            inner = lambda t, at: 0 < at < len(t) and t[at - 1] not in white and t[at] not in white
            while first < last and (inner(text, first) or inner(earlier, first + shift)):
                first += 1
            while last > first and (inner(text, last) or inner(earlier, last + shift)):
                last -= 1
            if len(text[first:last].split()) >= words:
                found = text[first:last]
                first += len(found) - len(found.lstrip())
                out.update(range(first, first + len(found.strip())))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_anchors_with_many_places_lose_nothing(seed):
    """Phrases that come back dozens of times, in another order or with another word now and then."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"{'abcdefgh'[i % 8] * (1 + i % 5)}{i}" for i in range(60)]
    phrases = [" ".join(rng.choice(vocabulary, rng.integers(25, 60))) for _ in range(3)]

    def made(n):
        parts = [phrases[i] for i in rng.choice(3, n)]
        for i in rng.choice(n, n // 4, replace=False):
            parts[i] = " ".join(w if rng.random() > 0.05 else "x" for w in parts[i].split())
        return " ".join(parts).encode()

    earlier, text = made(60), made(20)
    words = 50
    begin, size, known = chunks._anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words)
    where = chunks._places(earlier, words)
    got = {at for a, b in chunks._extended(text, earlier, where, begin, size, known, words) for at in range(a, b)}
    plain = plain_extended(text, earlier, where, list(zip(begin.tolist(), size.tolist(), known.tolist())), words)
    assert plain and max(len(p) for p in where.values()) > 8
    assert got == plain
