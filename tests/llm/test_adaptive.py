"""Quality rules with limits that follow the data: counts, sketches, limits and the filter against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtally.llm import adaptive

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept string, measure string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 7, "x", "y", 3) for i, t, lang, s in rows], SCHEMA)


def plain_counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines),
            len(lines) - len(set(lines)), len(covered))


def test_counts_match_a_plain_version():
    rng = random.Random(5)
    texts = [None, "", " \n\t\v\f\r ", "a", "a b", "a a a", "a a a a", "x y z", "日本 語 😀", "l\nl\n\nl \nl", "a\rb\n a\rb\n"]
    texts += [" ".join(rng.choice("ab#c") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["word " * 30_000, "\n".join(f"line {i % 70} é" for i in range(5_000))]
    got = adaptive.counted([t if t is None else t.encode() for t in texts]).to_pylist()
    assert [tuple(g[c] for c in adaptive.COUNTS) for g in got] == [plain_counts(t) for t in texts]
    assert adaptive.counted([]).to_pylist() == []


def test_bins_are_as_fine_as_promised(spark):
    values = [0, 1, 5, 1023, 1024, 1025, 2047, 2048, 5_123_456, 10**12 + 7, (1 << 62) + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(
        "v", adaptive.bin_of(F.col("v")).alias("bin"), adaptive.middle(adaptive.bin_of(F.col("v"))).alias("mid")).collect()
    for r in got:
        assert r.bin <= r.v and (r.v < 1024) <= (r.bin == r.v) and abs(r.mid - r.v) * 1024 <= max(r.v, 1024)


def sketches_of(spark, rows):
    full = [(lang, s, *plain_counts(t)) for _, t, lang, s in rows]
    counts = spark.createDataFrame(full, "lang string, source string, " + ", ".join(f"{c} long" for c in adaptive.COUNTS))
    return adaptive.sketched(counts.withColumn("base_failed", adaptive.base_failed()), ["lang", "source"])


def texts(n, seed, symbol=0.0):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) + ("#$" if rng.random() < symbol else "")
    return [" ".join(word() for _ in range(rng.randrange(55, 120))) for _ in range(n)]


def test_sketches_merge(spark):
    rows = [(i, t, "en", "a" if i % 3 else "b") for i, t in enumerate(texts(60, 1))]
    key = ["lang", "source", "measure", "bin", "n"]
    whole = sorted(map(tuple, sketches_of(spark, rows).select(key).collect()))
    parts = sketches_of(spark, rows[:25]).union(sketches_of(spark, rows[25:]))
    assert sorted(map(tuple, adaptive.merged(parts, ["lang", "source"]).select(key).collect())) == whole
    assert {r.n for r in adaptive.quartiles(adaptive.merged(parts, []), []).collect()} == {60}


def test_quartiles_are_within_the_stated_error(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(texts(501, 2))]
    lengths = sorted(1_000_000 * c // n for n, c, *_ in (plain_counts(t) for _, t, *_ in rows))
    got = {r.measure: r for r in adaptive.quartiles(sketches_of(spark, rows), ["lang", "source"]).collect()}["word_length"]
    assert got.n == 501
    for found, exact in ((got.q1, lengths[125]), (got.q3, lengths[375])):
        assert abs(found - exact) * 1024 <= exact


def plain_kept(rows, stretch=3, least=100):
    """The same rules, with lists of all values instead of sketches; values are cut to their bins first."""
    def low_end(v):
        drop = max(v.bit_length() - adaptive.BITS, 0)
        return v >> drop << drop

    def mid(v):
        return v + ((1 << max(v.bit_length() - adaptive.BITS, 0)) >> 1)

    measured, out = {}, {}
    for at, (_, t, lang, s) in enumerate(rows):
        n = dict(zip(adaptive.COUNTS, plain_counts(t)))
        if n["n_words"] >= 50 and 100 * n["n_repeat_words"] <= 50 * n["n_words"]:
            measured[at] = {m: 1_000_000 * n[a] // max(n[b], 1) for m, (a, b, _) in adaptive.MEASURES.items()}
    for at, (_, _, lang, s) in enumerate(rows):
        out[at] = at in measured
        for m, (_, _, least_spread) in adaptive.MEASURES.items() if at in measured else ():
            groups = [[measured[k][m] for k in measured if rows[k][2:] == (lang, s)], [measured[k][m] for k in measured if rows[k][2] == lang],
                      [measured[k][m] for k in measured]]
            group = next((g for g in groups[:2] if len(g) >= least), groups[2])
            bins = sorted(map(low_end, group))
            q1, q3 = (mid(bins[-(-q * len(bins) // 4) - 1]) for q in (1, 3))
            spread = stretch * max(q3 - q1, least_spread)
            out[at] &= q1 - spread <= measured[at][m] <= q3 + spread
    return out


def test_limits_follow_their_group_and_small_groups_follow_their_language(spark):
    rows = [(0, t, "en", "a") for t in texts(130, 3)] + [(0, t, "en", "noisy") for t in texts(130, 4, symbol=0.4)]
    rows += [(0, t, "en", None) for t in texts(10, 5)] + [(0, t, None, "a") for t in texts(8, 6)]
    rows += [(0, t, "en", "a") for t in texts(3, 7, symbol=1.0)] + [(0, "verylongwordsonly" * 3 + " " + t.replace(" ", "qqqqqqqq "), "en", "a") for t in texts(2, 8)]
    rows += [(0, None, "en", "a"), (0, "", None, None), (0, "short text", "en", "a"), (0, "again and again " * 40, "en", "a")]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r.doc_id: r.kept for r in adaptive.judged(frame(spark, rows)).collect()}
    assert got == plain_kept(rows)
    clean = [got[i] for i in range(130)]
    assert sum(clean) >= 128 and not any(got[i] for i in range(278, 287))
    assert sum(got[i] for i in range(130, 260)) >= 128  # what is common in a source is no reason to refuse it


def test_awkward_tables(spark):
    assert adaptive.judged(frame(spark, [])).collect() == []
    only = adaptive.judged(frame(spark, [(None, None, None, None), (1, "a b c", "en", None), (1, "a b c", "en", None)])).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in only) == [(0, True, False), (3, True, False), (3, True, False)]
    assert adaptive.judged(frame(spark, [(1, " ".join(f"w{i}" for i in range(60)), "en", None)])).collect()[0].kept


def test_other_column_names(spark):
    rows = spark.createDataFrame([("k", texts(1, 9)[0], "en", "a")], "key string, body string, tongue string, origin string")
    got = adaptive.judged(rows, "key", "body", "tongue", "origin")
    assert got.columns[:3] == ["key", "tongue", "origin"] and got.first().kept


def test_one_hot_source_keeps_every_row(spark):
    rows = [(i, t, "en", "hot") for i, t in enumerate(texts(40, 10) * 5)] + [(900 + i, t, "en", f"s{i}") for i, t in enumerate(texts(30, 11))]
    got = adaptive.judged(frame(spark, rows))
    assert got.count() == 230 and sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_repeated_words_of_short_rows(n):
    rng = np.random.default_rng(n)
    word, row = rng.integers(0, 2, n), np.sort(rng.integers(0, 3, n))
    expected = defaultdict(int)
    for r in range(3):
        expected[r] = plain_counts(" ".join(f"w{w}" for w in word[row == r]))[-1]
    assert adaptive.repeated_words(word, row, 3).tolist() == [expected[r] for r in range(3)]
