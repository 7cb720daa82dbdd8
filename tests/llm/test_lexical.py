"""Ranked search: whole tables against a brute-force version, and what the limit on accumulators saves."""

import math
import random
import re
from collections import Counter

import numpy as np

from jobtally.llm import lexical, queries

DOCS, ITEMS = "doc_id long, text string, item_id int, n int, terms string, score int", "item_id long, text string, doc_id int, rank int"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in docs], DOCS),
            spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS))


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=50):
    held = [(i, Counter(split(t)), len(split(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            score = 0
            for t in set(split(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * n * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def test_the_whole_table_matches_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, "text").collect() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found(queries.op13_lexical_search(spark, sf_dir)) == plain(docs, items)


def random_tables(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    return docs, [(i, " ".join(rng.choices(words, weights, k=12))) for i in range(20)]


def test_random_tables_in_any_layout_and_in_blocks(spark):
    docs, items = random_tables(1)
    expected = plain(docs, items, 7)
    left, right = tables(spark, docs, items)
    for parts in (1, 5):
        assert found(lexical.ranked(left.repartition(parts), right, k=7)) == expected
    assert found(lexical.ranked(left, right, k=7, block_bytes=150)) == expected


def test_ties_go_by_id_and_rows_without_an_id_come_last(spark):
    docs = [(9, "alpha beta"), (3, "beta alpha"), (None, "alpha beta"), (3, "alpha beta"), (5, "gamma"), (6, "Alpha-BETA")]
    left, right = tables(spark, docs, [(1, "alpha"), (1, "alpha"), (2, "nothing here"), (None, "gamma")])
    got = found(lexical.ranked(left, right, k=4))
    assert [(i, r, d) for i, r, d, _ in got if i == 1] == sorted([(1, 1, 3), (1, 2, 3), (1, 3, 6), (1, 4, 9)] * 2)
    assert [(i, r, d) for i, r, d, _ in got if i is None] == [(None, 1, 5)]
    assert [d for i, _, d, _ in found(lexical.ranked(left, right, k=9)) if i == 1].count(None) == 2


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n-!"), (4, "é" * 3 + " \x00 naïve ÉCOLE 日本語"), (5, "x " * 60_000 + "rare"), (6, "x y"), (6, "x y")]
    items = [(1, None), (2, ""), (3, "?!"), (4, "naïve École 日本語 ÉCOLE"), (5, "RARE x y y y"), (6, " ")]
    left, right = tables(spark, docs, items)
    assert found(lexical.ranked(left, right)) == plain(docs, items)
    assert lexical.ranked(left.limit(0), right).collect() == [] and lexical.ranked(left, right.limit(0)).collect() == []
    assert lexical.ranked(left, right).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_term_in_every_document_scores_nothing_alone(spark):
    docs = [(i, "the common words") for i in range(3000)]
    left, right = tables(spark, docs, [(1, "the")])
    assert found(lexical.ranked(left, right)) == plain(docs, [(1, "the")])


def test_tokens_are_those_of_the_pattern():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 3000), 0x1F600])) for _ in range(30))
        assert [t.decode() for t in lexical.terms_of(text.encode())] == split(text)


def test_common_terms_make_no_accumulators():
    """Ten documents hold the rare terms, a thousand the common one: once ten scores are out of reach, only survivors go on."""
    n, weights = 1000, np.array([6000, 5000, 300], np.int64)
    doc = np.r_[np.arange(10), np.arange(10), np.arange(n)]
    term = np.r_[np.zeros(10, int), np.ones(10, int), np.full(n, 2)]
    search = lexical.Search([], weights, n, n * 10, 10)
    postings = lexical.Postings(term, doc, np.ones(len(doc), np.int64), np.full(n, 10), search)
    found, scores, made = lexical.best([0, 1, 2], weights, postings, n, 10, 0)
    assert made == 10 and found.tolist() == list(range(10))
    each = int(postings.factor[0])
    assert set(scores.tolist()) == {11_300 * each}
    # A score that earlier documents reached stops even the rarest term.
    assert lexical.best([0, 1, 2], weights, postings, n, 10, 11_301 * each)[2] == 0
    # Equal scores may still win by id, so what just reaches the floor is kept.
    assert lexical.best([0, 1, 2], weights, postings, n, 10, 11_300 * each)[0].tolist() == list(range(10))
    assert lexical.best([2], weights, postings, n, 10, 0)[2] == n
