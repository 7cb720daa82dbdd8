"""The pipeline's stages against plain versions, on awkward rows, and with columns of any name."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from jobtally.llm import arrays as A, chunks, mixing, near, queries, stages, toxicity

CLASHES = ("__score", "__times", "__turn", "__coded", "removed", "spans", "first", "digest", "kept", "size", "key", "d", "own", "n", "times",
           "component_id", "pattern", "doc", "hash", "new", "at", "rows", "col", "score")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)


def table(spark, rows):
    """(id, text, source) rows as documents with many more columns."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(CLASHES))) for i, t, s in rows], SCHEMA)


def words_of(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def held(docs):
    """Rows by what no stage but the cut may change, and a check that all other columns came through."""
    out = docs.collect()
    assert all(tuple(r[c] for c in CLASHES) == tuple(range(len(CLASHES))) for r in out)
    return Counter((r.doc_id, r.text, r.source) for r in out)


@pytest.fixture(scope="module")
def rows():
    """A third without an id, a third under one id with texts of their own, copies, near copies, and shared passages."""
    rng = random.Random(1)
    passage, base = words_of(rng, 60), words_of(rng, 120)
    out = [(None, words_of(rng, 30), "b") for _ in range(40)] + [(5, words_of(rng, 30), "a") for _ in range(40)]
    out += [(100 + i, f"{words_of(rng, 40)} {passage} {words_of(rng, 40)}", "c") for i in range(6)]
    out += [(200 + i, base + f" end{i}", "a") for i in range(4)] + [(300, base, None), (300, "one two", None), (301, "one two", "a")]
    out += [(400, None, "a"), (401, "", "b"), (402, " \n\t", None), (403, "x" * 30_000, "c"), (300, base, None)]
    return out


def test_copies_go_and_all_else_stays(spark, rows):
    got = held(stages.drop_near_copies(spark, table(spark, rows), ""))
    sets = []
    for i, text, _ in rows:
        words = (text or "").split()
        sets.append({tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set())
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    least = defaultdict(lambda: 10**9)
    for k, (i, _, _) in enumerate(rows):
        least[part[k]] = min(least[part[k]], i if i is not None else 10**9)
    expected = Counter()
    for k, (i, text, s) in enumerate(rows):
        if i is None or i == least[part[k]] or not sets[k]:
            expected[i, text, s] = expected[i, text, s] + 1 if i is None else 1
    assert got == expected


def test_a_clean_text_under_the_id_of_a_copy_stays(spark):
    rng = random.Random(2)
    a, b = words_of(rng, 50), words_of(rng, 50)
    got = held(stages.drop_near_copies(spark, table(spark, [(1, a, "s"), (2, a, "s"), (2, b, "s")]), ""))
    assert got == {(1, a, "s"): 1, (2, b, "s"): 1}


def test_texts_under_one_id_keep_their_own_links(spark):
    """Two texts of equal size under id 1, each near another document: both links are found."""
    rng = random.Random(3)
    a, b = words_of(rng, 60), words_of(rng, 60)
    got = near.near_duplicates(table(spark, [(1, a, "s"), (1, b, "s"), (7, a + " x", "s"), (9, b + " y", "s"), (3, words_of(rng, 60), "s")]))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (1, 1), (3, 3), (7, 1), (9, 1)]


def test_passages_are_cut_as_by_the_plain_rule(spark, rows):
    docs = [r for r in rows if r[0] is not None and r[0] != 300]
    docs = [(1000 + k if i == 5 else i, t, s) for k, (i, t, s) in enumerate(docs)]
    got = {r.doc_id: (r.text, r.n_chars) for r in stages.cut_repeats(spark, table(spark, docs), "").collect()}
    seen = {}
    for i, text, _ in sorted(docs, key=lambda r: r[0]):
        data = (text or "").encode()
        at = [m.span() for m in re.finditer(rb"\S+", data)]
        windows = [(at[k][0], at[k + 49][1]) for k in range(len(at) - 49)]
        spans = chunks._joined([w for w in windows if seen.get(data[w[0]:w[1]], i) < i])
        for w in windows:
            seen.setdefault(data[w[0]:w[1]], i)
        left, to = b"", 0
        for s, e in spans:
            left, to = left + data[to:s], e
        left = (left + data[to:]).decode()
        assert got[i] == ((None, 0) if text is None else (left, len(left)))
    assert sum(t != (got[i][0] or "") for i, t, _ in docs if t) >= 5 + 3
    held(stages.cut_repeats(spark, table(spark, rows), ""))


def test_the_mix_reaches_its_targets_with_ids_that_repeat_or_lack(spark):
    rng = random.Random(4)
    docs = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, words_of(rng, rng.randrange(1, 40)), rng.choice("aabbbc")) for i in range(600)]
    docs += docs[:3]
    mixed, report = mixing.mix(table(spark, docs), F.array("source"))
    targets = {r.source: r.target for r in report.collect()}
    for made in (mixed.withColumn("source", F.get_json_object("pattern", "$.in[0]")).groupBy("source").agg(F.sum("taken").alias("n")),
                 stages.mix_sources(spark, table(spark, docs), "").groupBy("source").agg(F.sum(mixing.words("text")).alias("n"))):
        sums = {r.source: r.n for r in made.collect()}
        assert all(abs(sums[s] - targets[s]) <= 40 for s in targets), (sums, targets)
    got = held(stages.mix_sources(spark, table(spark, docs), ""))
    most = Counter(docs)
    assert all(n <= 2 * most[r] for r, n in got.items())
    assert got == held(stages.mix_sources(spark, table(spark, docs).repartition(7), ""))


def test_toxic_documents_go_by_the_plain_score(spark, sf_dir):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id for r in stages.drop_toxic(spark, docs, folder).select("doc_id").collect()}
    detector = queries.fitted_toxicity(docs, labels, F.lit(True))
    place = {int(k): i for i, k in enumerate(detector.keys)}

    def hashed(text):
        codes, bounds = A.code_points([text])
        return int(A.Hashes(codes).of(bounds[:1], bounds[1:])[0])

    expected = set()
    for r in docs.collect():
        found = set()
        for word in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            keys = [hashed(word)] + [(hashed(word[:n]) + n) % 2**64 for n in toxicity.BEGINNINGS if len(word) >= n]
            found |= {place[k] for k in keys if k in place}
        logits = detector.offsets + sum((detector.weights[i] for i in found), np.zeros(toxicity.MODELS))
        if np.mean(1 / (1 + np.exp(-logits))) < stages.TOXIC:
            expected.add(r.doc_id)
    assert got == expected and 0 < len(expected) < docs.count()


def test_pieces_come_back_and_are_no_more_than_the_models_own(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    got = stages.encode(spark, docs, sf_dir).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = sum(len(model.encode(texts[r.doc_id] or "")) for r in got)
    assert sum(r.n_pieces for r in got) <= 1.02 * own


def test_every_stage_takes_awkward_and_empty_tables(spark, rows, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, table(spark, rows), sf_dir)
        assert stage(spark, table(spark, []), sf_dir).count() == 0
        if name != "sentencepiece":
            assert made.columns == table(spark, []).columns
            held(made)
        else:
            assert made.count() == len(rows) and made.filter("NOT round_trip").count() == 0


def test_the_whole_pipeline_is_its_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    got = corpus_pipeline.run(spark, sf_dir)
    shown = lambda df: Counter((r.doc_id, r.source, r.lang, tuple(r.ids), r.n_pieces, r.round_trip) for r in df.collect())
    assert shown(got) == shown(docs) and got.filter("NOT round_trip").count() == 0
