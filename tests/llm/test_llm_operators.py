"""Every operator against brute force, an exact round trip or held-out labels, and on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtally.llm import chunks, fuzzy, language, mixing, near, neighbours, pieces, preference, quality, queries, sql, toxicity
from jobtally.llm.components import components

VOCABULARY = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score double, doc string, v long"
BASE = " ".join(f"word{i} thing{i * 7 % 31}" for i in range(60))
AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", None), (4, "one two", "en", "a"), (5, "one two", "en", "b"),
    (6, BASE, "en", "a"), (7, BASE, "en", "a"), (8, BASE + " end", "en", "b"), (9, "x" * 50_000, "de", "b"),
    (10, "wort " * 5_000, "de", None), (None, "no id here", "en", "a"), (11, "▁ mark \x00 日本語 😀\n", "en", "c"), (6, BASE, "en", "a"),
    (12, "!!! 123 ###", "de", "c"),
]


def awkward(spark, rows=AWKWARD):
    full = [(i, t, lang, s, len(t or ""), 1, "k", 0.5, "d", 9) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_matches_sql(spark, sf_dir, oracle, name):
    got = sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).collect()), key=repr)
    assert got == sorted(oracle.execute(sql.ORACLES[name]).fetchall(), key=repr)


def shingle_sets(rows, k):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(words[j:j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    return out


def linked(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: root(i) for i in sets}


def test_near_duplicates_match_brute_force(spark, sf_dir, docs):
    sets = shingle_sets(docs.select("doc_id", "text").collect(), 4)
    expected = linked(sets, 80)
    got = queries.op8_near_duplicates(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(s), expected[i], expected[i] == i) for i, s in sets.items()}


def test_near_duplicates_reach_over_chains_that_no_hub_links(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(30):  # each is close to its neighbours alone
        rows.append((i, " ".join(words), "en", "a"))
        at = rng.randrange(150)
        words = words[:at] + [f"n{i}-{j}" for j in range(8)] + words[at + 8:]
    sets = shingle_sets([(i, t) for i, t, *_ in rows], 4)
    got = {r.doc_id: r.component_id for r in near.near_duplicates(awkward(spark, rows), words=4).collect()}
    assert got == linked(sets, 80)


def test_near_duplicates_of_awkward_rows(spark):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near.near_duplicates(awkward(spark), words=5).collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True)
    assert got[4, 1] == (4, True) and got[5, 1] == (4, False)
    assert [got[i, n][0] for i, n in got if i in (6, 7, 8)] == [6, 6, 6]
    assert got[None, 1] == (None, True)
    assert near.near_duplicates(awkward(spark, []), words=5).count() == 0


def test_sketch_estimates_the_jaccard_index():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[500:])
    levels = near.registers(np.repeat([0, 1], 1000), np.concatenate([a, b]), 2)
    assert abs((levels[0] == levels[1]).mean() - 1 / 3) < 0.12
    merged = near.registers(np.zeros(1500, np.int64), np.sort(pool), 1)[0]
    assert (np.maximum(levels[0], levels[1]) == merged).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 21), (21, 20)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_shared_passages_go_from_all_but_the_first(spark):
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    passage = make(60)
    rows = [(i, f"{make(80)} {passage} {make(80)}" if i % 2 else make(150), "en", "a") for i in range(20)]
    got = {r.doc_id: r for r in chunks.deduplicated(awkward(spark, rows)).collect()}
    middle = " ".join(passage.split()[15:45])
    for i, text, *_ in rows:
        whole = i % 2 == 0 or i == 1
        assert (got[i].text == text) == whole
        assert (middle in got[i].text) == (i == 1)
        if not whole:
            assert got[i].first == 1 and got[i].removed > len(passage) * 0.6
            assert set(got[i].text.split()) <= set(text.split())


@pytest.mark.parametrize("letters", [(1, 1), (2, 3), (2, 9)])
def test_passages_of_51_words_go_whole(spark, letters):
    rng = random.Random(6)
    make = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(*letters))) for _ in range(n))
    rows, expected = [], {}
    for k in range(60):
        passage = make(51)
        ends = [f"{make(40)} {word}{k}" for word in ("north", "south")]
        starts = [f"{word}{k} {make(40)}" for word in ("east", "west")]
        rows += [(2 * k, f"{ends[0]} {passage} {starts[0]}", "en", "a"), (2 * k + 1, f"{ends[1]} {passage} {starts[1]}", "en", "a")]
        expected |= {2 * k: rows[-2][1].split(), 2 * k + 1: ends[1].split() + starts[1].split()}
    got = {r.doc_id: r.text.split() for r in chunks.deduplicated(awkward(spark, rows)).collect()}
    assert got == expected


def test_texts_under_one_id_are_cut_by_their_own_spans(spark):
    rng = random.Random(7)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, long, short = make(60), make(300), make(20)
    rows = [(1, passage, "en", "a"), (2, f"{long} {passage}", "en", "a"), (2, short, "en", "a")]
    got = sorted((r.doc_id, r.text.strip()) for r in chunks.deduplicated(awkward(spark, rows)).collect())
    assert got == sorted([(1, passage), (2, long), (2, short)])


def test_chunks_of_awkward_rows(spark):
    rows = awkward(spark)
    got = chunks.deduplicated(rows).collect()
    assert len(got) == len(AWKWARD)
    assert {(r.doc_id, r.text) for r in got if r.doc_id in (1, 2, 3, 4, 5, 6, 9, 10, None)} == {
        (i, t) for i, t, *_ in AWKWARD if i in (1, 2, 3, 4, 5, 6, 9, 10, None)}
    assert all(len(r.text) < 40 for r in got if r.doc_id == 7)
    assert chunks.deduplicated(awkward(spark, [])).count() == 0


def plain_repeats(rows, words=50):
    """Byte spans that repeat `words` whole words of an earlier text, by every window of so many words."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        windows = [(at[k][0], at[k + words - 1][1]) for k in range(len(at) - words + 1)]
        out[i] = chunks._joined([(s, e) for s, e in windows if seen.get(data[s:e], i) < i])
        for s, e in windows:
            seen.setdefault(data[s:e], i)
    return out


def test_repeats_of_a_whole_table_match_brute_force(spark, sf_dir, docs):
    expected = plain_repeats(docs.select("doc_id", "text").collect())
    got = {r.doc_id: [tuple(s) for s in r.spans or ()] for r in queries.op4_substring_dedup(spark, sf_dir).collect()}
    assert got == expected and sum(map(bool, expected.values())) > 10


def test_runs_of_a_batch_match_those_of_each_text():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(rng.choice([0, 1, 5, 60, 200]))).encode() for _ in range(300)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, end, _ = chunks._anchors(data, bounds, 50)
    for share in (0.1, 0.5, 0.9, 1.0):
        hit = np.array([rng.random() < share for _ in start])
        keep = chunks._in_long_runs(data, bounds, start, end, hit, 50)
        row = np.searchsorted(bounds, start, side="right") - 1
        for k, text in enumerate(texts):
            mine = (row == k) & hit
            if mine.any():
                assert keep[mine].tolist() == chunks._promising(text, start[mine] - bounds[k], (end - start)[mine], 50).tolist()
        assert not keep[~hit].any()


def test_marks_never_lose_a_member(spark):
    from jobtally.llm.work import Marks, marked
    rng = np.random.default_rng(2)
    inside, outside = rng.integers(-2**63, 2**63, 5000), rng.integers(-2**63, 2**63, 5000)
    marks = Marks.of(spark.createDataFrame([(int(v),) for v in inside] + [(None,)], "k long").repartition(4))
    assert marks.hold(inside).all() and marks.hold(outside).mean() < 0.1
    rows = spark.createDataFrame([(int(inside[0]),), (None,)], "k long")
    assert [r[0] for r in rows.select(marked("k", marks.sent(spark))).collect()] == [True, False]
    assert not Marks.of(rows.limit(0)).hold(outside).any()


def test_cuts_resist_an_insertion():
    text = (" ".join(f"token{i * 37 % 101}" for i in range(400))).encode()
    cut = lambda t: {t[s:e] for s, e in zip(*chunks.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)])))}
    assert len(cut(text) - cut(text[:1000] + b"inserted" + text[1000:])) <= 4


def best_score(word, vocabulary):
    score = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in vocabulary.pieces:
                score[end] = max(score[end], score[start] + vocabulary.pieces[word[start:end]][1])
        if word[end - 1] not in vocabulary.pieces:
            score[end] = max(score[end], score[end - 1] + vocabulary.unknown)
    return score[-1]


def test_pieces_have_the_best_score_and_come_back(spark, docs):
    vocabulary = pieces.load(VOCABULARY)
    words = sorted({w for r in docs.limit(20).collect() for w in pieces.marked_words(r.text)})[:800]
    cut = pieces.segment(words, vocabulary, pieces.trie(vocabulary.pieces))
    by_id = {i: s for i, s in vocabulary.pieces.values()}
    for w in words:
        if all(i in by_id for i in cut[w]):
            assert sum(by_id[i] for i in cut[w]) == pytest.approx(best_score(w, vocabulary))
    both = docs.select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    ids = pieces.encoded("text", vocabulary)
    back = both.select("text", ids.alias("ids")).select("text", "ids", pieces.decoded("ids", vocabulary).alias("back"))
    assert back.filter(~F.col("text").eqNullSafe(F.col("back"))).count() == 0
    assert back.filter("text IS NULL AND ids IS NOT NULL").count() == 0
    once = both.select("text", ids.alias("ids"), pieces.coded("text", vocabulary).alias("c"))
    assert once.filter(~(F.col("c.ids").eqNullSafe(F.col("ids")) & F.col("c.back").eqNullSafe(F.col("text")))).count() == 0


def test_language_sums_all_segmentations():
    found = language.load_pieces(VOCABULARY)
    names, rng = ["the", "there", "on", "zz"], np.random.default_rng(0)
    chance = rng.random((found.count + 1, 2)) / found.count
    codes, bounds = language.A.code_points(names)
    hashed = {int(k): int(r) for n in found.keys for k, r in zip(found.keys[n], found.rows[n])}

    def brute(word):
        sums = [np.ones(2)] + [np.zeros(2) for _ in word]
        for end in range(1, len(word) + 1):
            for start in range(end):
                part, limits = language.A.code_points([word[start:end]])
                row = hashed.get(int(language.A.Hashes(part).of(limits[:1], limits[1:])[0]))
                if row is None and end - start == 1:
                    row = found.count
                if row is not None:
                    sums[end] = sums[end] + sums[start] * chance[row]
        return sums[-1]

    for part, rows in language._matrices(codes, bounds[:-1], bounds[1:]):
        alpha, _ = language.Lattice(rows, found).forward(chance, len(part))
        for k, i in enumerate(part):
            assert np.allclose(alpha[-1][k], brute("▁" + names[i]))


def test_language_learns_from_long_runs(spark):
    rng = random.Random(8)
    make = lambda letters: "".join(rng.choices(letters, k=30))
    rows = [(i, " ".join(make("abcdefgh" if i % 2 else "stuvwxyz") for _ in range(6)), "aa" if i % 2 else "zz", "a") for i in range(60)]
    texts = awkward(spark, rows)
    model = language.fit(texts.filter("doc_id < 40").select(F.col("doc_id").alias("id"), "text", "lang"), VOCABULARY)
    found = texts.filter("doc_id >= 40").select("lang", language.identify("text", model).alias("f")).collect()
    assert all(r.f.lang == r.lang and r.f.score > 0.99 for r in found)


def test_expected_uses_of_long_words_are_exact():
    found = language.load_pieces(VOCABULARY)
    codes, bounds = language.A.code_points(["theretherethereonthereonthere" * 2])
    chance = np.random.default_rng(2).random((found.count + 1, 2)) / found.count
    (part, rows), = language._matrices(codes, bounds[:-1], bounds[1:])
    lattice = language.Lattice(rows, found)
    uses = lattice.expected(chance, np.ones((1, 2)))
    size = np.ones(found.count + 1)
    for n, at in found.rows.items():
        size[at] = n
    assert np.allclose(size @ uses, rows.shape[1])


def test_language_on_held_out_texts(spark, sf_dir, docs):
    got = queries.op1_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    model = language.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"), VOCABULARY)
    odd = awkward(spark).select("doc_id", language.identify("text", model).alias("f")).select("doc_id", "f.*").collect()
    assert {r.doc_id for r in odd if r.lang == "und" and r.score == 0} == {1, 2, 3, 12}
    none = language.fit(docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("lang")), VOCABULARY)
    assert {r.lang for r in docs.limit(3).select(language.identify("text", none)["lang"].alias("lang")).collect()} == {"und"}


@pytest.mark.parametrize("name, label, bound", [("op2_quality", "quality", 0.8), ("op5_toxicity", "toxic", 0.7)])
def test_classifiers_on_held_out_labels(spark, name, label, bound):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    rows = got.select(label, "score", "predicted").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r[label] == r.predicted for r in rows]) > 0.95
    positive = [r.score for r in rows if r[label] == 1]
    negative = [r.score for r in rows if r[label] == 0]
    assert np.mean([p > n for p in positive[:300] for n in negative[:300]]) > bound


def test_classifiers_take_awkward_rows_and_no_labels(spark):
    texts = awkward(spark)
    ids = texts.select(F.col("doc_id").alias("id"), "text")
    nothing = spark.createDataFrame([], "id long, label int")
    model = quality.fit(ids, nothing)
    assert {r.s for r in texts.select(quality.score("text", model).alias("s")).collect()} == {0.5}
    few = quality.fit(ids, spark.createDataFrame([(4, 1), (9, 0), (1, 0), (6, 1)], "id long, label int"))
    assert all(0 <= r.s <= 1 for r in texts.select(quality.score("text", few).alias("s")).collect())
    none = toxicity.fit(ids, nothing.select("id"), 0.1)
    assert {r.s for r in texts.select(toxicity.score("text", none).alias("s")).collect()} == {0.0}


def test_attention_weighs_passages():
    rng = np.random.default_rng(1)
    row = np.repeat(np.arange(200), 4)
    x = rng.normal(size=(800, 6))
    label = (np.arange(200) % 2).astype(float)
    x[np.arange(200) * 4 + rng.integers(0, 4, 200), 0] += 6 * label  # one passage in four tells
    model = quality.train(row, x, label)
    first = np.arange(200) * 4
    p = quality._forward(np.clip((x - model.mean) / model.scale, -8, 8), first, row, model.parts)["p"]
    assert ((p > 0.5) == (label == 1)).mean() > 0.95


def test_nonnegative_risk_finds_what_positives_share():
    rng = np.random.default_rng(2)
    toxic = rng.random(600) < 0.2
    lists = [sorted({int(rng.integers(5, 40)) for _ in range(8)} | ({int(rng.integers(0, 5))} if t else set())) for t in toxic]
    known = toxic & (rng.random(600) < 0.5)
    sizes = np.array([len(x) for x in lists])
    found = toxicity.train(np.concatenate(lists), sizes, known, np.ones(600, bool), np.arange(40, dtype=np.uint64), 0.2, 200)
    assert found.weights[:5].mean() > found.weights[5:].mean() + 2


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice("aabbbc") if i % 9 else None) for i in range(600)]
    docs = awkward(spark, rows)
    mixed, report = mixing.mix(docs, F.array("source"))
    taken = defaultdict(int)
    source = {i: s for i, _, _, s in rows}
    for r in mixed.collect():
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    targets = {r.source: (r.target, r.source_size) for r in report.collect()}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * sum(s for _, s in targets.values()))
    for s, (target, size) in targets.items():
        assert target <= 2 * size and abs(taken[s] - target) <= 30
    assert sorted(mixed.collect()) == sorted(mixing.mix(docs.repartition(7), F.array("source"))[0].collect())


def test_flow_repeats_as_little_as_possible():
    sizes, members = {"x": 10, "y": 10, "xy": 10}, {"x": ["x"], "y": ["y"], "xy": ["x", "y"]}
    flow = mixing.min_cost_flow(sizes, members, {"x": 20, "y": 5}, 2)
    assert sum(v for (_, s), v in flow.items() if s == "x") == 20 and flow["xy", "x"] == 10
    assert mixing.shared_by_weight([10, 100, 100], [3, 1, 1], 1.0, 2) == [20, 95, 95]


def test_mix_of_awkward_rows(spark):
    mixed, _ = mixing.mix(awkward(spark), F.array("source"))
    assert mixed.count() == len(AWKWARD) and mixed.filter("size = 0 AND taken > 0").count() == 0
    assert mixing.mix(awkward(spark, []), F.array("source"))[0].count() == 0


def test_preference_of_awkward_conversations(spark):
    turns = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "q"), ("assistant", "a<|end|>")], [("user", "q"), ("assistant", None)], "x"), (2, None, [], "x"),
            (3, [("user", "q")], [("user", "q"), ("assistant", "b")], "x"), (4, [("user", None)], [("user", "")], "x")]
    got = {r.id: r for r in preference.formatted(
        spark.createDataFrame(rows, f"id int, chosen {turns}, rejected {turns}, prompt_ string")).collect()}
    assert got[1].n_common == 1 and got[1].prompt == "<|user|>\nq<|end|>\n" and "a<|end|>" not in got[1].chosen_text
    assert got[1].chosen_text[slice(*got[1].chosen_spans[0])].endswith("|end|>\n")
    assert got[2].n_common == 0 and got[2].prompt == got[2].chosen_text == ""
    assert got[3].chosen_text == "" and got[3].chosen_spans == [] and len(got[3].rejected_spans) == 1
    assert got[4].n_common == 0


def test_nearest_reaches_recall_and_is_exact_on_small_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.stack(table.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in queries.op7_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = [len(set(got[i]) & set(table.vec_id[np.argsort(-np.where(table.vec_id == i, -9, x @ x[k]))[:5]])) / 5
            for k, i in enumerate(table.vec_id) if i % 50 == 0]
    assert np.mean(hits) >= 0.9
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [float("nan"), 1.0], 1),
            (7, [1.0, None], 1), (8, [0.0, 1.0], 1), (None, [1.0, 1.0], 1), (3, [1.0, 0.0], 1), (9, [1.0, 1.0, 1.0], 1), (10, [], 1)]
    small = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = neighbours.nearest(small, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found] == [
        (0, 1, 3, 1.0), (0, 2, 50, 1.0), (0, 3, 8, 0.0), (50, 1, 0, 1.0), (50, 2, 3, 1.0), (50, 3, 8, 0.0)]
    assert neighbours.nearest(small.limit(0), F.lit(True)).count() == 0


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not row else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_likeness_matches_edit_distance():
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdef", k=n))
    a = [make(rng.randrange(65)) for _ in range(150)] + ["", "abc", "abc"]
    b = [x[:25] + make(rng.randrange(40)) for x in a[:150]] + ["", "abc", "abd"]
    for x, y, got in zip(a, b, fuzzy.signature_likeness(a, b)):
        run = any(x[i:i + 4] in y for i in range(len(x) - 3))
        assert got == pytest.approx(1.0 if x == y else 2 * common_subsequence(x, y) / (len(x) + len(y)) if run else 0.0)


@pytest.mark.parametrize("tasks_", ["1", "8"])
def test_fingerprints_of_awkward_rows(spark, tasks_):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks_)
    try:
        rows = [(i, f"{'text ' * (i % 7)}{i}", "en", "a") for i in range(20, 3000)] + AWKWARD
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in fuzzy.fingerprinted(awkward(spark, rows)).collect())
        order = sorted(((i if i is not None else -1, t or "") for i, t, *_ in rows), key=lambda r: (-r[0], r[1]))
        expected = []
        for k, (i, text) in enumerate(order):
            changed = fuzzy.edited(text, order[(k + 1) % len(order)][1])
            expected.append((i, len(text), fuzzy.hashlib.sha256(changed.encode()).hexdigest()))
        assert got == sorted(expected)
        assert fuzzy.fingerprinted(awkward(spark, [])).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_id_in_most_rows_is_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "LEAST_ROWS", 10)
    texts = [f"{k * 7919 % 400:03d} words of one text {k % 9}" for k in range(300)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts)] + [(7, "000 same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fuzzy.fingerprinted(docs)
    sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(rows) / 3
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = [(i, fuzzy.hashlib.sha256(fuzzy.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest())
                for k, (i, t) in enumerate(order)]
    got = [(r.doc_id, r.edited_sha256) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_equal_texts_have_equal_fingerprints():
    text = BASE.encode()
    first, second, third = fuzzy.fingerprints([text, b"other text in between", text])[::2] + fuzzy.fingerprints([text])
    assert first == second == third
    assert fuzzy.likeness([first], [fuzzy.fingerprints([text + b" and a little more"])[0]])[0] > 0.8
