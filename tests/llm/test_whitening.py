"""Whitening: polar factors and components against numpy's own, whole tables against a brute-force version."""

from fractions import Fraction

import numpy as np
import pytest

from jobtally.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, vector int, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2, 0.5) for i, v in rows], SCHEMA)


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.asarray(values, float)) @ q.T


def test_polar_factor_is_orthogonal_and_leaves_a_definite_part():
    for seed, n in ((1, 1), (2, 2), (3, 17), (4, 64)):
        a = np.random.default_rng(seed).normal(size=(n, n)) * 10.0**seed
        u = whitening.polar(a)
        h = u.T @ a
        assert np.abs(u.T @ u - np.eye(n)).max() < 1e-13 * n
        assert np.abs(h - h.T).max() < 1e-12 * np.abs(a).max() * n and np.linalg.eigvalsh((h + h.T) / 2).min() > 0


@pytest.mark.parametrize("values", [
    [3.0], [2.0, 2.0], [5, 4, 3, 2, 1], [1e6, 1e3, 1.0, 1e-3, 1e-6], [4, 4, 4, 1, 1, 0, 0], [0, 0, 0], np.linspace(1, 2, 64),
    [7] * 30 + [1] * 30, np.geomspace(1, 1e8, 40), [1 + 1e-9 * i for i in range(12)], [-3, -1, 0, 2, 5],
])
def test_components_are_eigenvectors(values):
    v = symmetric(values, len(values))
    v = (v + v.T) / 2
    found, vectors = whitening.components(v)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-13 * len(v)
    assert np.abs(v @ vectors - vectors * found).max() <= 1e-13 * size * len(v)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * size * len(v) and (np.diff(found) <= 0).all()


def plain(vectors, most=32):
    """Deviations from Python's own numbers, the rest from numpy's eigenvectors."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - t) ** 2 for a, t in zip(row, s)) for row in x]
    centred = np.array([[float(Fraction(n * a - t, n)) for a, t in zip(row, s)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return deviation, (centred @ vectors) / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def compare(got, vectors, ids):
    deviation, white, explained = plain(vectors)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(table) == len(got) == len(ids) * white.shape[1]
    for k in range(white.shape[1]):
        mine = np.array([table[i, k + 1].whitened for i in ids])
        sign = 1 if mine @ white[:, k] > 0 else -1
        assert np.abs(sign * mine - white[:, k]).max() < 1e-7
        assert {table[i, k + 1].explained for i in ids} == {table[ids[0], k + 1].explained}
        assert abs(table[ids[0], k + 1].explained / explained[k] - 1) < 1e-9
    assert [table[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in got} == {len(ids)} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10


def test_the_whole_table_matches_a_plain_version(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(queries.op12_whitening(spark, sf_dir).collect(), [r.embedding for r in table], [r.vec_id for r in table])


def test_skewed_correlated_vectors(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(300, 6)) * [40, 20, 10, 5, 2, 1]) @ rng.normal(size=(6, 6)) + 1000
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    compare(whitening.whitened(frame(spark, rows)).collect(), [v for _, v in rows], [i for i, _ in rows])


def test_results_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(9)
    rows = frame(spark, [(i, [float(c) for c in rng.normal(size=5)]) for i in range(200)])
    exact = lambda parts: sorted((r.vec_id, r.component, r.deviation, r.whitened, r.explained)
                                 for r in whitening.whitened(rows.repartition(parts)).collect())
    assert exact(1) == exact(7)


def test_rows_that_take_no_part_and_rows_that_repeat(spark):
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 0.0, 1.0]), (93, [float("inf"), 0.0, 1.0]), (94, [])]
    good = [(1, [0.5, 1.0, 2.0]), (2, [1.5, -1.0, 0.0]), (None, [0.1, 0.2, 5.0]), (4, [2.0, 2.0, 2.0]), (4, [2.0, 2.0, 2.0]), (6, [-3.0, 0.0, 1.0])]
    got = whitening.whitened(frame(spark, bad + good)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i or 0, c) for i, _ in good for c in (1, 2, 3))
    assert {r.n for r in got} == {6} and got[0].identity_error < 1e-10
    assert len({r.deviation for r in got if r.vec_id == 4}) == 1


def test_components_without_variance(spark):
    one = whitening.whitened(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [
        (1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    flat = whitening.whitened(frame(spark, [(i, [float(i), 3.0]) for i in range(4)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    assert {r.explained for r in flat} == {0.0, 1.0} and flat[0].identity_error < 1e-12


def test_lengths_are_populations_of_their_own(spark):
    rng = np.random.default_rng(4)
    two, three = rng.normal(size=(9, 2)), rng.normal(size=(7, 3))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate([*two, *three])]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {(r.n, r.vec_id < 9) for r in got} == {(9, True), (7, False)}
    compare([r for r in got if r.n == 9], [v for _, v in rows[:9]], list(range(9)))


def test_empty_tables_and_other_names(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).collect() == []
    named = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 0.0])], "key string, v array<double>")
    got = whitening.whitened(named, "key", "v", most=1).collect()
    assert {(r.key, r.component) for r in got} == {("a", 1), ("b", 1)}


def test_sums_stay_exact_beyond_a_double():
    y = np.array([[94_906_267, -94_906_266], [94_906_265, 3]], np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(2)] for i in range(2)]
    assert whitening._products(y).tolist() == exact
    assert whitening._sum(np.array([[2**62], [2**62], [2**62]])).tolist() == [3 * 2**62]
    fit = whitening.Fit(1000, [1000 * 5, 0], np.zeros(0), np.zeros((2, 0)), np.zeros(0))
    for entry in (7, 2_000_000, 7_000_000_000):
        assert [int(v) for v in whitening.deviations(np.array([[5, entry]]), fit).to_pylist()] == [(1000 * entry) ** 2]
