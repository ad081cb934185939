import math

import numpy as np
import pytest
from parchline.llm.whitening import Centre, Spectrum, secular_roots, whitened_features, whole_steps

SCHEMA = "feature_id bigint, values array<double>, component int, n int, part int, group int"


def frame(spark, vectors, parts=6):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4) for i, v in enumerate(vectors)], SCHEMA).repartition(parts, "feature_id")


def plain(vectors, components):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return c @ axes[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum(), ((n * x - sums) ** 2).sum(axis=1)


def check(rows, vectors, ids, components):
    white, explained, deviation = plain(vectors, components)
    found = {(r.feature_id, r.component): r for r in rows}
    assert set(found) == {(i, c + 1) for i in ids for c in range(components)}
    mine = np.array([[found[i, c + 1].whitened for c in range(components)] for i in ids])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-9
    for i, d in zip(ids, deviation, strict=True):
        assert int(found[i, 1].deviation) == int(d) and found[i, 1].n == len(ids)
    assert np.allclose([found[ids[0], c + 1].explained for c in range(components)], explained, rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("block_rows, fan", [(1024, 16), (1, 2)])
def test_matches_a_plain_decomposition(spark, block_rows, fan):
    vectors = np.random.default_rng(4).normal(size=(300, 12)) * np.linspace(0.5, 4, 12) + 3
    check(whitened_features(frame(spark, vectors), 8, block_rows=block_rows, fan=fan).collect(), vectors, list(range(300)), 8)


def test_unusable_vectors_ties_and_repeats(spark):
    good = np.random.default_rng(5).normal(size=(40, 3))
    vectors = [*good, *good[:5], None, [], [1.0, None, 2.0], [math.nan, 0, 0], [math.inf, 0, 0], [1.0, 2.0]]
    rows = whitened_features(frame(spark, vectors)).collect()
    check(rows, [*good, *good[:5]], list(range(45)), 3)


def test_dimensions_without_variance_have_no_component(spark):
    vectors = [[i / 8.0, 5.0, i / 8.0] for i in range(20)]
    rows = whitened_features(frame(spark, vectors)).collect()
    assert {r.component for r in rows} == {1} and rows[0].identity_error < 1e-9 and abs(rows[0].explained - 1) < 1e-12
    assert whitened_features(frame(spark, [[1.0, 2.0]] * 3)).count() == 0
    assert whitened_features(frame(spark, [[1.0, 2.0]])).count() == 0
    assert whitened_features(frame(spark, [])).count() == 0
    assert whitened_features(frame(spark, [None, []])).columns == ["feature_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_values_stay_exact(spark):
    rows = whitened_features(frame(spark, [[1e12, 0.0], [2e12, 1.0], [1e300, 0.5], [0.0, 0.25]])).collect()
    steps = whole_steps(np.array([[1e12, 0.0], [2e12, 1.0], [1e300, 0.5], [0.0, 0.25]]), 64, 1_000_000)
    sums = [sum(int(v) for v in column) for column in steps.T]
    wanted = [sum((4 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in steps]
    assert steps[2][0] == 2**63 - 1
    assert {r.feature_id: r.deviation for r in rows} == {i: w if w < 10**38 else None for i, w in enumerate(wanted)}
    assert Centre(4, sums).distances(steps)[0].tolist() == [4 * int(v) - s for v, s in zip(steps[0], sums, strict=True)]


@pytest.mark.parametrize("kind", ["plain", "repeated", "graded", "lattice"])
def test_rank_one_updates(kind):
    random = np.random.default_rng(6)
    rows = random.normal(size=(120, 10))
    if kind == "repeated":
        rows[30:] = rows[0]
    elif kind == "graded":
        rows *= 10.0 ** -np.arange(10)
    elif kind == "lattice":
        rows = random.integers(-1, 2, (120, 10)).astype(float)
        rows[:, 3] = 0
    spectrum, other = Spectrum(10), Spectrum(10)
    for row in rows[:70]:
        spectrum.add(row)
    other.add_rows(rows[70:], 16)
    spectrum.merge(other.values, other.vectors)
    whole = rows.T @ rows
    assert np.abs(spectrum.values - np.linalg.eigvalsh(whole)).max() < 1e-13 * spectrum.values[-1]
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(10)).max() < 1e-12
    assert np.abs(spectrum.vectors * spectrum.values @ spectrum.vectors.T - whole).max() < 1e-12 * spectrum.values[-1]


def test_secular_roots_lie_between_poles():
    d, w = np.array([0.0, 1e-9, 1.0, 5.0]), np.array([1e-3, 2.0, 1e-12, 3.0])
    roots, gaps = secular_roots(d, w)
    assert (roots[:-1] >= d[:-1]).all() and (roots[:-1] <= d[1:]).all() and roots[-1] <= d[-1] + w.sum()
    assert np.abs(1 + (w / gaps).sum(axis=1)).max() < 1e-6
