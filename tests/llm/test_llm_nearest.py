import numpy as np
import pytest
from parchline.llm import nearest as N

SCHEMA = "feature_id bigint, values array<float>, shard int, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q in queries:
            far = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in good if i != q and len(b) == len(a))
            out[q] = [(i, d) for d, i in far[:k]]
    return {q: r for q, r in out.items() if r}


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.feature_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_bad_vectors_take_no_part_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60, None), (61, [0.0] * 4), (62, [1.0, None, 2.0, 3.0]), (63, [1.0, float("nan"), 0, 0]), (64, [float("inf"), 0, 0, 0]), (65, [])]
    rows += [(70 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(25)] + [(100, [1.0, 2.0]), (101, [2.0, 2.0]), (102, [5.0, 5.0])]
    df = table(spark, rows)
    for shard in (1000, 20):
        found = collected(N.nearest_features(df, df.where("feature_id % 10 = 0"), k=5, shard_rows=shard))
        expected = brute(rows, {i for i, _ in rows if i % 10 == 0}, 5)
        assert {q: [i for i, _ in r] for q, r in found.items()} == {q: [i for i, _ in r] for q, r in expected.items()}
        assert all(np.allclose([d for _, d in found[q]], [d for _, d in r], rtol=1e-12) for q, r in expected.items())


def test_empty_table(spark):
    df = table(spark, [])
    assert N.nearest_features(df, df).count() == 0
    one = table(spark, [(1, [1.0, 2.0])])
    assert N.nearest_features(one, one).count() == 0


@pytest.mark.parametrize("clusters", [1, 40])
def test_recall_of_the_graph(clusters):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(clusters, 32)) * 8
    vectors = centres[rng.integers(clusters, size=4000)] + rng.normal(size=(4000, 32))
    shard = N.Shard(list(range(4000)), list(vectors), 10)
    asked = list(range(0, 4000, 40))
    found = {}
    for q, i, _ in shard.nearest(asked, vectors[asked], 10, N.BEAM):
        found.setdefault(q, set()).add(i)
    hits = 0
    for q in asked:
        far = ((vectors - vectors[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(found[q] & set(np.argsort(far)[:10].tolist()))
    assert hits >= 0.95 * 10 * len(asked)
