import random

import numpy as np
import pytest
from cases import TEXTS, by_id, features
from parchline.llm import jaccard as J
from parchline.llm.components import components


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets, n = [grams(t) for t in texts], len(texts)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in range(n)}


def copies(seed, groups=8, each=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(each):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_classes_and_links_match_brute_force(spark, block):
    texts = [*TEXTS, *copies(1), "one two three", "One two  THREE", "w " * 200, "w " * 300]
    found = by_id(J.jaccard_links(features(spark, texts), block=block, recall=0.9999))
    assert {i: (r.class_id, r.n_links) for i, r in found.items()} == brute(texts)
    assert all(r.kept == (r.class_id == i) for i, r in found.items())
    sizes = [r.class_id for r in found.values()]
    assert all(r.class_size == sizes.count(r.class_id) for r in found.values())


def test_null_keys_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g"
    rows = J.jaccard_links(features(spark, [text] * 4, keys=[("a", 2), ("a", 2), ("b", 1), (None, None)])).collect()
    assert {(r.class_dataset_key, r.class_id, r.class_size, r.n_links) for r in rows} == {("b", 1, 4, 3)}
    assert J.jaccard_links(features(spark, [])).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = J.bands_for(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall
    with pytest.raises(ValueError):
        J.bands_for(0.05, 0.9999)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)] + [(50, 50), (60, 61), (61, 60)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 120)} | {60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(0, 30)))).astype(np.uint64) for _ in range(12)]
    for own, got in zip(sets, J.shared_counts(sets, sets), strict=True):
        assert got.tolist() == [len(np.intersect1d(own, s)) for s in sets]
