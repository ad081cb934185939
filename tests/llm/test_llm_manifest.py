import hashlib
import string

import pytest
from cases import TEXTS, features
from parchline.llm import manifest as M
from pyspark.sql import functions as F


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def entry(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbed(nodes):
    """The last node, and per first node the siblings on the way: (left, right) by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for own, place in enumerate(at):
            run, own_place = runs[place // 16], place % 16
            ways[own].append(("".join(run[:own_place]), "".join(run[own_place + 1 :])))
        nodes, at = [digest("".join(run)) for run in runs], [place // 16 for place in at]
    return nodes[0] if nodes else None, ways


def brute(rows):
    """rows: (layer, id, language, text, text as received or the same)."""
    head = lambda r: entry(r[1]) + entry(r[0]) + entry(r[2])
    made = [(r[0], r[1], digest(head(r) + entry(r[3])), digest(head(r) + entry(r[4]))) for r in rows]
    order = lambda key: (key is not None, (key or "").encode() if not isinstance(key, int) else key)
    layers = sorted({m[0] for m in made}, key=order)
    trees = {}
    for layer in layers:
        own = sorted((m for m in made if m[0] == layer), key=lambda m: ((m[1] is not None, m[1] or 0), m[2]))
        trees[layer] = (own, *climbed([m[2] for m in own]))
    root, tops = climbed([trees[layer][1] for layer in layers])
    out = []
    for layer, top in zip(layers, tops, strict=True):
        own, subroot, ways = trees[layer]
        for (_, fid, leaf, received), way in zip(own, ways, strict=True):
            node = received
            for left, right in [*way, *top]:
                node = digest(left + node + right)
            out.append((layer, fid, leaf, subroot, root, digest("".join(a + b for a, b in [*way, *top])), node, node == root))
    return sorted(out, key=repr)


COLUMNS = ("dataset_key", "feature_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def made_rows(sizes):
    out = []
    for layer, size in sizes.items():
        for i in range(size):
            text = TEXTS[i % len(TEXTS)] if i % 3 else f"Basin {i}"
            out.append((layer, i, "en" if i % 2 else None, text))
    return out


def run(spark, rows, low):
    schema = "dataset_key string, feature_id bigint, props map<string,string>, place int, size int, layer string, block int, hash string, kids string"
    df = spark.createDataFrame([(r[0], r[1], {"description": r[3], "language": r[2]}, 1, 2, "x", 3, "y", "z") for r in rows], schema).repartition(5)
    changed = F.map_concat(F.map_filter("props", lambda k, v: k != "description"), F.create_map(F.lit("description"), F.translate(F.col("props")["description"], string.ascii_uppercase, string.ascii_lowercase)))
    found = M.feature_manifest(df, F.when(F.col("feature_id") % 5 == 0, changed) if low else None)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 3])
def test_matches_a_tree_built_by_hand(spark, monkeypatch, levels):
    """With one level to a block, a layer of 300 leaves takes three tiers."""
    monkeypatch.setattr(M, "BLOCK_LEVELS", levels)
    rows = made_rows({None: 3, "a": 1, "b": 16, "c": 17, "B": 300, "é": 2, **{f"l{i}": 1 for i in range(14)}})
    rows += [("a", None, None, None), ("c", 3, None, "Basin 3"), ("c", 3, None, "Basin 3"), ("c", 3, "en", "Basin 3")]
    lowered = [(*r, r[3].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) if r[3] and r[1] is not None and r[1] % 5 == 0 else r[3]) for r in rows]
    assert run(spark, rows, True) == brute(lowered)


def test_unchanged_features_verify(spark):
    rows = made_rows({"a": 40, "b": 1})
    found = run(spark, rows, False)
    assert found == brute([(*r, r[3]) for r in rows]) and all(r[-1] for r in found)


def test_one_leaf_and_none(spark):
    assert run(spark, [("a", 1, None, "x")], False) == brute([("a", 1, None, "x", "x")])
    assert run(spark, [], False) == []
    null_map = M.feature_manifest(features(spark, [None])).collect()
    assert null_map[0].verified and null_map[0].proof == [] and null_map[0].leaf == digest("1:0" + entry("layer0") + "--")


def test_equal_rows_spread_over_tasks(spark):
    """Repeated rows are told apart by the task that read them, so one of them cannot fill a task."""
    rows = [("a", 7, None, "same")] * 400
    found = run(spark, rows, False)
    assert len(found) == 400 and found == brute([(*r, r[3]) for r in rows])
