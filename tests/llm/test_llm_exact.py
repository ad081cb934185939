import hashlib

import pytest
from cases import TEXTS, by_id, features
from parchline.llm.exact import PatriciaTrie, exact_duplicates


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(plain(t), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(p.encode()).hexdigest()) for p, g in groups.items() for _, i in g}


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_groups_match_brute_force(spark, held):
    texts = [*TEXTS, *[f"abc{i % 7} d" for i in range(40)], *[" " * (i % 5) + "xyz" for i in range(30)]]
    found = by_id(exact_duplicates(features(spark, texts), held_bytes=held))
    expected = brute(texts)
    assert {i: (r.keep_id, r.group_size, r.text_sha256) for i, r in found.items()} == expected
    assert {i for i, r in found.items() if r.kept} == {k for k, _, _ in expected.values()}


def test_repeated_rows_and_null_keys(spark):
    rows = exact_duplicates(features(spark, ["same", "same", "same", "same"], keys=[("a", 3), ("a", 3), ("a", None), (None, 3)])).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows) == 1
    assert {(r.keep_dataset_key, r.keep_id, r.group_size) for r in rows} == {("a", 3, 4)}


def test_empty_table(spark):
    assert exact_duplicates(features(spark, [])).count() == 0


def test_trie_spills_finished_subtrees():
    words = sorted(f"{i * 7919 % 1000:b}".encode() for i in range(300))
    trie, seen = PatriciaTrie(), {}
    for i, w in enumerate(words):
        trie.insert(w, (w,), 1)
        if i % 20 == 19:
            for best, n in trie.spill(w):
                assert best[0] not in seen
                seen[best[0]] = n
    for best, n in trie.drain():
        assert best[0] not in seen
        seen[best[0]] = n
    assert seen == {w: words.count(w) for w in words}
