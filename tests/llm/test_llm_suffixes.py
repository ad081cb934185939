import random
from collections import Counter

import numpy as np
import pytest
from cases import TEXTS, features
from parchline.llm import suffixes as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        mark = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                mark[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(mark[1:] != mark[:-1]).tolist()
        runs = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((len(r), runs, bytes(b for b, m in zip(r, mark[1:], strict=False) if not m)))
    return out


def made(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdé ", "abcdefghijklmnop é"])
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = [word(rng.randint(20, 200)) for _ in range(6)]
    texts = [None, "", "a" * 300, "ab" * 150, "x" * 40]
    for _ in range(50):
        text = word(rng.randint(0, 150))
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(parts)
            text += part[0 if rng.random() < 0.5 else rng.randint(0, len(part)) :] + word(rng.randint(0, 80))
        texts.append(text)
    return [*texts, *texts[5:8], texts[9], texts[9]]


@pytest.mark.parametrize("seed,length,tasks,hot", [(0, 32, 10**5, 10**5), (1, 64, 40, 10**5), (2, 40, 40, 4)])
def test_removed_bytes_match_brute_force(spark, seed, length, tasks, hot):
    texts = made(seed)
    found = {
        r.feature_id: (r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept))
        for r in S.repeated_bytes(features(spark, texts), length=length, task_suffixes=tasks, hot=hot).collect()
    }
    assert found == dict(enumerate(brute(texts, length)))


def test_edge_cases_at_full_length(spark):
    texts = [*TEXTS, "q" * 199, "q" * 199 + "r", "r" + "q" * 200]
    found = {r.feature_id: (r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in S.repeated_bytes(features(spark, texts)).collect()}
    short = [i for i, t in enumerate(texts) if len(t or "") < 5000]
    expected = brute([texts[i] for i in short], S.LENGTH)
    assert {i: found[i] for i in short} == dict(zip(short, expected, strict=True))
    # The long texts repeat within themselves and are equal, so nothing is left.
    assert all(found[i][2] == b"" for i in found if i not in short)
    assert S.repeated_bytes(features(spark, [])).count() == 0


def test_repeated_rows_are_copies(spark):
    rows = S.repeated_bytes(features(spark, ["z" * 10 + "y" * 250, "z" * 10 + "y" * 250], keys=[("a", 1), ("a", 1)])).collect()
    assert [(r.n_bytes, bytes(r.kept)) for r in rows] == [(260, b"")] * 2
    with pytest.raises(ValueError):
        S.repeated_bytes(features(spark, []), length=20)


def test_loser_tree_gives_order_and_prefixes():
    rng = np.random.default_rng(6)
    for runs in (1, 2, 3, 7):
        parts = []
        for _ in range(runs):
            rows = rng.integers(97, 99, (int(rng.integers(1, 30)), 24)).astype(np.uint8)
            rows = rows[np.argsort(rows.view("S24").ravel(), kind="stable")]
            n = np.zeros(len(rows))
            parts.append(S.Run(S.packed_run(rows, n, n, n, np.zeros((len(rows), 16), np.uint8), n)))
        got = list(S.merged_runs(parts))
        rows = np.frombuffer(b"".join(g[3] for g in got), np.uint8).reshape(len(got), 24)
        assert [g[3] for g in got] == sorted(g[3] for g in got)
        assert [g[2] for g in got][1:] == S.common_prefixes(rows).tolist()[1:]
        assert len(got) == sum(len(p.shared) for p in parts)


def test_equal_strings_have_equal_anchors(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 512)
    rng = np.random.default_rng(8)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2400] = data[300:700]
    place, _ = S.anchors(data, np.array([0, 1500, 3000]), 64)
    inside = lambda low, high: set((place[(place >= low) & (place <= high - S.GRAM)] - low).tolist())
    for start in range(0, 336):
        a, b = inside(300 + start, 364 + start), inside(2000 + start, 2064 + start)
        assert a & b
