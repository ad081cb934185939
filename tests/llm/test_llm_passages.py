import re

import pytest
from cases import TEXTS, by_id, features
from parchline.llm.passages import LEAST_SENTENCE, merged, repeated_passages, without_runs

PASSAGE = "Rain fell on the upper basin for most of the month, and the gauges rose. The lower basin stayed dry until its end."
PATTERNS = {"paragraph": r"(?:[^\n]|\n(?!\n))+\n*|\n+", "line": r"[^\n]+\n*|\n+", "sentence": r"[^.!?\n]+[.!?\n]*|[.!?\n]+"}


def brute(texts, levels):
    seen, out = set(), {}
    for i, text in enumerate(texts):
        runs = []
        for level in levels:
            for m in re.finditer(PATTERNS[level], text or ""):
                words = re.split(r"[ \t-\r]+", m[0].strip(" \t\n\r\x0b\x0c"))
                if len(" ".join(words)) < (LEAST_SENTENCE if level == "sentence" else 1):
                    continue
                key = (level, " ".join(words).lower())
                if key in seen:
                    runs.append((m.start(), m.end()))
                seen.add(key)
        out[i] = merged(runs)
    return out


@pytest.mark.parametrize("levels", [("line", "sentence"), ("paragraph",), ("line",)])
def test_runs_match_brute_force(spark, levels):
    texts = [*TEXTS, f"One.\n{PASSAGE}\nTwo.", f"Before it. {PASSAGE} After it.", PASSAGE.upper(), f"{PASSAGE}\n\n{PASSAGE}", "no. no. no.", f"x\n\n\n{PASSAGE}\n\n"]
    found = by_id(repeated_passages(features(spark, texts), levels=levels))
    assert {i: [(r.start, r.end) for r in f.removed] for i, f in found.items()} == brute(texts, levels)
    assert all(found[i].n_chars == len(t or "") for i, t in enumerate(texts))


def test_repeated_rows_keep_one(spark):
    rows = repeated_passages(features(spark, [PASSAGE] * 3, keys=[("a", 1), ("a", 1), (None, None)])).collect()
    assert sorted(len(r.removed) for r in rows) == [0, 1, 1]
    assert [len(r.removed) for r in rows if r.feature_id is None] == [1]


def test_empty_table_and_cutting(spark):
    assert repeated_passages(features(spark, [])).count() == 0
    assert without_runs("abcdef", [(1, 2), (4, 6)]) == "acd"


def test_short_lines_go_and_short_sentences_stay(spark):
    texts = ["All rights reserved.\nOne basin of many", "Two basins of many\nALL  rights reserved.", "日本の雨量計\n三", "日本の雨量計\n四", "One basin of many", "The. A dry spring. The. A dry spring."]
    found = by_id(repeated_passages(features(spark, texts)))
    left = [without_runs(t, [(r.start, r.end) for r in found[i].removed]) for i, t in enumerate(texts)]
    assert left == [texts[0], "Two basins of many\n", texts[2], "四", "", texts[5]]
    bare = by_id(repeated_passages(features(spark, texts), least_sentence=1))
    assert without_runs(texts[5], [(r.start, r.end) for r in bare[5].removed]) == "The. A dry spring."


def test_a_batch_of_long_texts(spark):
    """Units of a batch are kept in flat buffers, part by part."""
    text = "".join(f"Reading {i} of the upper basin was written down in the evening.\n" for i in range(3000))
    rows = by_id(repeated_passages(features(spark, [text + f"End {i}" for i in range(12)])))
    assert rows[0].removed == [] and all([(r.start, r.end) for r in rows[i].removed] == [(0, len(text))] for i in range(1, 12))
    assert all(r.n_units == 6001 for r in rows.values())
