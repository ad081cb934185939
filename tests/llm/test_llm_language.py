import numpy as np
from cases import TEXTS, by_id, features
from parchline.llm import language as L

ENGLISH = "the river and the rain of that station with this month was higher than the other one"
SPANISH = "el río y la lluvia de esta estación con este mes fue más alta que la otra del año"


def table(spark, n=60):
    rng = np.random.default_rng(3)
    make = lambda s: " ".join(rng.choice(s.split(), 12))
    texts = [make(ENGLISH if i % 2 else SPANISH) for i in range(n)]
    return features(spark, texts, ["en" if i % 2 else "es" for i in range(n)])


def test_learned_languages_are_told_apart(spark):
    df = table(spark)
    filters = L.learn_languages(df.where("feature_id % 4 <> 2"))
    assert filters.languages == ("en", "es")
    held = by_id(L.predict_languages(df.where("feature_id % 4 = 2"), filters))
    assert held and all(r.found == "es" and 0.8 < r.score <= 1 for r in held.values())


def test_texts_without_letters(spark):
    filters = L.learn_languages(table(spark))
    found = by_id(L.predict_languages(features(spark, TEXTS), filters))
    assert len(found) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        lettered = any(c.isalpha() for c in t or "")
        assert (found[i].found in ("en", "es")) == lettered and (found[i].found == "und") == (not lettered)
        assert 0 <= found[i].score <= 1


def test_nothing_learned_and_empty_table(spark):
    filters = L.learn_languages(features(spark, TEXTS))
    assert {r.found for r in L.predict_languages(features(spark, TEXTS), filters).collect()} == {"und"}
    assert L.predict_languages(features(spark, []), filters).count() == 0


def test_long_texts_are_cut_without_changing_trigrams(monkeypatch):
    text = "Los años 1990 y el río\0abajo " * 9
    whole = sorted(np.concatenate([L.trigrams(p)[0] for _, p in L.pieces([text])]).tolist())
    monkeypatch.setattr(L, "PIECE", 10)
    assert sorted(np.concatenate([L.trigrams(p)[0] for _, p in L.pieces([text])]).tolist()) == whole
    padded = "".join(c.lower() if c.isalpha() else " " for c in f" {text} ")
    assert len(whole) == sum(padded[i + 1] != " " for i in range(len(padded) - 2))
