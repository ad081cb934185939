import re

import numpy as np
import pytest
from cases import LONG, TEXTS, by_id, features
from parchline.llm.credentials import BASE_KINDS, FORMS, KINDS, LEAST_LENGTH, RANDOM, SecretModels, base_spans, excursions, find_secrets, learn_secrets, made_identifiers, made_secrets

PLAIN = ["The station's readings of the upper basin were brought to months before the index was made, and the layer spi3 was written.", *[t for t in TEXTS if t]]
SECRET = "x8Kq2ZpL9vTn4RbYw7CmJd3FsHg6Ae1U"


def brute(text):
    """The fixed patterns as they are stated, matched first and filtered after."""
    rules = {
        "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    found = [(m.start(), m.end(), k) for k, (pattern, good) in rules.items() for m in re.finditer(pattern, text) if good(m)]
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


@pytest.fixture(scope="module")
def models(spark):
    return learn_secrets(features(spark, PLAIN))


def test_base_spans_match_the_patterns():
    texts = [
        'Token = "abcdef"', "token=token:abcdefgh", "PASSWORD:'x'", "api_key  :  abcdefg APIKEY=1234567", "AKIA" * 6, "AKIAAKIA", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "0" * 23, "0" * 24,
        "f" * 30 + "G" + "e" * 24, "paſſword=abcdef", "toKen=abcdef", "secret=secret=secret=", "passwd" * 50 + " " * 50, 'token="' + "a1" * 20 + '"', "é token: 日本 token:日", *PLAIN,
    ]
    random = np.random.default_rng(3)
    texts += ["".join(random.choice(list("token:= '\"AKI0af_secret"), 200)) for _ in range(200)]
    for text in texts:
        assert [s[:3] for s in base_spans(text)] == brute(text)


def test_random_strings_are_told_from_identifiers(models):
    found = {}
    for form, samples in zip(FORMS, made_secrets(200, 99), strict=True):
        found[form] = np.mean([bool(models.random_parts(s, LEAST_LENGTH, 16.0, 0.5)) for s in samples])
    assert min(found.values()) >= 0.95, found
    ordinary = [i for i in made_identifiers(500, 98) if len(i) >= LEAST_LENGTH]
    assert np.mean([bool(models.random_parts(i, LEAST_LENGTH, 16.0, 0.5)) for i in ordinary]) <= 0.002


def test_added_spans_and_their_places(spark, models):
    texts = [f"É {SECRET} end", f"see https://host.org/path/{SECRET}?x", f"token = {SECRET}", "123e4567-e89b-12d3-a456-426614174000", "x" * 60, "https://www.example.org/wiki/Some-Long-Article-Title_about_rivers", "1234567890" * 6 + " ="]
    rows = by_id(find_secrets(features(spark, texts), models))
    spans = {i: [(s.kind, s.start, s.end, s.base) for s in r.spans] for i, r in rows.items()}
    assert spans[0] == [(RANDOM, 2, 2 + len(SECRET), False)]
    kind, start, end, base = spans[1][0]
    assert (kind, base, end) == (RANDOM, False, len(texts[1]) - 2) and abs(start - texts[1].index(SECRET)) <= 4
    assert spans[2] == [("assign", 0, len(texts[2]), True)]
    assert spans[3] == spans[4] == spans[5] == []
    assert [s[0] for s in spans[6]] == ["hex"]
    assert all(s.score >= 16 for r in rows.values() for s in r.spans if s.kind == RANDOM)


def test_awkward_rows(spark, models):
    texts = [*TEXTS, SECRET * 20_000, ("ab" + SECRET + " ") * 2000, "=" * 300_000]
    keys = [("layer", i) for i in range(len(texts))]
    df = features(spark, texts, keys=keys).union(features(spark, [f"token={SECRET}"] * 2, keys=[(None, None)] * 2))
    rows = find_secrets(df, models).collect()
    assert len(rows) == len(texts) + 2
    own = {r.feature_id: r.spans for r in rows if r.feature_id is not None}
    assert all(own[i] == [] for i, t in enumerate(TEXTS) if t != "0123 4567 " * 40) and LONG in TEXTS
    assert [(s.start, s.end) for s in own[len(TEXTS)]] == [(0, len(SECRET) * 20_000)]
    assert len(own[len(TEXTS) + 1]) == 2000 and own[len(TEXTS) + 2] == []
    assert [len(r.spans) for r in rows if r.feature_id is None] == [1, 1]
    assert all(list(KINDS).index(a.kind) <= list(KINDS).index(b.kind) for spans in own.values() for a, b in zip(spans, spans[1:], strict=False) if a.start == b.start)
    empty = features(spark, [])
    assert find_secrets(empty, learn_secrets(empty)).count() == 0


def test_counts_of_all_rows_and_blocks_agree(spark):
    """Counted in parts and blocks as in one go; excursions as by trying every part."""
    from parchline.llm import credentials as C

    text = "".join(np.random.default_rng(1).choice(list("abc. _é1"), 5000))
    whole = np.concatenate(list(C.cells_of(C.codes_of(text))))
    before, C.BLOCK = C.BLOCK, 7
    try:
        assert (np.concatenate(list(C.cells_of(C.codes_of(text)))) == whole).all()
    finally:
        C.BLOCK = before
    assert list(excursions([-1, 3, -1, 4, -9, 5, 5, -1], 5)) == [(1, 4, 6.0), (5, 7, 10.0)]
    assert isinstance(learn_secrets(features(spark, [])), SecretModels)
