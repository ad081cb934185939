import re

import numpy as np
import pytest
from cases import TEXTS, by_id, features
from parchline.llm import personal as P
from parchline.llm.tagger import KINDS, TAGS, Tagger

SAMPLES = [
    "write a.b-c@mail.example.com, or x@y@z.org; call +1 (743) 555-3824 now", "192.168.1.1.2.3.4.5 and 300.1.1.1 and 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, +49 30 1234567 8901 23456", "@a.b x@ y@b. +12 1+2345678901", "9" * 500 + ".1.1.1", "a" * 3000 + "@", "00.01.002.255",
    "mail: é.x@dom.co.uk. 5500005555555559 4012888888881881", "+1 2 3 4 5 6 7 8 9 0)" + " ." * 50, "1.1.1.1@2.2", "",
]


def brute(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = []
    for kind, pattern in zip(KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"), strict=True):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind, True))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@pytest.mark.parametrize("text", SAMPLES)
def test_base_spans_match_the_plain_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(5)
    for _ in range(400):
        text = "".join(rng.choice(list("01234567899..@@+-() ab"), int(rng.integers(0, 120))))
        assert P.base_spans(text) == brute(text), text


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    tagger = Tagger(3, {k: v.astype(np.float64) for k, v in Tagger.fresh(3, 1).weights.items()})
    codes, tags = rng.integers(0, 30, (7, 4)).astype(np.uint8), rng.integers(0, TAGS, (7, 4))
    _, grads = tagger.gradients(codes, tags)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        loss = []
        for step in (1e-4, -2e-4):
            tagger.weights[name][at] += step
            loss.append(tagger.gradients(codes, tags)[0])
        tagger.weights[name][at] += 1e-4
        # The loss is a mean over rows, the gradients are sums.
        assert np.isclose((loss[0] - loss[1]) / 2e-4 * 4, g[at], rtol=5e-2), name


def test_viterbi_matches_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    tagger = Tagger.fresh(2, 2)
    tagger.weights["t"] = rng.normal(size=(TAGS, TAGS)).astype(np.float32)
    scores = rng.normal(size=(4, TAGS)).astype(np.float32)
    value = lambda p: sum(scores[i, t] for i, t in enumerate(p)) + sum(tagger.weights["t"][a, b] for a, b in zip(p, p[1:], strict=False))
    assert tuple(tagger.best_tags(scores)) == max(product(range(TAGS), repeat=4), key=value)


@pytest.fixture(scope="module")
def tagger(spark):
    texts = [t for t in TEXTS if t and len(t) < 1000] * 10 + [f"reading {i} of the month by station mail{i}@host.org and 10.0.{i}.1 there" for i in range(60)]
    return P.learn_personal(features(spark, texts), sample_windows=150, made_rows=200, epochs=6)


def test_tagger_finds_what_it_learned(tagger):
    texts = [t for t, _ in P.made_windows(["the station reports the rain of the month and the level of the river " * 3], 80, 99)]
    truth = [{(s, e, k) for s, e, k, _ in P.base_spans(t)} for t in texts]
    tagged = P.tagged_spans(texts, tagger)
    hits = sum(len(t & set(g)) for t, g in zip(truth, tagged, strict=True))
    assert hits >= 0.7 * sum(map(len, truth))


def test_spans_over_window_borders_are_found_once(tagger):
    value = "station.mail@hydro.example.org"
    for shift in range(60, 180, 7):
        text = "a" * (shift - 1) + " " + value + " " + "b" * 400
        spans = P.all_spans([text], tagger)[0]
        assert (shift, shift + len(value), "email", True) in spans
        assert all(b for *_, b in spans) or len({s[:2] for s in spans}) == len(spans)


def test_query_columns_and_edge_cases(spark, tagger):
    texts = [*TEXTS, *SAMPLES]
    found = by_id(P.find_personal(features(spark, texts), tagger, masked=True))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        spans = [(s.start, s.end, s.kind, s.base) for s in found[i].spans]
        assert [s for s in spans if s[3]] == brute(t or "")
        assert not any(a[0] < b[1] and b[0] < a[1] for a in spans if not a[3] for b in spans if b[3])
        assert found[i].masked == P.masked_text(t or "", spans)
    assert P.find_personal(features(spark, []), tagger).count() == 0
    assert P.masked_text("to a@b.c now", P.base_spans("to a@b.c now")) == "to <EMAIL> now"


def test_learning_from_an_empty_table(spark):
    assert P.learn_personal(features(spark, []), made_rows=20, epochs=1).hidden == P.HIDDEN
