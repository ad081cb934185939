import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, by_id, features
from parchline.llm import encoding as E
from parchline.llm import packing as K
from parchline.llm.words import Words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a  b", "a   b \n c", " \n x", "x \n", "tail ", " lead", "it's we'll  'S", "\t\t\ttab   b", "a\n\n b", "x  y", "<|endoftext|> is text", "汉字 かな", "é ² ½ x", "\x1c \x1d a \x85 b",
    "word\n \nword", "\r\n \r\n", "0 1 22 333",
]


def random_texts(n=300):
    rng = np.random.default_rng(9)
    return ["".join(rng.choice(list("ab \n\t1.'s  é "), int(rng.integers(1, 40)))) for _ in range(n)]


def test_ids_and_bytes_match_the_library(spark):
    plain = E.encoder(RANKS, public_tokenizers.PATTERN)
    texts = [*TEXTS, *ODD, *random_texts()]
    tokens = E.encode_descriptions(features(spark, texts), RANKS, public_tokenizers.PATTERN)
    found = by_id(E.decode_descriptions(tokens, RANKS, public_tokenizers.PATTERN))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert list(found[i].ids) == plain.encode_ordinary(t or ""), repr(t)
        assert bytes(found[i].content) == (t or "").encode()
    assert E.encode_descriptions(features(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, [])], "dataset_key string, feature_id int, ids array<int>")
    assert [bytes(r.content) for r in E.decode_descriptions(rows, RANKS, public_tokenizers.PATTERN).collect()] == [b"", b""]


@pytest.mark.parametrize("text", [*ODD, "one two  three\n\n\n\n\nfour    five " * 5, "x" + "\n \t" * 9 + " y", " " * 30])
def test_cuts_and_runs_do_not_change_ids(monkeypatch, text):
    import re

    monkeypatch.setattr(E, "RUN", re.compile(E.RUN.pattern.replace(str(E.LONG_RUN), "3")))
    monkeypatch.setattr(E, "LONG_RUN", 1)
    plain = E.encoder(RANKS, public_tokenizers.PATTERN)
    assert E.encode_text(plain, text, 4) == plain.encode_ordinary(text)
    assert "".join(E.cut(text, 4)) == text


def test_white_space_beyond_the_engine():
    plain = E.encoder(RANKS, public_tokenizers.PATTERN)
    text = "a" + " " * 200_000 + "b"
    assert plain.decode_bytes(E.encode_text(plain, text)) == text.encode()


def test_known_words_are_bounded():
    words = Words(lambda texts: [len(t).to_bytes(4, "little") for t in texts], most=3)
    for text in ("a b c d", "e f g h", "a b", "z" * 100):
        assert len(words.ids(text)) == 4 * len(text.split(" "))
        assert len(words.known) <= 7 and all(len(w) <= 64 for w in words.known)


def documents_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


@pytest.mark.parametrize("window,shard", [(2048, 100_000), (16, 7)])
def test_every_id_is_packed_once(spark, window, shard):
    texts = [*TEXTS, *ODD, *random_texts(100), "same", "same"]
    df = K.pack_descriptions(features(spark, texts), VOCABULARY, window=window, shard_rows=shard)
    rows, documents = df.collect(), documents_of(texts)
    pieces = {}
    for r in rows:
        ids = documents[r.feature_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces.setdefault(r.feature_id, []).append((r.start, r.length))
    for i, ids in enumerate(documents):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and 0 < length <= window
            at += length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert K.pack_descriptions(features(spark, []), VOCABULARY).count() == 0


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(4)
    lengths = sorted(rng.integers(1, 101, 500).tolist(), reverse=True)
    free, expected = [], []
    for n in lengths:
        fits = [(c, -i) for i, c in enumerate(free) if c >= n]
        if not fits:
            free.append(100)
            at = len(free) - 1
        else:
            least = min(fits)[0]
            at = max(i for i, c in enumerate(free) if c == least)
        expected.append(100 - free[at])
        free[at] -= n
    # Windows of equal room are alike, so the offsets decide.
    assert sorted(o for _, o in K.best_fit(lengths, 100)) == sorted(expected)
