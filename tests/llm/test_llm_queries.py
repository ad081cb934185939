"""Columns of registered queries against plain versions over whole tables."""

import hashlib
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pytest
from parchline.llm.queries import QUERIES
from test_llm_credentials import brute
from test_llm_whitening import plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())


def test_secrets_query(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op11_secrets"](spark, FOLDER).collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        spans = brute(text)
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        row = rows[doc]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == kind for *_, k in spans) for kind in ("assign", "access", "hex")]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        found = [s for s in row.spans.split(",") if s]
        assert [s for s in found if not s.startswith("random:")] == [s for s in listed.split(",") if s]


def test_whitening_query(spark):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids = [i for i, _ in vectors]
    rows = {(r.vec_id, r.component): r for r in QUERIES["op13_whitening"](spark, FOLDER).collect()}
    components = max(c for _, c in rows)
    white, explained, deviation = plain([v for _, v in vectors], components)
    mine = np.array([[rows[i, c + 1].whitened for c in range(components)] for i in ids])
    assert len(rows) == len(ids) * components and np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-7
    assert [rows[i, 1].deviation for i in ids] == deviation.tolist() and {r.n for r in rows.values()} == {len(ids)}
    assert np.allclose([rows[ids[0], c + 1].explained for c in range(components)], explained, rtol=1e-9)
    assert max(r.identity_error for r in rows.values()) < 1e-4


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = list(texts)
    ids = {d: [*e.ids, 1] for d, e in zip(docs, tokenizer.encode_batch([texts[d] for d in docs], add_special_tokens=False), strict=True)}
    rows = QUERIES["op10_packing"](spark, FOLDER).collect()
    covered, sequences = {d: [] for d in docs}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(array("I", own[r.start : r.start + r.length]).tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, pieces in covered.items():
        assert [s for s, _ in sorted(pieces)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(pieces)])[:-1]]).tolist()
        assert sum(n for _, n in pieces) == len(ids[d])
    for pieces in sequences.values():
        ordered = sorted(pieces)
        assert [o for o, _ in ordered] == np.concatenate([[0], np.cumsum([n for _, n in ordered])[:-1]]).tolist() and sum(n for _, n in ordered) <= 2048
