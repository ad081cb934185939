import duckdb
import pytest
from cases import TEXTS

import corpus_pipeline as C
from parchline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, content string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, {8: "es", 13: "ja"}.get(i, None if i % 3 else "en"), None if i % 5 == 0 else "s", None if i % 2 else len(t or ""), "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_stages_over_awkward_rows(spark):
    near = "the basin had a dry spring and a wetter summer than in all the years before that one and after it too as the gauges showed"
    texts = [*TEXTS, near, near + " again", near, "write to a@b.org today about the gauge of the basin", "12345 67890"]
    df = docs(spark, texts).union(docs(spark, texts).where("doc_id = 5"))
    kept = C.language(spark, df, "")
    assert kept.columns == list(C.COLUMNS)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*[i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")], 5])
    single = C.exact_copies(spark, kept, "")
    rows = {r.doc_id: r.text for r in single.collect()}
    plain = lambda t: "".join(t.split())
    assert single.count() == len(rows) == len({plain(t) for t in rows.values()}) == len({plain(r.text) for r in kept.collect()})
    few = {r.doc_id for r in C.near_copies(spark, single, "").collect()}
    assert few == set(rows) - {len(TEXTS) + 1}
    masked = {r.doc_id: r for r in C.personal_data(spark, single, "").collect()}
    assert set(masked) == set(rows) and masked[len(TEXTS) + 3].text == "write to <EMAIL> today about the gauge of the basin"
    assert all(r.n_chars == len(r.text) for r in masked.values())
    packed = C.packing(spark, single, "").collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_an_empty_table_goes_through(spark):
    df = docs(spark, TEXTS).where("false")
    for _, stage in C.STAGES:
        df = stage(spark, df, "").select("*")
        assert df.count() == 0
        if df.columns != list(C.COLUMNS):
            break


def test_run_keeps_every_clean_document_once(spark):
    found = C.run(spark, FOLDER).select("doc_id", "length", "sequence_id").collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    kept = {r.doc_id for r in found}
    sets = {}
    for i, t in sorted(texts.items()):
        words = (t or "").lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    order = sorted(texts)
    # Chains of near copies keep one document; alone standing documents all stay.
    alone = {a for a in order if any(c.isalpha() for c in texts[a] or "") and not any(near(a, b) for b in order if a != b)}
    assert alone <= kept
    assert not any(near(a, b) for a in kept for b in kept if a < b)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    assert sorted(d[0] for d in found.description) == columns
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run_over_whole_tables(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
