"""Thin queries: the given tables as features, an operator, and the columns that are compared."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import NAMED, derived_records, urn
from .credentials import BASE_KINDS, find_secrets, learn_secrets
from .encoding import decode_descriptions, each_ids, encode_descriptions
from .exact import exact_duplicates
from .jaccard import jaccard_links
from .language import learn_languages, predict_languages
from .manifest import feature_manifest
from .nearest import nearest_features
from .packing import pack_descriptions
from .passages import repeated_passages
from .personal import find_personal, learn_personal
from .records import DESCRIPTION, LANGUAGE
from .suffixes import repeated_bytes
from .tagger import KINDS
from .whitening import whitened_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def as_features(documents: DataFrame) -> DataFrame:
    """Documents as features: the source is the layer, text and language are attributes."""
    return documents.select(
        F.col("source").alias("dataset_key"), F.col("doc_id").alias("feature_id"),
        F.create_map(F.lit(DESCRIPTION), "text", F.lit(LANGUAGE), "lang").alias("props"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return as_features(spark.read.parquet(f"{folder}/documents.parquet"))


def listed(spans: F.Column) -> F.Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def remainder() -> F.Column:
    return F.crc32(F.col("feature_id").cast("string")) % 4


@query("op1_personal")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document; the counts and the digest are of the fixed patterns, ``spans`` has all."""
    features = documents(spark, folder)
    found = find_personal(features, learn_personal(features))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        F.col("feature_id").alias("doc_id"),
        *[F.size(F.array_remove(F.transform(base, lambda s: s["kind"] != k), True)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query("op2_suffixes")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that lie in a string of 200 bytes found elsewhere too."""
    found = repeated_bytes(documents(spark, folder))
    return found.select(
        F.col("feature_id").alias("doc_id"), "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, r: total + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op3_passages",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    u AS (
      SELECT doc_id, level, unnest(units) AS unit, generate_subscripts(units, 1) AS place FROM (
        SELECT doc_id, 'line' AS level, regexp_extract_all(text, '[^\n]+\n*|\n+') AS units FROM d
        UNION ALL SELECT doc_id, 'sentence', regexp_extract_all(text, '[^.!?\n]+[.!?\n]*|[.!?\n]+') FROM d)),
    p AS (
      SELECT *, lower(trim(regexp_replace(unit, '[ \t-\r]+', ' ', 'g'), ' ')) AS plain,
        sum(length(unit)) OVER (PARTITION BY doc_id, level ORDER BY place) AS "end" FROM u),
    w AS (SELECT *, "end" - length(unit) AS start FROM p WHERE plain <> '' AND (level = 'line' OR length(plain) >= 40)),
    r AS (SELECT *, row_number() OVER (PARTITION BY level, plain ORDER BY doc_id, start) AS rank FROM w),
    x AS (SELECT doc_id, start, "end", max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM r WHERE rank > 1),
    g AS (SELECT *, sum(CASE WHEN before >= start THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM x),
    m AS (SELECT doc_id, run, min(start) AS start, max("end") AS "end" FROM g GROUP BY ALL),
    s AS (SELECT doc_id, count(*) AS n, sum("end" - start) AS chars, string_agg(start || ':' || "end", ',' ORDER BY start) AS spans FROM m GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS n_units FROM w GROUP BY doc_id)
    SELECT d.doc_id, length(d.text)::BIGINT AS n_chars, coalesce(c.n_units, 0)::BIGINT AS n_units, coalesce(s.n, 0)::BIGINT AS n_removed,
      coalesce(s.chars, 0)::BIGINT AS removed_chars, coalesce(s.spans, '') AS spans
    FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated lines and sentences of every document, as removed runs of its text."""
    found = repeated_passages(documents(spark, folder))
    runs = F.col("removed")
    return found.select(
        F.col("feature_id").alias("doc_id"), "n_chars", "n_units", F.size(runs).cast("bigint").alias("n_removed"),
        F.aggregate(runs, F.lit(0).cast("bigint"), lambda total, r: total + r["end"] - r["start"]).alias("removed_chars"),
        F.array_join(F.transform(runs, lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("spans"),
    )


@query("op4_language")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    features = documents(spark, folder)
    held_out = F.coalesce(remainder() == 2, F.lit(False))
    found = predict_languages(features, learn_languages(features.where(~held_out)))
    return found.select(F.col("feature_id").alias("doc_id"), held_out.alias("held_out"), F.col("found").alias("lang_pred"), "score")


@query(
    "op5_exact_duplicates",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
    r AS (SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w AS place
          FROM d WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST))
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    found = exact_duplicates(documents(spark, folder))
    return found.select(F.col("feature_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op6_jaccard")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class and number of links of every document (five words, similarity from 0.8)."""
    found = jaccard_links(documents(spark, folder))
    return found.select(F.col("feature_id").alias("doc_id"), "class_id", "class_size", "n_links")


@query("op7_nearest")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("feature_id"), F.col("embedding").alias("values"))
    found = nearest_features(vectors, vectors.where(F.col("feature_id") % 100 == 0))
    return found.select("query_id", "rank", F.col("feature_id").alias("vec_id"), "score")


def named_sql() -> str:
    """The named references as entries of an SQL map, without their ampersand."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return ", ".join(f"{quoted(name[1:])}: {quoted(value)}" for name, value in NAMED.items())


def decoded_sql(column: str) -> str:
    """A text with its references decoded once, cut before each ampersand; the map of names is ``named``."""
    number = "CASE WHEN {0} BETWEEN 1 AND 55295 OR {0} BETWEEN 57344 AND 1114111 THEN chr({0}::INTEGER) || substr(p, instr(p, ';') + 1) ELSE '&' || p END"
    decimal = number.format("regexp_extract(p, '^#([0-9]+);', 1)::BIGINT")
    hexadecimal = number.format("('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+);', 1))::BIGINT")
    word = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;?')"
    known = [f"map_extract(named, {word})[1] || substr(p, length({word}) + 1)"] + [f"map_extract(named, p[:{n}])[1] || substr(p, {n + 1})" for n in range(6, 1, -1)]
    piece = (
        f"CASE WHEN regexp_matches(p, '^#[0-9]{{1,7}};') THEN {decimal} WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{{1,6}};') THEN {hexadecimal} "
        f"ELSE coalesce({', '.join(known)}, '&' || p) END"
    )
    return f"string_split({column}, '&')[1] || array_to_string(list_transform(string_split({column}, '&')[2:], lambda p: {piece}), '')"


@query(
    "op8_archive",
    r"""
    WITH p AS (
      SELECT page_id, url, coalesce(html, '') AS html,
        regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)', '', 'g') AS seen,
        md5(concat_ws(chr(10), page_id, url)) AS m FROM pages),
    q AS (
      SELECT *, regexp_replace(regexp_replace(regexp_replace(seen, '[\r\n]+', ' ', 'g'),
          '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
          '</?[A-Za-z!][^>]*>', '', 'g') AS stripped,
        regexp_replace(regexp_extract(seen, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '</?[A-Za-z!][^>]*>', '', 'g') AS heading,
        '<urn:uuid:' || concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) || '>' AS refers_to FROM p),
    n AS (SELECT MAP {""" + named_sql() + r"""} AS named),
    r AS (SELECT *, """ + decoded_sql("stripped") + " AS body, " + decoded_sql("heading") + r""" AS name FROM q, n),
    t AS (
      SELECT *, regexp_replace(regexp_replace(regexp_replace(body, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '\A[ \n]+|[ \n]+\z', '', 'g') AS plain,
        regexp_replace(regexp_replace(regexp_replace(name, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '\A[ \n]+|[ \n]+\z', '', 'g') AS title,
        list_transform(regexp_extract_all(seen, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)', 1),
          lambda x: 'outlink: ' || regexp_replace(replace(regexp_replace(x, '^["'']|["'']$', '', 'g'), '&amp;', '&'), '[\r\n]+', ' ', 'g') || chr(13) || chr(10)) AS links FROM r),
    b AS (
      SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
        'title: ' || regexp_replace(title, '[\r\n]+', ' ', 'g') || chr(13) || chr(10) || 'language: ' || regexp_replace(regexp_extract(html, '(?i)<html\s(?:[^>]*?\s)?(?:xml:)?lang\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)', 1), '^["'']|["'']$', '', 'g')
          || chr(13) || chr(10) || array_to_string(links, '') AS block FROM t
      UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', plain FROM t),
    c AS (SELECT *, 'sha256:' || sha256(html) AS payload_digest, md5(concat_ws(chr(10), record_type, refers_to, url, 'sha256:' || sha256(html))) AS k FROM b)
    SELECT page_id, record_type, '<urn:uuid:' || concat_ws('-', k[1:8], k[9:12], k[13:16], k[17:20], k[21:32]) || '>' AS record_id, refers_to, url AS target_uri,
      content_type, octet_length(encode(block))::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest,
      'Content-Type: text/html' AS source_headers, block FROM c
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and plain-text records of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    source = urn(F.col("page_id").cast("string"), F.col("url"))
    responses = pages.select(
        source.alias("record_id"), F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("warc_date"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"), F.col("html").alias("payload"), "page_id",
    )
    return derived_records(responses, "page_id").drop("warc_date")


@query("op9_tokens")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-pair tokens of every document, and the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = encode_descriptions(documents(spark, folder), ranks, public_tokenizers.PATTERN)
    decoded = decode_descriptions(tokens, ranks, public_tokenizers.PATTERN)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts = [], []
            for ids in each_ids(batch.column("ids")):
                counts.append(len(ids))
                texts.append(hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest())
            content = [hashlib.sha256(c.as_buffer()).hexdigest() for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("feature_id"), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(content, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return decoded.mapInArrow(digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token sequences of at most 2048 ids."""
    found = pack_descriptions(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("feature_id", "doc_id").drop("dataset_key")


@query("op11_secrets")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document; the counts and the digest are of the fixed patterns, ``spans`` has all."""
    features = documents(spark, folder)
    found = find_secrets(features, learn_secrets(features))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        F.col("feature_id").alias("doc_id"),
        *[F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query(
    "op12_manifest",
    """
    WITH RECURSIVE steps AS (
      SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc),
    d AS (
      SELECT doc_id, source, lang, n_chars, text, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) % 5 = 0 AS changed FROM documents, steps),
    f AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
    h AS (
      SELECT doc_id, source, k.*, changed FROM f, LATERAL (
        SELECT coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
          || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head) AS z,
        LATERAL (SELECT sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
          sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) AS other) AS k),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM h),
    up AS (
      SELECT source, 0 AS level, place AS node, leaf AS hash, size FROM r
      UNION ALL
      SELECT source, level + 1, node // 16, sha256(string_agg(hash, '' ORDER BY node)), (any_value(size) + 15) // 16 FROM up WHERE size > 1 GROUP BY source, level, node // 16),
    subroots AS (
      SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS number, count(*) OVER () AS size, level AS height FROM up WHERE size = 1),
    over AS (
      SELECT 0 AS level, number AS node, subroot AS hash, size FROM subroots
      UNION ALL
      SELECT level + 1, node // 16, sha256(string_agg(hash, '' ORDER BY node)), (any_value(size) + 15) // 16 FROM over WHERE size > 1 GROUP BY level, node // 16),
    runs AS (SELECT source, level, node // 16 AS run, list(hash ORDER BY node) AS hashes FROM up WHERE size > 1 GROUP BY ALL),
    tops AS (SELECT level, node // 16 AS run, list(hash ORDER BY node) AS hashes FROM over WHERE size > 1 GROUP BY ALL),
    p AS (SELECT r.*, subroot, number, height, (SELECT hash FROM over WHERE size = 1) AS root FROM r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source),
    ways AS (
      SELECT p.source, p.place, g.level AS step, p.place // (16 ** g.level)::BIGINT % 16 AS digit, g.hashes FROM p JOIN runs g
        ON g.source IS NOT DISTINCT FROM p.source AND g.run = p.place // (16 ** (g.level + 1))::BIGINT
      UNION ALL
      SELECT p.source, p.place, p.height + t.level, p.number // (16 ** t.level)::BIGINT % 16, t.hashes FROM p JOIN tops t ON t.run = p.number // (16 ** (t.level + 1))::BIGINT),
    sides AS (
      SELECT source, place, step, array_to_string(hashes[:digit::BIGINT], '') AS l, array_to_string(hashes[digit::BIGINT + 2:], '') AS r FROM ways),
    proofs AS (SELECT source, place, sha256(string_agg(l || r, '' ORDER BY step)) AS proof, list({'l': l, 'r': r} ORDER BY step) AS path FROM sides GROUP BY ALL),
    folds AS (
      SELECT p.source, p.place, 1 AS step, CASE WHEN changed THEN other ELSE leaf END AS node, coalesce(path, []) AS path FROM p
        LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.place = q.place
      UNION ALL
      SELECT source, place, step + 1, sha256(path[step].l || node || path[step].r), path FROM folds WHERE step <= len(path))
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
    FROM p JOIN folds f ON p.source IS NOT DISTINCT FROM f.source AND p.place = f.place AND f.step = len(f.path) + 1
      LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.place = q.place
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, layer root, root and proof of every document, and whether a copy with some texts lower-cased still verifies."""
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    entries = lambda text: F.create_map(F.lit(LANGUAGE), "lang", F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit(DESCRIPTION), text)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    features = rows.select(
        F.col("source").alias("dataset_key"), F.col("doc_id").alias("feature_id"), entries(F.col("text")).alias("props"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, entries(lowered)).alias("received"),
    )
    found = feature_manifest(features, F.col("received"), (LANGUAGE, "n_chars"))
    return found.select(F.col("feature_id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector along the first 32 principal components, whitened."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("feature_id"), F.col("embedding").alias("values"))
    found = whitened_features(vectors)
    return found.withColumnRenamed("feature_id", "vec_id").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
