"""Corpus pipeline over ``documents``: language, exact copies, near copies, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of ``documents``; other columns of their input are left behind. An empty table goes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchline.llm.exact import exact_duplicates
from parchline.llm.jaccard import jaccard_links
from parchline.llm.language import UNDETERMINED, learn_languages, predict_languages
from parchline.llm.packing import pack_descriptions
from parchline.llm.personal import find_personal, learn_personal
from parchline.llm.records import DESCRIPTION, LANGUAGE, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3
SIZE = "n_chars"
# Workers still hold memory of the earlier stages, so this stage keeps fewer words; the result is the same.
PACKING_WORDS = 300_000
PACKING_BYTES = 1 << 20


def as_features(docs: DataFrame) -> DataFrame:
    """Documents as features; the size rides along as text, like every attribute."""
    attributes = F.create_map(F.lit(DESCRIPTION), "text", F.lit(LANGUAGE), "lang", F.lit(SIZE), F.col("n_chars").cast("string"))
    return docs.select(F.col("source").alias("dataset_key"), F.col("doc_id").alias("feature_id"), attributes.alias("props"))


def row_key(*columns: str) -> Column:
    """One text that tells rows apart by these columns, nulls included."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or text, and those that look like none of the learned languages."""
    features = as_features(docs)
    found = predict_languages(features, learn_languages(features), keep=(DESCRIPTION, LANGUAGE, SIZE))
    good = found.where((F.col("found") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return good.select(
        F.col("feature_id").alias("doc_id"), F.col(DESCRIPTION).alias("text"), F.col(LANGUAGE).alias("lang"), F.col("dataset_key").alias("source"),
        F.col(SIZE).cast("bigint").alias("n_chars"),
    )


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group with equal text (white space aside)."""
    kept = exact_duplicates(as_features(docs)).where("kept").select(row_key("text_sha256", "points", "feature_id", "dataset_key").alias("row_key"))
    text = F.coalesce("text", F.lit(""))
    plain = F.translate(text, " \t\n\x0b\x0c\r", "")
    keyed = docs.select(*COLUMNS).withColumns({"text_sha256": F.sha2(plain, 256), "points": F.char_length(text)})
    keyed = keyed.withColumn("row_key", row_key("text_sha256", "points", "doc_id", "source")).drop("text_sha256", "points")
    # Rows repeated with key and text have one row_key; one of them stays.
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every near-duplicate class (five words, similarity from 0.8)."""
    kept = jaccard_links(as_features(docs)).where("kept").select(F.hex("content").alias("name"), "feature_id", "dataset_key")
    kept = kept.select(row_key("name", "feature_id", "dataset_key").alias("row_key"))
    keyed = docs.select(*COLUMNS).withColumn("name", F.upper(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    return keyed.withColumn("row_key", row_key("name", "doc_id", "source")).join(kept, "row_key", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by its kind; no document is dropped."""
    features = as_features(docs)
    found = find_personal(features, learn_personal(features), keep=(LANGUAGE,), masked=True)
    return found.select(
        F.col("feature_id").alias("doc_id"), F.col("masked").alias("text"), F.col(LANGUAGE).alias("lang"), F.col("dataset_key").alias("source"),
        F.char_length("masked").cast("bigint").alias("n_chars"),
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of at most 2048 tokens."""
    found = pack_descriptions(as_features(docs), public_tokenizers.path("byte_bpe_50k.json"), known_words=PACKING_WORDS, batch_bytes=PACKING_BYTES)
    return found.withColumnRenamed("feature_id", "doc_id").withColumnRenamed("dataset_key", "source")


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packing)]
# Language models, trained taggers and tokenizers are beyond SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
