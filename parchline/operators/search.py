"""Search of features by any part of their texts, through a table of the places of short strings.

The table has a row for every string of one, two and three characters of every searched text, with its place. A query is
found where its strings stand at successive places, so the answer is exact and no text is read. Rows are laid out by string, so a search
reads the few that it asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def postings(features: DataFrame, texts: Sequence[Column], keys: Sequence[str] = ("dataset_key", "feature_id")) -> DataFrame:
    """``(gram, keys…, field, at)``: the strings of up to three characters of each text, lower-cased, and where they stand."""
    lowered = F.array(*[F.lower(F.coalesce(t.cast("string"), F.lit(""))) for t in texts])
    fields = features.select(*keys, F.posexplode(lowered).alias("field", "text")).where(F.col("text") != "")
    placed = fields.select(*keys, "field", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("at"))
    grams = F.array_distinct(F.array(*[F.substr("text", F.col("at") + 1, F.lit(n)) for n in range(1, LONGEST + 1)]))
    return placed.select(F.explode(grams).alias("gram"), *keys, "field", "at")


def write_postings(rows: DataFrame, path: str) -> None:
    """Laid out by string; one that very many features have spreads over tasks by feature."""
    order = [c for c in rows.columns if c not in ("field", "at")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def found_features(table: DataFrame, query: str, keys: Sequence[str] = ("dataset_key", "feature_id")) -> DataFrame:
    """``(keys…, first_field)``: features with the query in one of their texts, ignoring case.

    ``first_field`` is the first text that begins with the query, null if none does. A blank query finds every feature that has a text.
    """
    wanted = (query or "").strip().lower()
    size = min(LONGEST, len(wanted))
    if not wanted:
        return table.where(F.col("at") == 0).groupBy(*keys).agg(F.min("field").alias("first_field"))
    # Every string of the query with its distances from the start; a string may come several times.
    steps: dict[str, list[int]] = {}
    for at in range(len(wanted) - size + 1):
        steps.setdefault(wanted[at : at + size], []).append(at)
    rows = table.where(F.col("gram").isin(*steps))
    back = F.lit(None).cast("array<int>")
    for gram, places in steps.items():
        back = F.when(F.col("gram") == gram, F.array(*[F.lit(p) for p in places])).otherwise(back)
    starts = rows.select(*keys, "field", F.explode(F.transform(back, lambda b: F.col("at") - b)).alias("start"))
    # At one start each string of the query can stand once.
    matches = starts.groupBy(*keys, "field", "start").agg(F.count("*").alias("n")).where(F.col("n") == sum(map(len, steps.values())))
    return matches.groupBy(*keys).agg(F.min(F.when(F.col("start") == 0, F.col("field"))).alias("first_field"))
