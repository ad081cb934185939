"""Small feature tables for the corpus operators."""

SCHEMA = "dataset_key string, feature_id bigint, name string, props map<string,string>, text string, digest int, row int, row_key int"

LONG = "Station reading of the month, " * 4000
TEXTS = [
    None, "", " \n\t", "Of.", "a", "The lower basin had a dry spring and a wetter summer than before.",
    "The lower basin had a dry spring and a wetter summer than before.",
    "The lower  basin had a dry\nspring and a wetter summer than before. ",
    "El embalse recibió más agua que en los años anteriores, según la estación.", "é" * 300, "0123 4567 " * 40, LONG, LONG, "日本の雨量計は毎月の値を記録する。",
]


def features(spark, texts, languages=None, keys=None):
    """One feature per text, with columns whose names clash with the operators' own."""
    keys = keys or [(f"layer{i % 2}", i) for i in range(len(texts))]
    languages = languages or [None] * len(texts)
    rows = [
        (key[0], key[1], None, None if text is None and i % 2 else {"description": text, "language": lang}, "other", 1, 2, 3)
        for i, (text, lang, key) in enumerate(zip(texts, languages, keys, strict=True))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["feature_id"]: r for r in df.collect()}
