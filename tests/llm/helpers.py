"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
    (2, "the  quick brown\tfox jumps over the lazy dog", "en", "a", 1),
    (3, "The quick brown fox jumps over the lazy dog", None, "b", None),
    (4, None, "en", "b", None),
    (5, "", None, None, None),
    (6, " \t\n ", "fr", None, None),
    (7, LONG, "en", "a", None),
    (8, LONG + "end", "en", "a", None),
    (8, LONG + "end", "en", "a", None),
    (None, "no id here at all, none", "en", "c", None),
    (None, None, None, "c", None),
    (9, "12345 !!! 678", None, "c", None),
    (10, "Größe über alles, straße und schön", "de", "c", None),
    (11, "x", "en", "c", None),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, tmp_path, df, name="documents"):
    path = f"{tmp_path}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
