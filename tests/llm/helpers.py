"""Small documents with the cases that every operator must take."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs away into the dark woods where nobody can find it again"
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft dann in den dunklen wald wo ihn niemand mehr finden kann"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)


def odd_rows():
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    return [
        (1, ENGLISH, "en"),
        (2, ENGLISH, "en"),
        (2, ENGLISH, "en"),
        (3, None, None),
        (4, "", "en"),
        (5, " \t\n", "de"),
        (6, GERMAN, "de"),
        (7, (ENGLISH + ". ") * 2000, "en"),
        (None, "word", None),
        (8, "12 34 !!", "en"),
        (9, "é漢🙂 Kin " + ENGLISH, "en"),
    ]


def with_clashes(df):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    out = df
    for name in ("uid", "kept", "n", "score", "label", "words", "hits", "key", "part", "size", "_id", "host", "x"):
        out = out.withColumn(name, F.lit("clash"))
    return out
