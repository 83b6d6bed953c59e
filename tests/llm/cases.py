"""Documents that are awkward: nulls, empty and very long texts, repeated rows, ties, names that clash."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("key", "n", "score", "weight", "mix_u", "pii_base", "quality_score", "label", "kind", "row", "spans", "source_size", "copies", "fold")]
)
_EXTRA = ("k",) * 14


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *_EXTRA)


def awkward(spark):
    rng = random.Random(5)
    words = "the of and report nation region with over under river stone light house".split()
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, "12 34 !!"), row(None, "a row without an id"), row(6, "null source", source=None), row(7, "null lang", lang=None),
        row(8, "x" * 60_000), row(9, "long " * 30_000), row(10, "Ünïcödé ßtraße 日本語 \U0001f600 " * 20), row(11, "mail me at a.b@example.com or +1 (555) 010-2345, card 4111 1111 1111 1111, host 10.0.0.1"),
    ]
    rows += [row(12, "the same row"), row(12, "the same row"), row(13, "THE SAME row")]
    for i in range(20, 60):
        rows.append(row(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 120))), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"])))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
