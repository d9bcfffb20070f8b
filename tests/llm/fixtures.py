"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("Score", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("kept", T.StringType()),
                     T.StructField("id", T.StringType()), T.StructField("row", T.StringType())]
                    )


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"w{r.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts):
    """Rows for the texts; extra columns bear names that results use."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", "y", "z", "i", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward():
    """Null, empty, blank, tiny and very long texts, repeats, odd characters."""
    long = "\n".join(prose(k, 300, 5000) for k in range(120))
    return [None, "", " \n\n ", "a", prose(1, 80), prose(1, 80), prose(1, 80).upper(), long, "é" * 300,
            "x" * 900, "\U0001F600   \r\n\x1c tab\t end", prose(2, 60) + "\n" + prose(3, 60) + "\n" + prose(2, 60)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def with_null_id(spark, df):
    return df.unionByName(spark.createDataFrame([(None, "no id here at all", None, None, None, None, None, None, None, None)], DOCS))
