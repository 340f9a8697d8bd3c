"""Small documents with nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("rank", T.StringType()), T.StructField("score", T.StringType()), T.StructField("node", T.StringType()), T.StructField("kept", T.StringType()),
])

LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(4000))
TEXTS = [
    (1, "The cat sat on the mat and the dog ran to the house of the old man by the sea."),
    (2, "The cat sat on the mat and the dog ran to the house of the old man by the sea."),
    (3, "THE cat sat on the mat and the dog ran to the house of the old man by the sea."),
    (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one"), (9, "two words"), (None, "The cat sat on the mat and the dog ran to the house of the old man by the sea."),
    (10, LONG), (11, LONG + " end"), (12, "12 34 !! 56"), (13, "日本語 のテキスト です"), (14, "a<|endoftext|>b don't"), (1, "The cat sat on the mat and the dog ran to the house of the old man by the sea."), (None, None),
]


def odd_documents(spark):
    rows = [(i, t, "en" if t else None, "src", len(t or ""), "x", "y", "z", "w") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
