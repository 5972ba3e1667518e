"""Documents that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHING = ["bucket", "node", "row", "shard", "size", "h", "key", "a.b", "__text_key", "fp", "word", "place", "r", "k"]
LONG = " ".join(f"token{i % 997} sentence{i % 13}." for i in range(30_000))
TEXTS = [
    (1, "A plain text of several words that nobody disputes at all.", "en", "web", 1),
    (1, "A plain text of several words that nobody disputes at all.", "en", "web", 1),
    (2, None, None, None, None), (None, None, None, None, None), (3, "", "en", "web", 0), (4, " \t\n ", "", "", 4),
    (None, "You are a stupid worthless idiot, you moron!", None, "forum", 3), (5, LONG, "en", "books", 9), (6, LONG, "en", "books", 9),
    (7, "Ünïcödé 漢字 🎉 text with spaces <|endoftext|> İK don't 12345 ²½", "xx", "web", 2), (7, "same id, other text", "en", None, 3),
]


def edge_docs(spark, extra=True):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    for k, name in enumerate(CLASHING if extra else []):
        docs = docs.selectExpr("*", f"{k} AS `{name}`")
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts, start=0):
    """Documents with ids from ``start`` and the given texts."""
    return spark.createDataFrame([(start + k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
