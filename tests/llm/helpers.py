"""Small document tables with the odd cases that every operator has to stand."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for columns of their own.
        T.StructField("score", T.StringType()),
        T.StructField("ids", T.IntegerType()),
    ]
)
LONG = "Über die Brücke of the and " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and the dog sleeps.", "en", "a", 64, "x", 1),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", 3),
    (4, " \n\t ", "de", "b", 4, "x", 4),
    (5, LONG, "de", "a", len(LONG), "x", 5),
    (6, "The quick brown fox jumps over the lazy dog, and the dog sleeps.", "en", "a", 64, "x", 6),
    (6, "The quick brown fox jumps over the lazy dog, and the dog sleeps.", "en", "a", 64, "x", 6),
    (None, "a row without an id", "en", "b", 19, None, None),
    (8, "1234 5678 !!! ###", None, "c", 17, "x", 8),
    (9, "naïve café 東京 🙂 <|endoftext|> </s> ▁▁x", "fr", "c", 40, "x", 9),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def plain(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)
