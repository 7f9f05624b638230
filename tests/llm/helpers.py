"""Small tables with odd rows."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, texts, sources=None, langs=None, ids=None):
    n = len(texts)
    rows = list(zip(ids or range(n), texts, langs or ["en"] * n, sources or ["a"] * n, [len(t or "") for t in texts], strict=True))
    return spark.createDataFrame(rows, DOCS)


#: Names that operators use inside, as columns of the input.
CLASHES = ("size", "source_size", "target", "taken", "kept", "spans", "ids", "fingerprint", "component_id", "_row", "fp", "node", "component", "low", "high", "word", "n", "license", "path", "term", "cid", "band", "value", "first", "base", "score", "rare", "_uid", "_text", "_lang")


def crowded(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHES})
