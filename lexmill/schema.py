"""Schema of a corpus."""

from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("prose_text", T.StringType()),
    T.StructField("code_text", T.StringType()), T.StructField("score", T.LongType()),
    T.StructField("is_accepted", T.BooleanType()), T.StructField("snippet", T.StringType()),
])
