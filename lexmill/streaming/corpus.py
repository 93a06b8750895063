"""Structured Streaming around the corpus: new JSON lines into the corpus table, and queries answered as they come.

Scores depend on the whole corpus (N, document frequencies, mean length), so an index is rebuilt from the appended
corpus; queries stream against a built one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import snippet
from ..operators.index import Index
from ..operators.search import search
from ..schema import CORPUS


def append_corpus(spark: SparkSession, source: str, corpus: str, checkpoint: str) -> StreamingQuery:
    """Append documents of new JSON-line files in the folder source to the Parquet table corpus, then stop.

    Each file is taken once. Rows without an id are dropped; missing texts are empty.
    """
    rows = spark.readStream.schema(CORPUS).json(source).where("id is not null")
    rows = rows.fillna("", ["prose_text", "code_text", "title"]).fillna(0, ["score"]).fillna(False, ["is_accepted"])
    rows = rows.withColumn("snippet", snippet(F.col("prose_text")))
    return rows.writeStream.format("parquet").option("path", corpus).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_queries(queries: DataFrame, index: Index, results: str, checkpoint: str, mode: str = "bm25", top_k: int = 10, boost: bool = True, stem: bool = True) -> StreamingQuery:
    """Answer a stream of (query_id, query) in micro-batches, each one batch search, and append to the Parquet table results."""

    def answer(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        search(batch, index, mode, top_k, boost, stem).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
