"""Pools of results from several systems, labels for them, and judgments from labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import POOL_DEPTH
from ..functions.durable import cut
from .feedback import pseudo_feedback
from .index import Index
from .search import query_terms, rerank, score_vectors

SYSTEMS = ("bm25_boosted", "bm25_baseline", "tfidf", "rocchio")


def system_runs(queries: DataFrame, index: Index, depth: int = POOL_DEPTH, stem: bool = True, stop: bool = True, failed: Callable[[str, Exception], None] | None = None) -> DataFrame:
    """(system, query_id, rank, doc_id, title, url, snippet) of the four pooled systems.

    With `failed`, each system is run by itself at once, and one that fails is reported and left out.
    """
    terms = cut(query_terms(queries, stem, stop))
    vectors = terms.withColumn("weight", F.lit(1.0))
    columns = ("query_id", "rank", "doc_id", "title", "url", "snippet")
    held: list[DataFrame] = []

    def baseline() -> DataFrame:
        if not held:  # a few rows a query, used three times
            held.append(cut(score_vectors(vectors, index, "bm25", depth, boost=False, terms=terms)))
        return held[0]

    runs = (
        lambda: rerank(baseline(), terms),
        baseline,
        lambda: score_vectors(vectors, index, "tfidf", depth, boost=False, terms=terms),
        lambda: pseudo_feedback(vectors, terms, index, depth, baseline=baseline()),
    )
    out = None
    for name, run in zip(SYSTEMS, runs, strict=True):
        try:
            rows = run().select(F.lit(name).alias("system"), *columns)
            rows = rows if failed is None else cut(rows)
        except Exception as e:
            if failed is None:
                raise
            failed(name, e)
            continue
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise RuntimeError("every system failed")
    return out


def build_pool(runs: DataFrame, known: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """(query_id, doc_id, title, url, snippet, first_system, position, relevant): each document once a query.

    The first system that has it counts. Queries in known (query_id) are left out. position is by system and rank, or
    shuffled by seed; relevant is null, to be filled.
    """
    if known is not None:
        runs = runs.join(known.select("query_id").distinct(), "query_id", "left_anti")
    order = F.array_position(F.array(*map(F.lit, SYSTEMS)), F.col("system"))
    first = runs.withColumn("o", order).withColumn("k", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("o", "rank"))).where("k = 1")
    place = [F.xxhash64("query_id", "doc_id", F.lit(seed))] if seed is not None else [F.col("o"), F.col("rank")]
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*place, "doc_id")).cast("long")
    return first.select("query_id", "doc_id", "title", "url", "snippet", F.col("system").alias("first_system"), position.alias("position"), F.lit(None).cast("boolean").alias("relevant"))


def apply_labels(pool: DataFrame, labels: DataFrame, query: str = "query_id") -> DataFrame:
    """pool with labels (query, doc_id, relevant) where there are any; a later null leaves what is there."""
    new = labels.groupBy(query, "doc_id").agg(F.max("relevant").alias("__new"))
    return pool.join(new, [query, "doc_id"], "left").withColumn("relevant", F.coalesce("__new", "relevant")).drop("__new").select(pool.columns)


def to_qrels(pool: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, relevant_doc_ids) of queries with at least one relevant document, ids in order."""
    return pool.where("relevant").groupBy(query).agg(F.sort_array(F.collect_set("doc_id")).alias("relevant_doc_ids"))
