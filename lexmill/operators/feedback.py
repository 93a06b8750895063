"""Relevance feedback: Rocchio vectors for whole batches of queries, pseudo-feedback and the feedback loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ALPHA, BETA, FEEDBACK_ROUNDS, GAMMA, PSEUDO_RELEVANT
from ..functions.durable import cut
from .index import Index
from .search import query_terms, rerank, score_vectors


def rocchio(vectors: DataFrame, judgments: DataFrame, index: Index, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """(query_id, term, weight): alpha * query + beta * mean of relevant - gamma * mean of other judged documents.

    judgments: (query_id, doc_id, relevant). Document vectors are TF-IDF whatever the search mode. A mean is over all
    judged ids, those without postings included. Only weights above 0 stay. The aligned vectors are one signed union,
    summed, in place of outer joins.
    """
    judged = cut(judgments.where("relevant is not null").select("query_id", "doc_id", "relevant").distinct())
    counts = judged.groupBy("query_id", "relevant").agg(F.count("*").alias("n"))
    share = F.when(F.col("relevant"), beta).otherwise(-gamma) / F.col("n")
    signed = judged.join(counts, ["query_id", "relevant"]).select("query_id", "doc_id", share.alias("share"))
    from_docs = index.of_documents(judged.select("doc_id")).select("term", "doc_id", "tf_idf").join(signed, "doc_id").select("query_id", "term", (F.col("share") * F.col("tf_idf")).alias("weight"))
    own = vectors.select("query_id", "term", (alpha * F.col("weight")).alias("weight"))
    return own.unionByName(from_docs).groupBy("query_id", "term").agg(F.sum("weight").alias("weight")).where("weight > 0")


def pseudo_judgments(results: DataFrame, first: int = PSEUDO_RELEVANT) -> DataFrame:
    return results.where(F.col("rank") <= first).select("query_id", "doc_id", F.lit(True).alias("relevant"))


def pseudo_feedback(vectors: DataFrame, terms: DataFrame, index: Index, top_k: int, mode: str = "bm25", baseline: DataFrame | None = None) -> DataFrame:
    """Results of the vectors refined by their own first results (baseline, if it is known), re-ranked."""
    baseline = cut(score_vectors(vectors, index, mode, top_k, boost=False)) if baseline is None else baseline
    refined = cut(rocchio(vectors, pseudo_judgments(baseline), index))
    return rerank(score_vectors(refined, index, mode, top_k, boost=False, terms=refined), terms)


def feedback_loop(queries: DataFrame, index: Index, judge: Callable[[DataFrame, int], DataFrame], rounds: int = FEEDBACK_ROUNDS, mode: str = "bm25", top_k: int = 10, boost: bool = True, stem: bool = True, stop: bool = True) -> DataFrame:
    """Rounds of results, judgments and refinement; the results after the last round.

    judge(results, round) returns (query_id, doc_id, relevant) for what it judges: it stands for the reader. Judgments
    add up over rounds, each round starts from the original vector, and a query for which a round has brought none is
    at its end: it isn't shown again.
    """
    terms = cut(query_terms(queries, stem, stop))
    original = terms.withColumn("weight", F.lit(1.0))
    vectors, judgments = original, None

    def results() -> DataFrame:
        raw = score_vectors(vectors, index, mode, top_k, boost=False, terms=vectors)
        return rerank(raw, terms) if boost else raw

    for k in range(rounds):
        shown = results() if judgments is None else results().join(judgments.select("query_id").distinct(), "query_id", "left_semi")
        new = judge(shown, k).select("query_id", "doc_id", "relevant")
        judgments = cut((new if judgments is None else judgments.unionByName(new)).distinct())
        if judgments.isEmpty():
            break
        vectors = cut(rocchio(original, judgments, index))
    return results()
