"""Judgments and metrics: precision at k, reciprocal rank, two forms of NDCG, and the six experiments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EVAL_DEPTH
from ..functions.durable import broadcast_if_small, cut
from .feedback import rocchio
from .index import Index
from .search import query_terms, rerank, score_vectors

METRICS = ("p5", "p10", "mrr", "ndcg_ref", "ndcg_std")


def discount(first: int, last: int) -> float:
    return sum(1 / math.log2(i + 1) for i in range(first, last + 1))


def ndcg_reference(hits: Column, early: Column, k: int = 10) -> Column:
    """NDCG with the ideal list as truth and binary relevance as score, ties averaged, in closed form.

    hits: relevant among the first k; early: relevant among the first `hits`. Relevance being the score, the hits are one
    tie and the rest another: each place of the first `hits` gets the mean of the truth that falls on the tie.
    """
    sums = F.array(*(F.lit(discount(1, m)) for m in range(k + 1)))
    at = F.element_at(sums, (hits + 1).cast("int"))
    c, m = early.cast("double"), hits.cast("double")
    rest = F.when(hits < k, (m - c) / F.when(hits < k, k - m) * (discount(1, k) - at)).otherwise(0.0)
    return F.when(hits > 0, (c / F.when(hits > 0, m) * at + rest) / F.when(hits > 0, at)).otherwise(0.0)


def containing(docs: DataFrame, queries: DataFrame, width: int = 3) -> DataFrame:
    """(query_id, doc_id): documents (doc_id, text) that contain a query's text (query_id, query), as known items.

    A query's words but the first and the last are whole words of any text that contains it. Its longest run of `width`
    of these is its key; documents meet it under the key, by an equi-join, and are then searched for the whole query.
    Queries too short for a key are searched for in all documents, in one pass. Null and empty queries are contained
    nowhere.
    """
    queries = queries.where("query is not null and query != ''")
    inner = F.split("query", r"\s+")
    keyed = cut(queries.withColumn("__runs", _runs(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))), width)).withColumn("__key", F.array_max(F.transform("__runs", lambda x: F.struct(F.length(x), x.alias("k"))))["k"]).drop("__runs"))
    keys = broadcast_if_small(keyed.where("__key is not null"), 1024)
    met = docs.select("doc_id", "text", F.explode(F.array_distinct(_runs(F.split("text", r"\s+"), width))).alias("__key")).join(keys, "__key")
    found = met.where(F.contains("text", "query")).select("query_id", "doc_id")
    short = keyed.where("__key is null").drop("__key")
    if not short.isEmpty():
        found = found.unionByName(docs.join(broadcast_if_small(short, 256), F.contains("text", "query")).select("query_id", "doc_id"))
    return found


def _runs(words: Column, width: int) -> Column:
    """All runs of `width` words, joined by spaces. The words are bound once, as a variable: a lambda would split anew for each run."""

    def runs(w: Column) -> Column:
        n = F.size(w) - width
        every = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(w, i + 1, F.lit(width))))
        return F.when(n >= 0, every).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(words), runs))


def metrics_per_query(results: DataFrame, qrels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., query_id, p5, p10, mrr, ndcg_ref, ndcg_std): one row per judged query, 0 without results.

    results: (by..., query_id, rank, doc_id); qrels: (query_id, doc_id), the relevant ones. Ranks beyond EVAL_DEPTH are
    ignored. Precision divides by k, not by the number of results.
    """
    by = by or []
    judged = qrels.select("query_id", "doc_id").distinct()
    seen = results.where(F.col("rank") <= EVAL_DEPTH).join(judged.withColumn("hit", F.lit(True)), ["query_id", "doc_id"]).groupBy(*by, "query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    every = judged.select("query_id").distinct()
    if by:
        every = every.crossJoin(results.select(*by).distinct())  # one row a system
    r = F.coalesce("ranks", F.array().cast("array<bigint>"))

    def upto(k: Column | int) -> Column:
        return F.size(F.filter(r, lambda x: x <= k))

    ten = upto(10)
    gain = F.aggregate(F.filter(r, lambda x: x <= 10), F.lit(0.0), lambda a, x: a + F.log(F.lit(2.0)) / F.log(x + 1.0))
    ideal = F.array(*(F.lit(discount(1, m)) for m in range(11)))
    return every.join(seen, [*by, "query_id"], "left").select(
        *by,
        "query_id",
        (upto(5) / 5.0).alias("p5"),
        (ten / 10.0).alias("p10"),
        F.coalesce(1.0 / F.array_min(r), F.lit(0.0)).alias("mrr"),
        ndcg_reference(ten, upto(ten)).alias("ndcg_ref"),
        F.when(ten > 0, gain / F.when(ten > 0, F.element_at(ideal, ten + 1))).otherwise(0.0).alias("ndcg_std"),
    )


def evaluate(results: DataFrame, qrels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the metrics over judged queries."""
    per = metrics_per_query(results, qrels, by)
    return per.groupBy(*(by or [])).agg(*(F.avg(m).alias(m) for m in METRICS), F.count("*").alias("n_queries"))


def oracle_rocchio(queries: DataFrame, qrels: DataFrame, index: Index, top_k: int = EVAL_DEPTH, stem: bool = True, stop: bool = True, baseline: DataFrame | None = None) -> DataFrame:
    """Feedback from the judgments themselves, an upper bound: relevant ones among the baseline refine the query.

    A query without any keeps its baseline, not re-ranked.
    """
    terms = cut(query_terms(queries, stem, stop))
    vectors = terms.withColumn("weight", F.lit(1.0))
    baseline = cut(score_vectors(vectors, index, "bm25", top_k, boost=False, terms=terms)) if baseline is None else baseline
    found = cut(baseline.select("query_id", "doc_id").join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).withColumn("relevant", F.lit(True)))
    lucky = found.select("query_id").distinct()
    refined = cut(rocchio(vectors.join(lucky, "query_id", "left_semi"), found, index))
    again = rerank(score_vectors(refined, index, "bm25", top_k, boost=False, terms=refined), terms)
    return again.unionByName(baseline.join(lucky, "query_id", "left_anti"))


def run_experiments(queries: DataFrame, qrels: DataFrame, index: Index, stem: bool = True, stop: bool = True) -> DataFrame:
    """(experiment, p5, p10, mrr, ndcg_ref, ndcg_std, n_queries): the six rows, three of them one computation."""
    terms = cut(query_terms(queries, stem, stop))
    vectors = terms.withColumn("weight", F.lit(1.0))
    columns = ["query_id", "rank", "doc_id"]
    baseline = cut(score_vectors(vectors, index, "bm25", EVAL_DEPTH, boost=False, terms=terms))  # a few rows a query, used in three rows
    tfidf = rerank(score_vectors(vectors, index, "tfidf", EVAL_DEPTH, boost=False, terms=terms), terms)
    qrels = cut(qrels.select("query_id", "doc_id").distinct())
    runs = {"TF-IDF": tfidf, "BM25": rerank(baseline, terms), "No metadata boost": baseline, "After Rocchio feedback": oracle_rocchio(queries, qrels, index, EVAL_DEPTH, stem, stop, baseline)}
    every = None
    for name, rows in runs.items():
        rows = rows.select(F.lit(name).alias("experiment"), *columns)
        every = rows if every is None else every.unionByName(rows)
    out = evaluate(every, qrels, ["experiment"])
    names = F.when(F.col("experiment") == "BM25", F.array(*map(F.lit, ("BM25", "Metadata boost", "Baseline (pre-Rocchio)")))).otherwise(F.array("experiment"))
    return out.withColumn("experiment", F.explode(names))


def markdown_table(metrics: DataFrame) -> DataFrame:
    """(experiment, line): each row as a line of a Markdown table."""
    return metrics.select("experiment", F.format_string("| %-35s | %6.3f | %6.3f | %6.3f | %8.3f |", "experiment", "p5", "p10", "mrr", "ndcg_ref").alias("line"))
