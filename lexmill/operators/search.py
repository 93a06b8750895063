"""Search: batches of weighted query vectors against the postings, top k by windows, boosts and re-ranking.

A query's identity is its text's id; ties in score, rounded to nine places, go to the smaller document id, so results
don't depend on the order in which sums are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ACCEPTED_FACTOR, OFFICIAL_FACTOR, OFFICIAL_SOURCES, OVERFETCH, TITLE_BONUS, VOTE_WEIGHT
from ..functions.text import code_words, prose_words, title_words
from .batches import top_candidates
from .index import Index, stemmed

#: A batch of more terms, counted by query, is scored in blocks instead of by a join of its terms with the postings.
MOST_JOINED = 20_000
FLAGS = {"accepted": True, "docs": True, "votes": True, "title": True}


def query_terms(queries: DataFrame, stem: bool = True, stop: bool = True, text: str = "query") -> DataFrame:
    """(query_id, term): prose terms and code terms of the same text, once each."""
    code = queries.select("query_id", F.explode(F.array_distinct(code_words(F.col(text)))).alias("term"))
    prose = queries.select("query_id", F.explode(F.array_distinct(prose_words(F.col(text), stop))).alias("term"))
    return (stemmed(prose) if stem else prose).unionByName(code).distinct()


def query_vectors(queries: DataFrame, stem: bool = True, stop: bool = True) -> DataFrame:
    """(query_id, term, weight), every weight 1."""
    return query_terms(queries, stem, stop).withColumn("weight", F.lit(1.0))


def rounded(score: Column) -> Column:
    return F.round(score, 9)


def top(scored: DataFrame, score: str, k: int, rank: str = "rank", then: str = "doc_id") -> DataFrame:
    """The k best of each query, ranked."""
    order = Window.partitionBy("query_id").orderBy(F.desc(rounded(F.col(score))), then)
    return scored.withColumn(rank, F.row_number().over(order).cast("long")).where(F.col(rank) <= k)


def raw_scores(vectors: DataFrame, postings: DataFrame, mode: str = "bm25") -> DataFrame:
    """(query_id, doc_id, raw_score): sums of weight times posting, of terms whose weight is above 0.

    A document of which every posting is 0 is still a candidate. Sums are combined before the shuffle by document.
    """
    column = "bm25" if mode == "bm25" else "tf_idf"
    met = postings.select("term", "doc_id", F.col(column).alias("s")).join(vectors.where("weight > 0"), "term")
    return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("s")).alias("raw_score"))


def first_candidates(vectors: DataFrame, index: Index, mode: str, k: int, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, raw_score): the k best of each query, of equal ones those with the least document ids.

    A join with the postings makes a row for each pair of a query and a document that share a term, which grows with
    both tables; large batches go another way, to the same rows.
    """
    if vectors.limit(MOST_JOINED + 1).count() <= MOST_JOINED:
        postings = index.postings if terms is None else index.of_terms(terms)
        return top(raw_scores(vectors, postings, mode), "raw_score", k, "raw_rank").drop("raw_rank")
    stats = index.corpus_stats.first()

    def postings(terms: DataFrame) -> DataFrame:
        rows = index.postings if index.score_only is None else index.score_only(terms)
        return rows.select("term", "doc_id", F.col("bm25" if mode == "bm25" else "tf_idf").alias("s"))

    return top_candidates(vectors.where("weight > 0"), postings, stats["n_docs"], round(stats["n_docs"] * (stats["avgdl"] or 0)), k)


def engine_boost(raw: Column, accepted: Column, source: Column, votes: Column) -> Column:
    s = raw * F.when(accepted, ACCEPTED_FACTOR).otherwise(1.0)
    s = s * F.when(source.isin(*OFFICIAL_SOURCES), OFFICIAL_FACTOR).otherwise(1.0)
    return s + F.when(votes > 0, VOTE_WEIGHT * F.log1p(votes.cast("double"))).otherwise(0.0)


def score_vectors(vectors: DataFrame, index: Index, mode: str = "bm25", top_k: int = 10, boost: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, title, url, snippet, final_score, raw_score, is_accepted, votes, source).

    Three times top_k candidates by raw score meet their metadata, so a boost can lift a document by that much only.
    A candidate without metadata is dropped. terms: a table that has all terms of the vectors and costs little to
    compute; those of a small batch are pushed to the scan of postings.
    """
    met = first_candidates(vectors, index, mode, OVERFETCH * top_k, terms).join(index.doc_meta, "doc_id")
    votes = F.coalesce("score", F.lit(0))
    final = engine_boost(F.col("raw_score"), F.coalesce("is_accepted", F.lit(False)), F.coalesce("source", F.lit("")), votes) if boost else F.col("raw_score")
    title = F.when(F.coalesce("title", F.lit("")) == "", "(no title)").otherwise(F.col("title"))
    rows = met.select("query_id", "doc_id", title.alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("snippet", F.lit("")).alias("snippet"), final.alias("final_score"), "raw_score", F.coalesce("is_accepted", F.lit(False)).alias("is_accepted"), votes.alias("votes"), F.coalesce("source", F.lit("")).alias("source"))
    return top(rows, "final_score", top_k)


def search(queries: DataFrame, index: Index, mode: str = "bm25", top_k: int = 10, boost: bool = True, stem: bool = True, stop: bool = True) -> DataFrame:
    vectors = query_vectors(queries, stem, stop)
    return score_vectors(vectors, index, mode, top_k, boost, vectors)


def components(terms: Column, flags: dict[str, bool] | None = None) -> dict[str, Column]:
    """What re-ranking adds to raw_score: two factors, two bonuses, and the number of query terms in the title."""
    on = FLAGS | (flags or {})
    hits = F.size(F.array_intersect(F.coalesce(terms, F.array().cast("array<string>")), title_words(F.col("title"))))
    one, none = F.lit(1.0), F.lit(0.0)
    return {
        "accepted_factor": F.when(F.col("is_accepted"), ACCEPTED_FACTOR).otherwise(1.0) if on["accepted"] else one,
        "docs_factor": F.when(F.col("source").isin(*OFFICIAL_SOURCES), OFFICIAL_FACTOR).otherwise(1.0) if on["docs"] else one,
        "vote_bonus": F.when(F.col("votes") > 0, VOTE_WEIGHT * F.log1p(F.col("votes").cast("double"))).otherwise(0.0) if on["votes"] else none,
        "title_hits": hits.cast("long"),
        "title_bonus": TITLE_BONUS * hits.cast("double") if on["title"] else none,
    }


def explain(results: DataFrame, terms: DataFrame, flags: dict[str, bool] | None = None) -> DataFrame:
    """results with every component of the re-ranked score. terms: (query_id, term)."""
    lists = terms.groupBy("query_id").agg(F.collect_set("term").alias("__terms"))
    out = results.drop("rank").join(lists, "query_id", "left").withColumns(components(F.col("__terms"), flags)).drop("__terms")
    return out.withColumn("final_score", F.col("raw_score") * F.col("accepted_factor") * F.col("docs_factor") + F.col("vote_bonus") + F.col("title_bonus"))


def rerank(results: DataFrame, terms: DataFrame, flags: dict[str, bool] | None = None) -> DataFrame:
    """results anew by metadata and title, from raw_score; ties keep the order by document id."""
    scored = explain(results, terms, flags).select([c for c in results.columns if c != "rank"])
    order = Window.partitionBy("query_id").orderBy(F.desc(rounded(F.col("final_score"))), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).select(results.columns)


def display_order(results: DataFrame) -> DataFrame:
    """results with `shown`: official documentation first, then by score."""
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("source").isin(*OFFICIAL_SOURCES), 0).otherwise(1), F.desc(rounded(F.col("final_score"))), "doc_id")
    return results.withColumn("shown", F.row_number().over(order).cast("long"))
