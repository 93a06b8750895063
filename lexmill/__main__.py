"""Command line: crawl, ingest, index, search, explain, feedback, evaluate, pool."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import MOST_PAGES, SMOKE_TERMS, START_URLS
from .operators import evaluation, ingest, pages, pooling, search, session
from .operators.index import Index, build_index, lookup
from .sources import files


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexmill")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="a table of fetched pages (url, html) to a corpus of JSON lines")
    c.add_argument("--pages", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--max", type=int, default=MOST_PAGES)
    c.add_argument("--url", nargs="+", default=list(START_URLS))
    i = sub.add_parser("ingest", help="questions and answers to a corpus of JSON lines")
    i.add_argument("--questions", required=True)
    i.add_argument("--answers", required=True)
    i.add_argument("--output", required=True)
    i.add_argument("--max", type=int, default=5000, help="0: no limit")
    i.add_argument("--overwrite", action="store_true")
    b = sub.add_parser("index", help="build an index from a corpus")
    b.add_argument("--input", required=True)
    b.add_argument("--index", required=True)
    b.add_argument("--test", action="store_true", help="look up a few terms afterwards")
    for name in ("search", "explain", "feedback"):
        s = sub.add_parser(name)
        s.add_argument("--query", required=True)
        s.add_argument("--index", required=True)
        s.add_argument("--mode", choices=("bm25", "tfidf"), default="bm25")
        s.add_argument("--top", type=int, default=10)
        s.add_argument("--no-boost", action="store_true")
    e = sub.add_parser("evaluate", help="the six experiments")
    e.add_argument("--gt", required=True)
    e.add_argument("--index", required=True)
    q = sub.add_parser("pool", help="pool four systems for annotation")
    q.add_argument("--queries")
    q.add_argument("--index", help="needed for pooling")
    q.add_argument("--pool", required=True)
    q.add_argument("--seed", type=int, default=0)
    q.add_argument("--gt", help="where judgments go")
    q.add_argument("--pool-only", action="store_true", help="no labelling")
    q.add_argument("--label-only", action="store_true", help="no pooling")
    q.add_argument("--resume", action="store_true", help="go on with a labelling session, as is always done")
    return p.parse_args(argv)


def _exists(read) -> DataFrame | None:
    """What read() reads, if its path is there."""
    try:
        return read()
    except Exception as e:  # Spark's own type depends on its version
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def smoke_test(at: Index) -> DataFrame:
    """(term, found, doc_id, title, bm25): the first three documents of each of a few terms, and how many have it."""
    out = None
    for term in SMOKE_TERMS:
        rows = lookup(at, term)
        first = rows.limit(3).join(at.doc_meta, "doc_id").select(F.lit(term).alias("term"), F.lit(rows.count()).alias("found"), "doc_id", "title", "bm25")
        out = first if out is None else out.unionByName(first)
    return out.orderBy("term", F.desc("bm25"), "doc_id")


def pool(spark: SparkSession, a: argparse.Namespace, at: Index | None, ask: Callable[[str], str] = input, show: Callable[[str], None] = print) -> DataFrame | None:
    """Pool what isn't pooled yet, label what isn't labelled yet, and write judgments."""
    if not a.label_only:
        texts = files.read_queries(spark, a.queries)
        before = _exists(lambda: files.read_pool(spark, a.pool))
        new = texts if before is None else texts.join(before.select("query").distinct(), "query", "left_anti")
        if not new.isEmpty():
            runs = pooling.system_runs(new, at, failed=lambda name, e: show(f"Warning: {name} failed: {e}"))
            files.write_pool(pooling.build_pool(runs, seed=a.seed), new, a.pool, append=before is not None)
    if not a.pool_only:
        if not session.annotate(spark, a.pool, ask, show):
            show("Progress saved. Run again to continue.")
        if a.gt:
            pooling.to_qrels(session.labelled_pool(spark, a.pool), "query").write.mode("overwrite").json(a.gt)
    return None


def run(spark: SparkSession, a: argparse.Namespace, ask: Callable[[str], str] = input, show: Callable[[str], None] = print) -> DataFrame | None:
    """Run a command; searches and evaluations return a table to show."""
    if a.command == "crawl":
        found = pages.crawl(spark.read.parquet(a.pages), a.url, most=a.max)
        docs = found.select("id", "source", "url", "title", "prose_text", "code_text", F.lit(0).cast("long").alias("score"), F.lit(False).alias("is_accepted"))
        files.write_corpus(docs, a.output)
        return None
    if a.command == "ingest":
        before = None if a.overwrite else _exists(lambda: files.read_corpus(spark, a.output))
        docs = ingest.ingest_qa(files.read_questions(spark, a.questions), files.read_answers(spark, a.answers), a.max or None, 0 if before is None else files.next_id(before))
        files.write_corpus(docs, a.output, append=not a.overwrite)
        return None
    if a.command == "index":
        build_index(files.read_corpus(spark, a.input)).write(a.index)
        return smoke_test(Index.read(spark, a.index)) if a.test else None
    if a.command == "pool" and a.label_only:
        return pool(spark, a, None, ask, show)
    at = Index.read(spark, a.index)
    if a.command == "feedback":
        found = session.search_session(a.query, at, ask, show, a.mode, a.top, not a.no_boost)
        return found.orderBy("rank").select("rank", "source", "is_accepted", "title", "final_score")
    if a.command in ("search", "explain"):
        text = spark.createDataFrame([(0, a.query)], "query_id long, query string")
        found = search.search(text, at, a.mode, a.top, boost=a.command == "search" and not a.no_boost)
        if a.command == "explain":
            found = search.explain(found, search.query_terms(text)).orderBy(F.desc("final_score"), "doc_id")
            return found.select("doc_id", "title", "raw_score", "accepted_factor", "docs_factor", "vote_bonus", "title_hits", "title_bonus", "final_score")
        return search.display_order(found).orderBy("shown").select("shown", "rank", "doc_id", "title", "url", "final_score", "raw_score", "votes", "is_accepted", "source", "snippet")
    if a.command == "evaluate":
        qrels = files.read_qrels(spark, a.gt).withColumn("query_id", F.xxhash64("query"))
        return evaluation.run_experiments(qrels.select("query_id", "query").distinct(), qrels.select("query_id", "doc_id"), at)
    return pool(spark, a, at, ask, show)


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    shown = run(spark, _arguments(argv))
    if shown is not None:
        shown.show(1000, truncate=60)


if __name__ == "__main__":
    main()
