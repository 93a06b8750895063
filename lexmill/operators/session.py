"""Sessions with a reader: labelling a pool, and searching with relevance feedback.

What a reader is shown is a page of text at a time, so these run on the driver; what is searched and scored does not.
`ask` puts a question and returns the answer, `show` shows a line: input and print at a terminal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEEDBACK_ROUNDS
from ..functions.text import mark_terms, window_of
from ..sources import files
from .feedback import feedback_loop
from .index import Index
from .pooling import apply_labels
from .search import display_order, query_terms

_BADGES = {"python_docs": "[PYDO]", "mdn": "[MDN ]"}


def labelled_pool(spark: SparkSession, path: str) -> DataFrame:
    """The pool at path with the labels beside it."""
    return apply_labels(files.read_pool(spark, path), files.read_labels(spark, path), "query")


def annotate(spark: SparkSession, path: str, ask: Callable[[str], str], show: Callable[[str], None] = print) -> bool:
    """Ask y(es), n(o), s(kip) or q(uit) for each document of the pool that has no label; whether the reader went through it.

    Labels are saved after each query, beside the pool, so that a session goes on where the last one ended.
    """
    pool = labelled_pool(spark, path).where("relevant is null").drop("relevant")
    for query in [r["query"] for r in pool.select("query").distinct().orderBy("query").collect()]:
        docs = pool.where(F.col("query") == query).orderBy("position").collect()
        show(f'Query: "{query}", {len(docs)} documents to label')
        labels, quit_ = [], False
        for d in docs:
            show(f"  Title   : {d['title']}\n  URL     : {d['url']}\n  Snippet : {(d['snippet'] or '')[:200]}...")
            while (answer := ask("  Relevant? [y/n/s/q] ").strip().lower()) not in ("y", "n", "s", "q"):
                show("  Please enter y, n, s, or q")
            if answer == "q":
                quit_ = True
                break
            if answer != "s":
                labels.append((query, d["doc_id"], answer == "y"))
        if labels:
            files.add_labels(spark, labels, path)
        if quit_:
            return False
    return True


def search_session(query: str, index: Index, ask: Callable[[str], str], show: Callable[[str], None] = print, mode: str = "bm25", top_k: int = 10, boost: bool = True, rounds: int = FEEDBACK_ROUNDS, stem: bool = True) -> DataFrame:
    """Search, ask r(elevant), n(ot), s(kip) or q(uit) for each result, refine, and so on; the results after the last round.

    Results are shown in display order. A round without any judgment ends the session.
    """
    spark = index.postings.sparkSession
    text = spark.createDataFrame([(0, query)], "query_id long, query string")
    terms = [r["term"] for r in query_terms(text, stem).orderBy("term").collect()]

    def judge(results: DataFrame, k: int) -> DataFrame:
        show("Re-ranked" if k else f'Results for: "{query}"')
        given = []
        for n, r in enumerate(display_order(results).orderBy("shown").collect(), 1):
            show(f"#{n} {_BADGES.get(r['source'], '[SO  ]')} {r['title']}{' (accepted)' if r['is_accepted'] else ''}\n{r['url']}\nScore: {r['final_score']:.4f}  Raw: {r['raw_score']:.4f}  Votes: {r['votes']}")
            show(mark_terms(window_of(r["snippet"], terms), terms))
            answer = ask("[r]elevant / [n]ot-relevant / [s]kip / [q]uit: ").strip().lower()
            if answer == "q":
                break
            if answer in ("r", "n"):
                given.append((0, r["doc_id"], answer == "r"))
        return spark.createDataFrame(given, "query_id long, doc_id long, relevant boolean")

    return feedback_loop(text, index, judge, rounds, mode, top_k, boost, stem)
