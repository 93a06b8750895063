"""Times of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The index is built and written once, which is one of the figures, and searches read it. Each query is run in full into
Spark's no-op sink. `value` is the sum. A first small run compiles and warms up.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import evaluation, feedback, index, pooling, search
from lexmill.plans import queries as library

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config(map=conf).getOrCreate()


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def headline(spark: SparkSession, sf_dir: str, folder: str) -> dict:
    """Functions without arguments, by name, in order; the first writes the index that the others read."""
    corpus = library.corpus(spark, sf_dir)
    texts = library.batch(spark, sf_dir)

    def at() -> index.Index:
        return index.Index.read(spark, folder)

    def terms() -> DataFrame:
        return search.query_terms(texts, stem=False)

    def vectors() -> DataFrame:
        return terms().withColumn("weight", F.lit(1.0))

    return {
        "index_build": lambda: index.build_index(corpus, stem=False).write(folder, 16),
        "index_build_stemmed": lambda: run(index.build_index(corpus, stem=True).postings),
        "search_bm25": lambda: run(search.search(texts, at(), "bm25", 10, False, stem=False)),
        "search_tfidf": lambda: run(search.search(texts, at(), "tfidf", 10, False, stem=False)),
        "search_bm25_boosted": lambda: run(search.search(texts, at(), "bm25", 10, True, stem=False)),
        "rerank_top20": lambda: run(search.rerank(search.score_vectors(vectors(), at(), "bm25", 20, boost=False), terms())),
        "rocchio_top10": lambda: run(feedback.pseudo_feedback(vectors(), terms(), at(), 10)),
        "pool_four_systems": lambda: run(pooling.build_pool(pooling.system_runs(texts, at(), stem=False))),
        "experiments": lambda: run(evaluation.run_experiments(texts, library.known_items(spark, sf_dir), at(), stem=False)),
        "page_extract": lambda: run(library.page_extract(spark, sf_dir)),
        "url_filter": lambda: run(library.url_filter(spark, sf_dir)),
        "index_snippet": lambda: run(library.index_snippet(spark, sf_dir)),
    }


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    took: dict[str, float] = {}
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    try:
        if os.path.isdir(small):
            for f in headline(spark, small, f"{folder}/small").values():
                f()
        for name, f in headline(spark, SF_DIR, f"{folder}/index").items():
            began = time.perf_counter()
            f()
            took[name] = round(time.perf_counter() - began, 3)
            print(name, took[name], file=sys.stderr)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
