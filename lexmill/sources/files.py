"""Files in and out: question and answer CSV, JSON lines, query lists, pools and judgments."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_QUERIES
from ..schema import CORPUS

_POOL_DOCS = "array<struct<doc_id:bigint,title:string,url:string,snippet:string,relevant:boolean>>"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=True, escape='"', mode="DROPMALFORMED", inferSchema=False)


def _typed(df: DataFrame, longs: list[str], texts: list[str]) -> DataFrame:
    """Columns by name, whatever others there are; a number that can't be read, or a missing column, is null."""
    have = set(df.columns)
    return df.select(*(F.expr(f"try_cast(try_cast(`{c}` as double) as bigint)").alias(c) if c in have else F.lit(None).cast("long").alias(c) for c in longs), *texts)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_csv(spark, path), ["Id", "Score", "AcceptedAnswerId"], ["Title", "Body"]).where("Id is not null")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_csv(spark, path), ["Id", "ParentId", "Score"], ["Body"]).where("Id is not null")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of JSON lines; blank lines are skipped, others that aren't JSON raise; missing texts are empty."""
    df = spark.read.schema(CORPUS).json(path, mode="FAILFAST")
    return df.fillna("", ["prose_text", "code_text", "title"]).fillna(0, ["score"]).fillna(False, ["is_accepted"])


def write_corpus(corpus: DataFrame, path: str, append: bool = False) -> None:
    corpus.write.mode("append" if append else "overwrite").json(path, ignoreNullFields=False)


def next_id(corpus: DataFrame) -> int:
    """The id at which an append goes on."""
    last = corpus.agg(F.max("id").alias("m")).first()["m"]
    return 0 if last is None else last + 1


def read_queries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(query_id, query): a file's non-blank lines, or the built-in set. A repeated query counts once."""
    lines = spark.createDataFrame([(q,) for q in DEFAULT_QUERIES], "query string") if path is None else spark.read.text(path).select(F.trim("value").alias("query")).where("query != ''")
    return lines.distinct().select(F.xxhash64("query").alias("query_id"), "query")


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).where("trim(value) != ''").first()
    return row["value"].strip() if row else ""


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(query, position, doc_id, title, url, snippet, relevant) of a pool.

    Either JSON lines as write_pool writes them, in any number of files, or one object keyed by query. Labels that
    add_labels has put beside it are in `relevant`.
    """
    line = spark.createDataFrame([(_first_line(spark, path),)], "value string").select(F.from_json("value", f"query string, docs {_POOL_DOCS}").alias("j"))
    if line.where("j.query is not null and j.docs is not null and not startswith(j.query, '[')").isEmpty():
        every = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {_POOL_DOCS}>")).alias("query", "docs"))
    else:
        every = spark.read.schema(f"query string, docs {_POOL_DOCS}").json(path, mode="FAILFAST")
    return every.select("query", F.posexplode("docs").alias("position", "d")).select("query", (F.col("position") + 1).cast("long").alias("position"), "d.doc_id", "d.title", "d.url", "d.snippet", "d.relevant")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id) of judgments {query, relevant_doc_ids}: JSON lines in any number of files, or one array of them."""
    lines = not _first_line(spark, path).startswith("[")
    rows = spark.read.schema("query string, relevant_doc_ids array<long>").json(path, multiLine=not lines, mode="FAILFAST")
    return rows.select("query", F.explode("relevant_doc_ids").alias("doc_id"))


def write_pool(pool: DataFrame, queries: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a query: {"query": ..., "docs": [...]}; as lines, so that no task holds the whole pool."""
    docs = F.array_sort(F.collect_list(F.struct("position", "doc_id", "title", "url", "snippet", "relevant"))).alias("docs")
    pool.join(queries, "query_id").groupBy("query").agg(docs).write.mode("append" if append else "overwrite").json(path, ignoreNullFields=False)


def write_qrels(qrels: DataFrame, queries: DataFrame, path: str) -> None:
    qrels.join(queries, "query_id").select("query", "relevant_doc_ids").write.mode("overwrite").json(path)


_LABELS = "query string, doc_id long, relevant boolean"


def add_labels(spark: SparkSession, labels: list[tuple[str, int, bool]], path: str) -> None:
    """Append an annotator's labels (query, doc_id, relevant) to those beside a pool."""
    spark.createDataFrame(labels, _LABELS).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}.labels")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id, relevant) beside a pool; none at first."""
    try:
        return spark.read.schema(_LABELS).json(f"{path.rstrip('/')}.labels")
    except Exception as e:  # Spark's own type depends on its version
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _LABELS)


def pool_file(pool: list[dict]) -> str:
    """The text of a pool file from labelled rows small enough for an annotator to read."""
    by: dict[str, list[dict]] = {}
    for row in pool:
        by.setdefault(row["query"], []).append({k: v for k, v in row.items() if k != "query"})
    return json.dumps(by, indent=2, ensure_ascii=False)
