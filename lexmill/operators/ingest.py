"""Questions and answers to corpus documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import body_parts
from ..functions.text import snippet
from .pages import with_dense_ids

_SITE = "https://stackoverflow.com/questions/"


def question_documents(questions: DataFrame) -> DataFrame:
    """Questions with a title and prose. Missing strings count as empty."""
    q = questions.withColumn("p", body_parts(F.col("Body"))).withColumn("title", F.trim(F.coalesce("Title", F.lit(""))))
    q = q.where((F.col("title") != "") & (F.col("p.prose") != ""))
    return q.select(F.lit(0).alias("kind"), F.col("Id").alias("key"), F.lit("stackoverflow").alias("source"), F.concat(F.lit(_SITE), F.col("Id").cast("string")).alias("url"), "title", F.col("p.prose").alias("prose_text"), F.col("p.code").alias("code_text"), F.coalesce("Score", F.lit(0)).cast("long").alias("score"), F.lit(False).alias("is_accepted"))


def answer_documents(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with prose, titled after their question, marked if a question accepts them."""
    titles = questions.groupBy("Id").agg(F.max("Title").alias("q_title")).select(F.col("Id").alias("ParentId"), "q_title")
    accepted = questions.where("AcceptedAnswerId is not null").select(F.col("AcceptedAnswerId").alias("Id")).distinct().withColumn("ok", F.lit(True))
    a = answers.withColumn("p", body_parts(F.col("Body"))).where(F.col("p.prose") != "").join(titles, "ParentId", "left").join(accepted, "Id", "left")
    parent = F.col("ParentId").cast("string")
    title = F.when(F.coalesce("q_title", F.lit("")) != "", F.concat(F.lit("Answer: "), F.col("q_title"))).otherwise(F.concat(F.lit("Answer to question "), parent))
    return a.select(F.lit(1).alias("kind"), F.col("Id").alias("key"), F.lit("stackoverflow").alias("source"), F.concat(F.lit(_SITE), parent, F.lit("#"), F.col("Id").cast("string")).alias("url"), title.alias("title"), F.col("p.prose").alias("prose_text"), F.col("p.code").alias("code_text"), F.coalesce("Score", F.lit(0)).cast("long").alias("score"), F.coalesce("ok", F.lit(False)).alias("is_accepted"))


def ingest_qa(questions: DataFrame, answers: DataFrame, max_docs: int | None = 5000, start_id: int = 0) -> DataFrame:
    """Corpus documents with dense ids from start_id: questions before answers, by their own ids, at most max_docs."""
    if "AcceptedAnswerId" not in questions.columns:
        questions = questions.withColumn("AcceptedAnswerId", F.lit(None).cast("long"))
    docs = question_documents(questions).unionByName(answer_documents(answers, questions))
    docs = docs.orderBy("kind", "key").limit(max_docs) if max_docs else docs
    out = with_dense_ids(docs, ["kind", "key"], "id", start_id).drop("kind", "key")
    return out.withColumn("snippet", snippet(F.col("prose_text")))


def accepted_present(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(n): how many accepted ids occur among the answers."""
    ids = questions.where("AcceptedAnswerId is not null").select(F.col("AcceptedAnswerId").alias("Id")).distinct()
    return ids.join(answers.select("Id"), "Id", "left_semi").agg(F.count("*").alias("n"))
