"""Exact deduplication, natively: frequent digests are found by Misra-Gries counters and settled at the map side.

A text's digest is SHA-256 of the text with each run of ASCII white space made one space. `approx_top_k`, whose sketch
is the Misra-Gries family of counters, proposes at most `candidates` digests; their true counts are taken, and those
that hold at least one in `candidates` rows (and 64) are the winners: a table of at most `candidates` rows, broadcast,
that settles each of their rows where it lies. No digest that is left can hold more than a few in `candidates` rows.
The rest are counted by ordinary shuffling, pre-aggregated, and only those with copies are joined back, so that no task
holds all rows of a digest however many these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, free_name, small

CANDIDATES = 1024
COUNTERS = 16384


def digest(text: str):
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: int = CANDIDATES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, of all rows and whole texts.

    Null text counts as empty; empty texts equal each other. Of equal texts the least id stays, null ids after all
    others; of rows that share text and id exactly one stays, and which is of no account as they look the same.
    Other columns of docs are not read, whatever their names. No rows in, no rows out.
    """
    d = cut(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest")).withColumn("row", F.monotonically_increasing_id()))
    proposed = d.agg(F.expr(f"approx_top_k(xxhash64(digest), {candidates}, {max(COUNTERS, candidates)})").alias("top")).select(F.explode("top.item").alias("h"))
    least = max(64, d.count() / candidates)
    true = d.join(F.broadcast(proposed), F.xxhash64("digest") == F.col("h"), "left_semi").groupBy("digest").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("least_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("least_row")
    )
    winners = true.where(F.col("n") >= least)
    marked = d.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("n is not null").select("doc_id", F.col("least_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("least_row")).alias("kept"), "digest")
    rest = marked.where("n is null").select("doc_id", "digest", "row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = cut(rest.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1"))
    met = rest.join(F.broadcast(groups) if small(groups, 96) else groups, "digest", "left")
    light = met.select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"), "digest"
    )
    return heavy.unionByName(light).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Dropped (id, digest) pairs leave at the map side when their count shows that they fit, else by a shuffled join.
    Rows that repeat both id and text, of which one stays, are the only ones whose text is shuffled for certain.
    """
    found = cut(exact_dedup(docs, id_col, text_col))
    pair = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    pair = cut(pair.where("not __kept or __n > 1"))
    pair = F.broadcast(pair) if small(pair, 128) else pair
    sha = free_name(docs, "__text_sha")
    joined = docs.withColumn(sha, F.lower(F.hex(digest(text_col)))).join(pair, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col(sha) == F.col("__sha")), "left")
    whole = joined.where("coalesce(__kept, true)").select(*docs.columns, sha, F.coalesce("__n", F.lit(1)).alias("__n"))
    once = whole.where("__n = 1").select(*docs.columns)
    again = whole.where("__n > 1").dropDuplicates([id_col, sha]).select(*docs.columns)
    return once.unionByName(again)
