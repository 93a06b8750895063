"""Mixing sources to target weights by hash thresholds: histograms of tokens, nested budgets, no sort of documents.

Every document has a 60-bit hash of its id and text. Tokens are summed by source and the leading 12 bits of the hash; a
running sum over these at most 4096 sums a source finds the bucket in which the source's budget ends. Only the documents
of that one bucket are summed anew by the next 12 bits, and so on, until the budget ends at a single hash value. What the
mix takes is then a comparison of each document's hash with its source's threshold. Sources are a table, too, of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, numbered, small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
BITS, LEVELS = 12, 5


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def row_hash(id_col: str, text: str) -> Column:
    """60 bits of the MD5 of id and text; rows that repeat both share one."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def budgets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, n, target) from (source, n): shares of `share` times all tokens by weight, at most `most` times the source's size.

    Sources come in the order of their code points, null last; weights repeat. What a full source can't take is
    shared anew by weight among the others until none is above its limit; each time is one sum over the sources.
    """
    ranked = numbered(by_source, [F.col("source").asc_nulls_last()], "k")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("k", F.lit(len(weights))) + 1).cast("int"))
    d = cut(ranked.select("source", "n", weight.alias("weight")))
    pool, level, before = share * (d.agg(F.sum("n")).first()[0] or 0), None, -1
    while True:
        full = F.lit(False) if level is None else F.lit(level[0]) * F.col("weight") / F.lit(level[1]) > most * F.col("n")
        at = d.agg(F.sum(F.when(full, most * F.col("n"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if at[2] == before or at[1] is None:  # no further source is full, or all are
            break
        level, before = (float(pool - (at[0] or 0)), float(at[1])), at[2]
    own = most * F.col("n").cast("double")
    target = own if level is None or at[1] is None else F.when(full, own).otherwise(F.lit(level[0]) * F.col("weight") / F.lit(level[1]))
    return d.select("source", "n", target.alias("target"))


def thresholds(d: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """(source, n, target, copies, threshold, on_it), cut, from documents (source, size, hash).

    A source's documents are taken `copies` times, and once more those whose hash is below the threshold, or on it if so
    marked.
    """
    n = F.col("n")
    plan = budgets(d.groupBy("source").agg(F.sum("size").alias("n")), weights, share, most)
    copies = F.when(n > 0, F.floor(F.col("target") / n)).otherwise(0).cast("long")
    plan = cut(plan.withColumn("copies", copies).withColumn("rest", F.when(n > 0, F.col("target") - F.col("copies") * n).otherwise(0.0)))
    open_ = plan.where("rest > 0").select("source", F.lit(0).cast("long").alias("prefix"), "rest")
    inside, settled = d, None
    for level in range(1, LEVELS + 1):
        drop = BITS * (LEVELS - level)
        if level > 1:  # the bucket where the budget ends is part of the key, so that a hot source's documents are spread
            now = F.broadcast(open_) if small(open_, 128) else open_
            inside = inside.join(now.select(F.col("source").alias("__source"), "prefix"), F.col("source").eqNullSafe(F.col("__source")) & (F.shiftright("hash", drop + BITS) == F.col("prefix"))).select("source", "size", "hash")
        sums = inside.groupBy("source", F.shiftright("hash", drop).alias("bucket")).agg(F.sum("size").alias("s"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        met = sums.join(open_.select(F.col("source").alias("__source"), "rest"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        run = Window.partitionBy("source").orderBy("bucket")
        found = cut(met.withColumn("upto", F.sum("s").over(run)).where("upto > rest").withColumn("k", F.row_number().over(run)).where("k = 1"))
        before = F.col("upto") - F.col("s")
        ended = found.where("low = high").select("source", F.col("high").alias("threshold"), (before + F.col("s") / 2 <= F.col("rest")).alias("on_it"))
        settled = ended if settled is None else settled.unionByName(ended)
        open_ = found.where("low != high").select("source", F.col("bucket").alias("prefix"), (F.col("rest") - before).alias("rest"))
        if open_.isEmpty():
            break
    joined = plan.join(settled.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    every = F.when(F.col("rest") > 0, F.lit(1 << 60)).otherwise(0)  # a budget that isn't reached takes every document
    return cut(joined.select("source", "n", "target", "copies", F.coalesce("threshold", every).alias("threshold"), F.coalesce("on_it", F.lit(False)).alias("on_it")))


def _times(rows: DataFrame, source: str, plan: DataFrame, hash_: Column) -> DataFrame:
    """rows with __n, __target and __times of their source's plan. The plan is broadcast if it is small by count."""
    p = plan.select(F.col("source").alias("__source"), F.col("n").alias("__n"), F.col("target").alias("__target"), F.col("copies").alias("__copies"), F.col("threshold").alias("__threshold"), F.col("on_it").alias("__on_it"))
    p = F.broadcast(p) if small(p, 256) else p
    extra = (hash_ < F.col("__threshold")) | ((hash_ == F.col("__threshold")) & F.col("__on_it"))
    return rows.join(p, rows[source].eqNullSafe(F.col("__source"))).withColumn("__times", F.col("__copies") + extra.cast("long")).drop("__source", "__copies", "__threshold", "__on_it")


def _documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), row_hash(id_col, text_col).alias("hash")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size is the count of words of the whole text (null: 0). A source whose target is q whole sizes and a remainder has
    every document q times, and once more those whose hash lies under the threshold; the document at the threshold is
    in if that brings the sum closer. Rows that repeat id and text share a hash and are in or out together; ids alone may
    repeat or be null. Ids and texts alone decide, so reruns agree whatever the partitions. A source of no words takes
    none. Any number of sources. No rows in, no rows out.
    """
    d = _documents(docs, id_col, text_col, source_col)
    got = _times(d, "source", thresholds(d, weights, share, most), F.col("hash"))
    return got.select("doc_id", "size", F.col("__n").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__times")).alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it: 0, 1 or 2 times by default. Rows of no words are taken once, as they cost nothing."""
    d = _documents(docs, id_col, text_col, source_col)
    got = _times(docs, source_col, thresholds(d, WEIGHTS, SHARE, MOST), row_hash(id_col, text_col))
    times = F.when(words(text_col) == 0, F.lit(1).cast("long")).otherwise(F.col("__times"))
    n = free_name(docs, "__copy")
    return got.withColumn("__times", times).where("__times > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "__times")).alias(n)).drop(n)
