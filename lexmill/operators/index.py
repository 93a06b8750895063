"""The inverted index: postings with TF-IDF and BM25 scores, and metadata, as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import K1, TITLE_FACTOR, B
from ..functions.durable import BROADCAST_BYTES, cut, small
from ..functions.porter import stem_column
from ..functions.text import code_words, prose_words, snippet


#: What a term and its frequency take in a broadcast table.
FREQUENCY_BYTES = 96
#: As many terms or documents are pushed to the scan of postings by name.
MOST_PUSHED = 2000


@dataclass
class Index:
    """doc_meta (one row a document), postings (term, doc_id, tf_idf, bm25) and corpus_stats (n_docs, avgdl).

    postings lie by term where the index was read; postings_by_doc are the same rows by document, if there are any.
    score_only, where postings are scored on the way, scores those of a table of terms (term, ..., each once) alone.
    """

    doc_meta: DataFrame
    postings: DataFrame
    corpus_stats: DataFrame
    postings_by_doc: DataFrame | None = None
    score_only: Callable[[DataFrame], DataFrame] | None = None

    def write(self, path: str, files: int | None = None) -> None:
        """Postings twice: clustered by term for searches, by document for feedback; row groups are pruned by either.

        A term of very many documents, and a document of very many terms, extend over as many files as they need.
        """
        self.doc_meta.write.mode("overwrite").parquet(f"{path}/doc_meta")
        self.corpus_stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")
        n = [files] if files else []
        self.postings.repartitionByRange(*n, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings_by_term")
        scored = self.postings.sparkSession.read.parquet(f"{path}/postings_by_term")  # not to be scored again
        scored.repartitionByRange(*n, "doc_id", "term").sortWithinPartitions("doc_id", "term").write.mode("overwrite").parquet(f"{path}/postings_by_doc")

    @classmethod
    def read(cls, spark, path: str, by: str = "term") -> Index:
        """The index at path; by: the layout that `postings` scans."""
        meta, stats, by_term, by_doc = (spark.read.parquet(f"{path}/{t}") for t in ("doc_meta", "corpus_stats", "postings_by_term", "postings_by_doc"))
        return cls(meta, by_term if by == "term" else by_doc, stats, by_doc)

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """Postings, only of the terms (term) as far as those are few enough to be pushed to the scan by name."""
        return _pushed(self.postings, terms, "term")

    def of_documents(self, ids: DataFrame) -> DataFrame:
        """Postings, only of the documents (doc_id) as far as those are few enough, by the layout by document."""
        return _pushed(self.postings if self.postings_by_doc is None else self.postings_by_doc, ids, "doc_id")


def _pushed(postings: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    some = [r[0] for r in wanted.select(key).distinct().limit(MOST_PUSHED + 1).collect()]
    return postings.where(F.col(key).isin(some)) if len(some) <= MOST_PUSHED else postings


def stemmed(terms: DataFrame, word: str = "term") -> DataFrame:
    """terms with word stemmed: the rules run over distinct words only."""
    vocabulary = stem_column(terms.select(word).distinct(), word, "__stem")
    return terms.join(vocabulary, word).drop(word).withColumnRenamed("__stem", word)


def prose_terms(corpus: DataFrame, text: str = "prose_text", key: str = "id", stem: bool = True, stop: bool = True) -> DataFrame:
    """(key, term): the distinct prose terms of each document."""
    terms = corpus.select(key, F.explode(F.array_distinct(prose_words(F.col(text), stop))).alias("term"))
    return stemmed(terms).distinct() if stem else terms


def code_terms(corpus: DataFrame, text: str = "code_text", key: str = "id") -> DataFrame:
    return corpus.select(key, F.explode(F.array_distinct(code_words(F.col(text)))).alias("term"))


def document_terms(corpus: DataFrame, stem: bool = True, stop: bool = True) -> DataFrame:
    """(id, term): prose and code terms of each document, once each: a term's frequency in a document is always 1."""
    if not stem:
        words = F.array_distinct(F.concat(prose_words(F.col("prose_text"), stop), code_words(F.col("code_text"))))
        return corpus.select("id", F.explode(words).alias("term"))
    return prose_terms(corpus, stem=True, stop=stop).unionByName(code_terms(corpus)).distinct()


def title_terms(corpus: DataFrame, stem: bool = True, stop: bool = True) -> DataFrame:
    return prose_terms(corpus, "title", stem=stem, stop=stop)


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def document_meta(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("id").alias("doc_id"), "source", "url", "title", snippet(F.coalesce("prose_text", F.lit(""))).alias("snippet"), F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce("is_accepted", F.lit(False)).alias("is_accepted"))


def with_frequencies(postings: DataFrame, df: DataFrame) -> DataFrame:
    """postings with their terms' document frequencies df (term, df), a cut table.

    A table that fits is broadcast, and postings stay where they are. Else the most frequent terms are, of which there
    can only be as many as fit, so that no shuffled term has many postings.
    """
    if small(df, FREQUENCY_BYTES):
        return postings.join(F.broadcast(df), "term")
    least = df.agg(F.sum("df")).first()[0] * FREQUENCY_BYTES / BROADCAST_BYTES  # so often are fewer terms than fit
    heavy = df.where(F.col("df") > least)
    met = postings.join(F.broadcast(heavy.withColumnRenamed("df", "__heavy")), "term", "left")
    light = met.where("__heavy is null").drop("__heavy").join(df, "term")
    return light.unionByName(met.where("__heavy is not null").withColumnRenamed("__heavy", "df"))


def build_index(corpus: DataFrame, stem: bool = True, stop: bool = True, title_factor: float = TITLE_FACTOR) -> Index:
    """Score every posting at build time; a query is then a weighted sum.

    With dl the number of a document's distinct terms: tf_idf = ln(N/df)/dl; bm25 is Okapi's with k1 and b, times
    title_factor where the term is in the title, which itself isn't indexed. N and the mean length count documents
    without terms, too. Document frequencies are counted first, and stored.
    """
    if not stem:
        words = F.array_distinct(F.concat(prose_words(F.col("prose_text"), stop), code_words(F.col("code_text"))))
        rows = corpus.select("id", words.alias("terms"), F.array_distinct(prose_words(F.col("title"), stop)).alias("title_terms"))
        postings = rows.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"), "title_terms").withColumn("in_title", F.array_contains("title_terms", F.col("term"))).drop("title_terms")
    else:
        terms = document_terms(corpus, stem, stop)
        dl = terms.groupBy("id").agg(F.count("*").alias("dl"))
        titles = title_terms(corpus, stem, stop).withColumn("in_title", F.lit(True))
        postings = terms.join(dl, "id").join(titles, ["id", "term"], "left").withColumn("in_title", F.coalesce("in_title", F.lit(False)))
    df = cut(postings.groupBy("term").agg(F.count("*").alias("df")))
    # As a term counts once a document, document frequencies add up to all lengths.
    stats = corpus.agg(F.count("*").alias("n_docs")).crossJoin(df.agg(F.sum("df").alias("total"))).select("n_docs", (F.coalesce("total", F.lit(0)) / F.when(F.col("n_docs") > 0, F.col("n_docs"))).alias("avgdl"))
    n = F.col("n_docs").cast("double")
    norm = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    bm25 = idf(F.col("df"), n) * norm * F.when(F.col("in_title"), title_factor).otherwise(1.0)

    def scored(frequencies: DataFrame) -> DataFrame:
        met = with_frequencies(postings, frequencies).crossJoin(F.broadcast(stats))  # one row
        return met.select("term", F.col("id").alias("doc_id"), (F.log(n / F.col("df")) / F.col("dl")).alias("tf_idf"), bm25.alias("bm25"))

    return Index(document_meta(corpus), scored(df), stats, None, lambda terms: scored(cut(df.join(terms.select("term"), "term", "left_semi"))))


def lookup(index: Index, term: str) -> DataFrame:
    return index.postings.where(F.col("term") == term).orderBy(F.desc("bm25"), "doc_id")


def document_vector(index: Index, doc_id: int) -> DataFrame:
    return index.postings.where(F.col("doc_id") == doc_id).select("term", "tf_idf")


def get_document(index: Index, doc_id: int) -> DataFrame:
    return index.doc_meta.where(F.col("doc_id") == doc_id)
