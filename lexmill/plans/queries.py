"""The library's queries over the fixture tables, each with its SQL where SQL can say the same.

Documents stand in for a Q&A corpus: the first line, up to 80 characters, is the title; a call made from language and
source is the code; votes, accepted marks and the kind of source are made from other columns and mean nothing in themselves. Benchmark texts are the queries; documents
that contain one are its relevant documents. Most queries leave words unstemmed; `stemmed_search` and
`stem_vocabulary` stem.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STOP_WORDS
from ..functions import text as T
from ..functions.durable import cut
from ..functions.porter import stem_column, stem_sql
from ..operators import evaluation, feedback, index, ingest, pages, pooling, robots, search
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIX = 6


def register(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    kind = F.substring("source", 4, 10).cast("int") % 3
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.when(kind == 0, "stackoverflow").when(kind == 1, "python_docs").otherwise("mdn").alias("source"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("prose_text"),
        F.concat(F.lit("load"), F.upper("lang"), F.lit("Doc("), "source", F.lit("_"), (F.col("doc_id") % 50).cast("string"), F.lit(")")).alias("code_text"),
        (F.coalesce("quality", F.lit(0)) * (F.col("doc_id") % 100)).cast("long").alias("score"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_accepted"),
    )


def built(spark: SparkSession, sf_dir: str, stem: bool = False) -> index.Index:
    return index.build_index(corpus(spark, sf_dir), stem=stem)


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): documents that contain a query's text."""
    return evaluation.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), batch(spark, sf_dir))


def r(name: str, digits: int = SIX):
    return F.round(name, digits).alias(name)


# Tokens ---------------------------------------------------------------------------------------------------------------


@register(S.statement([S.CORPUS], f"SELECT id AS doc_id, unnest({S.prose('prose_text')}) AS term FROM corpus"))
def prose_terms(spark, sf_dir):
    return index.prose_terms(corpus(spark, sf_dir), stem=False).withColumnRenamed("id", "doc_id")


@register(S.statement([S.CORPUS], f"SELECT id AS doc_id, unnest({S.document()}) AS term FROM corpus"))
def document_terms(spark, sf_dir):
    return index.document_terms(corpus(spark, sf_dir), stem=False).withColumnRenamed("id", "doc_id")


@register(S.statement([S.CORPUS], f"SELECT id AS doc_id, CAST(len({S.document()}) AS BIGINT) AS dl FROM corpus"))
def doc_lengths(spark, sf_dir):
    return index.document_terms(corpus(spark, sf_dir), stem=False).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("dl"))


@register(S.statement([S.CORPUS], f"SELECT id AS doc_id, unnest({S.title('title')}) AS token FROM corpus"))
def title_tokens(spark, sf_dir):
    return corpus(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode(T.title_words(F.col("title"))).alias("token"))


@register(f"SELECT page_id, unnest({S.code('url')}) AS term FROM pages")
def code_terms_url(spark, sf_dir):
    return index.code_terms(table(spark, sf_dir, "pages"), "url", "page_id")


@register(f"SELECT item_id AS query_id, term FROM (SELECT item_id, unnest({S.prose('text')}) AS term FROM benchmark) UNION SELECT item_id, unnest({S.code('text')}) FROM benchmark")
def query_tokens(spark, sf_dir):
    return search.query_terms(batch(spark, sf_dir), stem=False)


@register(f"SELECT term, count(*) AS n, term IN ({S.texts(sorted(STOP_WORDS))}) AS stop_word, term IN ({S.texts(sorted(S.EFFECTIVE_STOP_WORDS))}) AS dropped FROM (SELECT unnest({S.prose('text', False)}) AS term FROM documents) GROUP BY term")
def stopword_filter(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.prose_words(F.col("text"), stop=False))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).select("term", "n", F.col("term").isin(*sorted(STOP_WORDS)).alias("stop_word"), F.col("term").isin(*sorted(S.EFFECTIVE_STOP_WORDS)).alias("dropped"))


@register(S.statement([S.CORPUS, f"v AS (SELECT DISTINCT unnest({S.prose('prose_text')}) AS term FROM corpus)", stem_sql("v")], "SELECT word AS term, w AS stem FROM p9"))
def stem_vocabulary(spark, sf_dir):
    return stem_column(index.prose_terms(corpus(spark, sf_dir), stem=False).select("term").distinct(), "term", "stem")


# Index ----------------------------------------------------------------------------------------------------------------


@register(S.statement(S.index(), "SELECT term, df FROM df"))
def doc_frequency(spark, sf_dir):
    return index.document_terms(corpus(spark, sf_dir), stem=False).groupBy("term").agg(F.count("*").alias("df"))


@register(S.statement(S.index(), "SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM doc_terms) AS n_postings FROM stats"))
def corpus_stats(spark, sf_dir):
    at = built(spark, sf_dir)
    terms = at.postings.groupBy("term").agg(F.count("*").alias("df")).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return at.corpus_stats.crossJoin(terms).select("n_docs", r("avgdl"), "n_terms", "n_postings")


@register(S.statement(S.index(), "SELECT term, doc_id, round(tf_idf, 6) AS tf_idf FROM postings"))
def tfidf_postings(spark, sf_dir):
    return built(spark, sf_dir).postings.select("term", "doc_id", r("tf_idf"))


@register(S.statement([c.replace(f"{S.TITLE_FACTOR}::DOUBLE END AS bm25", "1 END AS bm25") for c in S.index()], "SELECT term, doc_id, round(bm25, 6) AS bm25 FROM postings"))
def bm25_postings(spark, sf_dir):
    return index.build_index(corpus(spark, sf_dir), stem=False, title_factor=1.0).postings.select("term", "doc_id", r("bm25"))


@register(S.statement(S.index(), "SELECT term, doc_id, round(bm25, 6) AS bm25 FROM postings"))
def bm25_title_boost(spark, sf_dir):
    return built(spark, sf_dir).postings.select("term", "doc_id", r("bm25"))


@register(S.statement(S.index(), "SELECT doc_id, round(tf_idf, 6) AS tf_idf, round(bm25, 6) AS bm25 FROM postings WHERE term = 'thing'"))
def term_lookup(spark, sf_dir):
    return index.lookup(built(spark, sf_dir), "thing").select("doc_id", r("tf_idf"), r("bm25"))


@register(S.statement(S.index(), "SELECT term, round(tf_idf, 6) AS tf_idf FROM postings WHERE doc_id = 7"))
def doc_vector(spark, sf_dir):
    return index.document_vector(built(spark, sf_dir), 7).select("term", r("tf_idf"))


@register(S.statement([S.CORPUS], "SELECT id AS doc_id, source, url, title, score, is_accepted FROM corpus WHERE id = 7"))
def metadata_lookup(spark, sf_dir):
    return index.get_document(built(spark, sf_dir), 7).select("doc_id", "source", "url", "title", "score", "is_accepted")


# Search ---------------------------------------------------------------------------------------------------------------

_SHOWN = "SELECT query_id, rank, doc_id, title, source, is_accepted, votes, round(raw_score, 6) AS raw_score, round(final_score, 6) AS final_score FROM "
_BASE = S.index() + S.queries()
_TOP20 = [*_BASE, *S.score("b", "q0", "bm25", 20, False)]


def shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, "query_id", "rank", "doc_id", "title", "source", "is_accepted", "votes", r("raw_score"), r("final_score"))


def _search(spark, sf_dir, mode, boost):
    return shown(search.search(batch(spark, sf_dir), built(spark, sf_dir), mode, 10, boost, stem=False))


@register(S.statement(_BASE + S.score("s", "q0", "bm25", 10, False), _SHOWN + "s"))
def search_bm25(spark, sf_dir):
    return _search(spark, sf_dir, "bm25", False)


@register(S.statement(_BASE + S.score("s", "q0", "tfidf", 10, False), _SHOWN + "s"))
def search_tfidf(spark, sf_dir):
    return _search(spark, sf_dir, "tfidf", False)


@register(S.statement(_BASE + S.score("s", "q0", "bm25", 10, True), _SHOWN + "s"))
def search_bm25_boosted(spark, sf_dir):
    return _search(spark, sf_dir, "bm25", True)


@register(S.statement(_BASE + S.score("s", "q0", "tfidf", 10, True), _SHOWN + "s"))
def search_tfidf_boosted(spark, sf_dir):
    return _search(spark, sf_dir, "tfidf", True)


@register(S.statement(S.index(True) + S.queries(True) + S.score("s", "q0", "bm25", 10, True), _SHOWN + "s"))
def stemmed_search(spark, sf_dir):
    return shown(search.search(batch(spark, sf_dir), built(spark, sf_dir, True), "bm25", 10, True))


def _baseline(spark, sf_dir, k=20):
    """The index, the queries' terms and vectors, and the first k results, which are stored: queries use them several times."""
    at = built(spark, sf_dir)
    terms = cut(search.query_terms(batch(spark, sf_dir), stem=False))
    vectors = terms.withColumn("weight", F.lit(1.0))
    return at, terms, vectors, cut(search.score_vectors(vectors, at, "bm25", k, boost=False, terms=terms))


@register(S.statement(_TOP20 + S.rerank("x", "b"), _SHOWN + "x"))
def rerank_all(spark, sf_dir):
    _, terms, _, b = _baseline(spark, sf_dir)
    return shown(search.rerank(b, terms))


_OFF = {name: {flag: flag == name for flag in search.FLAGS} for name in search.FLAGS} | {"none": dict.fromkeys(search.FLAGS, False)}


@register(S.statement(_TOP20 + [c for n, f in _OFF.items() for c in S.rerank("x_" + n, "b", f)], " UNION ALL ".join(f"SELECT '{n}' AS kept, query_id, rank, doc_id, round(final_score, 6) AS final_score FROM x_{n}" for n in _OFF)))
def rerank_ablation(spark, sf_dir):
    _, terms, _, b = _baseline(spark, sf_dir)
    out = None
    for name, flags in _OFF.items():
        rows = search.rerank(b, terms, flags).select(F.lit(name).alias("kept"), "query_id", "rank", "doc_id", r("final_score"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register(S.statement(_TOP20 + S.rerank("x", "b"), "SELECT query_id, doc_id, round(raw_score, 6) AS raw_score, accepted_factor::DOUBLE AS accepted_factor, docs_factor::DOUBLE AS docs_factor, round(vote_bonus, 6) AS vote_bonus, title_hits, round(title_bonus, 6) AS title_bonus, round(final_score, 6) AS final_score FROM x"))
def explain_scores(spark, sf_dir):
    _, terms, _, b = _baseline(spark, sf_dir)
    return search.explain(b, terms).select("query_id", "doc_id", r("raw_score"), "accepted_factor", "docs_factor", r("vote_bonus"), "title_hits", r("title_bonus"), r("final_score"))


@register(S.statement(_TOP20 + S.rerank("x", "b"), f"SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN {S.OFFICIAL} THEN 0 ELSE 1 END, round(final_score, 9) DESC, doc_id) AS shown FROM x"))
def display_order(spark, sf_dir):
    _, terms, _, b = _baseline(spark, sf_dir)
    return search.display_order(search.rerank(b, terms)).select("query_id", "doc_id", "shown")


# Feedback -------------------------------------------------------------------------------------------------------------

_JUDGED = "j AS (SELECT query_id, doc_id, rank <= 3 AS relevant FROM b WHERE rank <= 5)"


def _judgments(b: DataFrame) -> DataFrame:
    return b.where("rank <= 5").select("query_id", "doc_id", (F.col("rank") <= 3).alias("relevant"))


@register(S.statement([*_TOP20, _JUDGED, *S.rocchio("q1", "q0", "j")], "SELECT query_id, term, round(weight, 6) AS weight FROM q1"))
def rocchio_vector(spark, sf_dir):
    at, _, vectors, b = _baseline(spark, sf_dir)
    return feedback.rocchio(vectors, _judgments(b), at).select("query_id", "term", r("weight"))


@register(S.statement([*_TOP20, _JUDGED, *S.rocchio("q1", "q0", "j"), *S.score("s", "q1", "bm25", 10, False), *S.rerank("x", "s")], _SHOWN + "x"))
def rocchio_search(spark, sf_dir):
    at, terms, vectors, b = _baseline(spark, sf_dir)
    return shown(search.rerank(search.score_vectors(feedback.rocchio(vectors, _judgments(b), at), at, "bm25", 10, boost=False), terms))


_PSEUDO = ["jp AS (SELECT query_id, doc_id, true AS relevant FROM b10 WHERE rank <= 3)", *S.rocchio("qp", "q0", "jp"), *S.score("sp", "qp", "bm25", 10, False), *S.rerank("xp", "sp")]
_TOP10 = [*_BASE, *S.score("b10", "q0", "bm25", 10, False)]


@register(S.statement(_TOP10 + _PSEUDO, _SHOWN + "xp"))
def pseudo_feedback(spark, sf_dir):
    at, terms, vectors, _ = _baseline(spark, sf_dir)
    return shown(feedback.pseudo_feedback(vectors, terms, at, 10))


_ROUND1 = [*S.rerank("x0", "b10"), "l0 AS (SELECT query_id, doc_id, rank <= 2 AS relevant FROM x0 WHERE rank <= 3)", *S.rocchio("v1", "q0", "l0"), *S.score("s1", "v1", "bm25", 10, False), *S.rerank("x1", "s1")]
_ROUND2 = ["l1 AS (SELECT * FROM l0 UNION SELECT query_id, doc_id, rank <= 2 AS relevant FROM x1 WHERE rank <= 3)", *S.rocchio("v2", "q0", "l1"), *S.score("s2", "v2", "bm25", 10, False), *S.rerank("x2", "s2")]


@register(S.statement(_TOP10 + _ROUND1 + _ROUND2, _SHOWN + "x2"))
def feedback_loop(spark, sf_dir):
    def judge(results: DataFrame, k: int) -> DataFrame:
        return results.where("rank <= 3").select("query_id", "doc_id", (F.col("rank") <= 2).alias("relevant"))

    return shown(feedback.feedback_loop(batch(spark, sf_dir), built(spark, sf_dir), judge, stem=False))


# Pools and evaluation -------------------------------------------------------------------------------------------------

_SYSTEMS = [*_TOP10, *S.rerank("x10", "b10"), *S.score("t10", "q0", "tfidf", 10, False), *_PSEUDO,
            "runs AS (SELECT 1 AS o, 'bm25_boosted' AS system, query_id, rank, doc_id, title FROM x10 UNION ALL SELECT 2, 'bm25_baseline', query_id, rank, doc_id, title FROM b10 UNION ALL SELECT 3, 'tfidf', query_id, rank, doc_id, title FROM t10 UNION ALL SELECT 4, 'rocchio', query_id, rank, doc_id, title FROM xp)",
            "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY o, rank) AS k FROM runs) WHERE k = 1)"]


@register(S.statement(_SYSTEMS, "SELECT query_id, doc_id, title, system AS first_system, row_number() OVER (PARTITION BY query_id ORDER BY o, rank, doc_id) AS position FROM firsts"))
def pool_union(spark, sf_dir):
    runs = pooling.system_runs(batch(spark, sf_dir), built(spark, sf_dir), stem=False)
    return pooling.build_pool(runs).select("query_id", "doc_id", "title", "first_system", "position")


@register(S.statement(_SYSTEMS, "SELECT query_id, doc_id, system AS first_system FROM firsts WHERE query_id NOT IN (SELECT item_id FROM benchmark WHERE item_id % 3 = 0)"))
def pool_unseen(spark, sf_dir):
    """The pool of queries that aren't pooled yet; those whose number three divides are."""
    runs = pooling.system_runs(batch(spark, sf_dir), built(spark, sf_dir), stem=False)
    known = batch(spark, sf_dir).where("query_id % 3 = 0").select("query_id")
    return pooling.build_pool(runs, known).select("query_id", "doc_id", "first_system")


@register(S.statement([*_SYSTEMS, S.QRELS], "SELECT f.query_id, string_agg(CAST(f.doc_id AS VARCHAR), ',' ORDER BY f.doc_id) AS relevant_doc_ids FROM firsts f JOIN qrels q ON f.query_id = q.query_id AND f.doc_id = q.doc_id GROUP BY f.query_id"))
def pool_to_qrels(spark, sf_dir):
    runs = pooling.system_runs(batch(spark, sf_dir), built(spark, sf_dir), stem=False)
    labels = known_items(spark, sf_dir).withColumn("relevant", F.lit(True))
    return pooling.to_qrels(pooling.apply_labels(pooling.build_pool(runs), labels)).select("query_id", F.array_join(F.col("relevant_doc_ids").cast("array<string>"), ",").alias("relevant_doc_ids"))


_FIVE = ", ".join(f"round({m}, 6) AS {m}" for m in evaluation.METRICS)


@register(S.statement([*_TOP20, S.QRELS, *S.metrics("m", "b")], f"SELECT query_id, {_FIVE} FROM m"))
def metrics_per_query(spark, sf_dir):
    _, _, _, b = _baseline(spark, sf_dir)
    return evaluation.metrics_per_query(b, known_items(spark, sf_dir)).select("query_id", *map(r, evaluation.METRICS))


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluation.METRICS)
_EXPERIMENTS = [*_TOP20, S.QRELS, *S.rerank("xb", "b"), *S.score("t", "q0", "tfidf", 20, False), *S.rerank("xt", "t"),
                "jo AS (SELECT b.query_id, b.doc_id, true AS relevant FROM b JOIN qrels q ON b.query_id = q.query_id AND b.doc_id = q.doc_id)",
                "qo AS (SELECT * FROM q0 WHERE query_id IN (SELECT query_id FROM jo))", *S.rocchio("qr", "qo", "jo"), *S.score("sr", "qr", "bm25", 20, False), *S.rerank("xr", "sr"),
                "runs AS (SELECT 'TF-IDF' AS experiment, query_id, rank, doc_id FROM xt UNION ALL SELECT unnest(['BM25', 'Metadata boost', 'Baseline (pre-Rocchio)']), query_id, rank, doc_id FROM xb UNION ALL SELECT 'No metadata boost', query_id, rank, doc_id FROM b UNION ALL SELECT 'After Rocchio feedback', query_id, rank, doc_id FROM xr UNION ALL SELECT 'After Rocchio feedback', query_id, rank, doc_id FROM b WHERE query_id NOT IN (SELECT query_id FROM jo))",
                *S.metrics("m", "runs", "experiment")]


@register(S.statement(_EXPERIMENTS, f"SELECT experiment, {_MEANS}, count(*) AS n_queries FROM m GROUP BY experiment"))
def experiments(spark, sf_dir):
    out = evaluation.run_experiments(batch(spark, sf_dir), known_items(spark, sf_dir), built(spark, sf_dir), stem=False)
    return out.select("experiment", *map(r, evaluation.METRICS), "n_queries")


# Snippets and pages ---------------------------------------------------------------------------------------------------


@register(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), h AS (SELECT doc_id, t, substr(t, 1, 200) AS h, 200 - strpos(reverse(substr(t, 1, 200)), ' ') AS pos FROM t)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE CASE WHEN strpos(h, ' ') > 0 AND pos > 0 THEN substr(h, 1, pos) ELSE h END || '...' END AS snippet FROM h""")
def index_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@register(S.statement([*_BASE, *S.score("b", "q0", "bm25", 5, False), "lists AS (SELECT query_id, list(term ORDER BY term) AS terms FROM q_terms GROUP BY query_id)"], "") .rstrip() + "," + S.window_snippet("b", "lists"))
def query_snippet(spark, sf_dir):
    _, terms, _, b = _baseline(spark, sf_dir, 5)
    lists = terms.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return b.select("query_id", "rank", "doc_id").join(lists, "query_id").join(texts, "doc_id").select("query_id", "rank", "doc_id", T.best_window(F.col("text"), F.col("terms")).alias("snippet"))


@register(r"SELECT item_id, regexp_replace(text, '(thing|the|of)', '**\1**', 'gi') AS marked FROM benchmark")
def highlight_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.highlight(F.col("text"), ["of", "the", "thing"]).alias("marked"))


@register(S.URL_FILTER)
def url_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(S.URL_CASE).alias("url"))
    return p.select("page_id", "url", pages.source_of(F.col("url")).alias("source"), pages.is_allowed_url(F.col("url")).alias("allowed"))


_TITLED = "SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) || CASE doc_id % 5 WHEN 0 THEN ' Research' WHEN 1 THEN ' 404' ELSE '' END AS t, text FROM documents"


def _titled(spark, sf_dir):
    ending = F.when(F.col("doc_id") % 5 == 0, " Research").when(F.col("doc_id") % 5 == 1, " 404").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring(F.substring_index("text", "\n", 1), 1, 80), ending).alias("t"), "text")


@register(f"SELECT doc_id, t AS title, {S.JUNK} AS junk FROM ({_TITLED})")
def junk_title_filter(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_id", F.col("t").alias("title"), pages.is_junk_title(F.col("t")).alias("junk"))


@register(f"SELECT doc_id, length(text) < {S.THIN} AS thin FROM documents")
def thin_page_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.is_thin(F.col("text"), F.lit("")).alias("thin"))


@register(S.PAGE)
def page_extract(spark, sf_dir):
    return pages.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "title", "prose_text", "code_text", "source", F.size("links").cast("long").alias("n_links"))


@register(r"SELECT page_id, NOT (regexp_matches(url, '^https?://[^/?#]*example\.com/de/')) AS allowed FROM pages")
def robots_gate(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    scheme, host, _ = pages.url_parts(F.col("url"))
    sites = p.where(host.endswith("example.com")).select(F.concat(scheme, F.lit("://"), host).alias("site")).distinct()
    rules = sites.withColumn("text", F.lit("User-agent: own\nDisallow: /de/\n\nUser-agent: *\nDisallow: /de/\n"))
    return robots.allowed_by_robots(p, rules, "own").select("page_id", "allowed")


_ANY = ("example.com", "example.net", "example.org")


@register(S.LINKS)
def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("url", F.regexp_replace("url", r"://[^/]*(example\.[a-z]+)", "://$1"))
    return pages.page_links(p, hosts=_ANY)


_SEEDS = "regexp_matches(url, '^https?://[^/]*/en/')"


@register(S.crawl(_SEEDS, 10))
def crawl_frontier(spark, sf_dir):
    """From all English pages to the crawl's own depth."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"://[^/]*(example\.[a-z]+)", "://$1").alias("url"), "html")
    return pages.crawl(p, p.where("url rlike '^https?://[^/]*/en/'").select("url"), hosts=_ANY).select("id", "hop", "url", "title")


# Questions and answers, rows made here: no fixture table has any.
_QUESTIONS = [(1, 5, "Sort a list?", "<p>How to sort?</p><pre><code>x.sort()</code></pre>", 11), (2, 0, "", "<p>No title</p>", None), (3, -2, "Empty body", "", None), (4, None, "Read a file", "<p>Read <code>open(f)</code> please</p>", 99)]
_ANSWERS = [(10, 1, 3, "<p>Use sorted</p>"), (11, 1, 7, "<p>Use <b>sort</b></p>"), (12, 8, 1, "<p>Lost parent</p>"), (13, 4, None, "<pre>only code</pre>"), (14, 2, 2, "<p>Of untitled</p>")]


@register("""SELECT * FROM (VALUES
 (0::BIGINT, 'https://stackoverflow.com/questions/1', 'Sort a list?', 'How to sort?', 'x.sort()', 5::BIGINT, false),
 (1, 'https://stackoverflow.com/questions/4', 'Read a file', 'Read please', 'open(f)', 0, false),
 (2, 'https://stackoverflow.com/questions/1#10', 'Answer: Sort a list?', 'Use sorted', '', 3, false),
 (3, 'https://stackoverflow.com/questions/1#11', 'Answer: Sort a list?', 'Use sort', '', 7, true),
 (4, 'https://stackoverflow.com/questions/8#12', 'Answer to question 8', 'Lost parent', '', 1, false),
 (5, 'https://stackoverflow.com/questions/2#14', 'Answer to question 2', 'Of untitled', '', 2, false)) t(id, url, title, prose_text, code_text, score, is_accepted)""")
def qa_ingest(spark, sf_dir):
    q = spark.createDataFrame(_QUESTIONS, "Id long, Score long, Title string, Body string, AcceptedAnswerId long")
    a = spark.createDataFrame(_ANSWERS, "Id long, ParentId long, Score long, Body string")
    return ingest.ingest_qa(q, a).select("id", "url", "title", "prose_text", "code_text", "score", "is_accepted")


_QA_CAP = "(0::BIGINT, 'Sort a list?', 5::BIGINT), (1, 'Read a file', 0), (2, 'Answer: Sort a list?', 3)"


@register(f"SELECT * FROM (VALUES {_QA_CAP}) t(id, title, score)")
def qa_cap(spark, sf_dir):
    """The first three documents, questions before answers."""
    q = spark.createDataFrame(_QUESTIONS, "Id long, Score long, Title string, Body string, AcceptedAnswerId long")
    a = spark.createDataFrame(_ANSWERS, "Id long, ParentId long, Score long, Body string")
    return ingest.ingest_qa(q, a, max_docs=3).select("id", "title", "score")


_TURNS = "SELECT conv_id * 100000 + turn AS query_id, text FROM conversations WHERE role = 'user'"


@register(S.statement(S.index() + S.queries(texts=_TURNS) + S.score("s", "q0", "bm25", 10, True), _SHOWN + "s"))
def conversation_search(spark, sf_dir):
    """What users say in conversations, as queries."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return shown(search.search(turns, built(spark, sf_dir), "bm25", 10, True, stem=False))
