import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import batches, evaluation, feedback, index, pooling, search

SCHEMA = "id long, title string, prose_text string, code_text string, source string, url string, score long, is_accepted boolean"
DOCS = [
    (0, "Sort lists", "sort a list with sorted", "sorted(x)", "stackoverflow", "u0", 10, True),
    (1, "Files", "read a file, list lines", "open(f)", "python_docs", "u1", 0, False),
    (2, "", "list of files to sort", "", "mdn", "u2", -4, False),
    (3, "Nothing", "", "", "stackoverflow", "u3", 1, False),
]


@pytest.fixture(scope="module")
def at(spark):
    return index.build_index(spark.createDataFrame(DOCS, SCHEMA), stem=False)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "sort list"), (2, "nowhere"), (3, "")], "query_id long, query string")


def test_search_modes(at, texts):
    for mode in ("bm25", "tfidf"):
        rows = search.search(texts, at, mode, 10, False, stem=False).collect()
        assert {r["query_id"] for r in rows} == {1}
        assert {r["doc_id"] for r in rows} == {0, 1, 2}
        assert all(r["final_score"] == r["raw_score"] for r in rows)
    boosted = {r["doc_id"]: r for r in search.search(texts, at, "bm25", 10, True, stem=False).collect()}
    assert math.isclose(boosted[0]["final_score"], boosted[0]["raw_score"] * 1.3 + 0.1 * math.log(11))
    assert math.isclose(boosted[2]["final_score"], boosted[2]["raw_score"] * 1.2)
    assert boosted[2]["title"] == "(no title)"


def test_rerank_flags(at, texts):
    terms = search.query_terms(texts, stem=False)
    base = search.search(texts, at, "bm25", 10, False, stem=False)
    off = search.rerank(base, terms, dict.fromkeys(search.FLAGS, False)).collect()
    assert [(r["doc_id"], r["final_score"]) for r in off] == [(r["doc_id"], r["raw_score"]) for r in off]
    parts = {r["doc_id"]: r for r in search.explain(base, terms).collect()}
    assert parts[0]["title_hits"] == 1 and parts[0]["title_bonus"] == pytest.approx(0.15)
    assert search.rerank(base.where("false"), terms).count() == 0


def test_rocchio(at, texts, spark):
    vectors = search.query_vectors(texts, stem=False)
    none = spark.createDataFrame([], "query_id long, doc_id long, relevant boolean")
    same = {(r["query_id"], r["term"]): r["weight"] for r in feedback.rocchio(vectors, none, at).collect()}
    assert same == {(r["query_id"], r["term"]): r["weight"] for r in vectors.collect()}
    judged = spark.createDataFrame([(1, 0, True), (1, 3, True), (1, 1, False)], none.schema)
    got = {r["term"]: r["weight"] for r in feedback.rocchio(vectors, judged, at).where("query_id = 1").collect()}
    vector = {d: {r["term"]: r["tf_idf"] for r in index.document_vector(at, d).collect()} for d in (0, 1)}
    assert got["sorted"] == pytest.approx(0.75 * vector[0]["sorted"] / 2)  # the mean counts document 3, which has no terms
    assert got["list"] == pytest.approx(1 + 0.75 * vector[0]["list"] / 2 - 0.15 * vector[1]["list"])
    assert "read" not in got


def averaged(relevance):
    """NDCG with the sorted relevance as truth and relevance as score, ties averaged, from the definition."""
    k, truth = len(relevance), sorted(relevance, reverse=True)
    gain, done = 0.0, 0
    for value in sorted(set(relevance), reverse=True):
        tie = [t for t, r in zip(truth, relevance, strict=True) if r == value]
        gain += sum(tie) / len(tie) * evaluation.discount(done + 1, done + len(tie))
        done += len(tie)
    return gain / sum(t / math.log2(i + 2) for i, t in enumerate(truth)) if any(truth) else 0.0


def test_metrics(spark):
    rows, qrels = [], []
    vectors = [[int(b) for b in f"{n:010b}"] for n in range(0, 1024, 7)]
    for q, v in enumerate(vectors):
        rows += [(q, k + 1, 100 * q + k) for k in range(10)]
        qrels += [(q, 100 * q + k) for k, hit in enumerate(v) if hit] or [(q, -1)]
    got = {r["query_id"]: r for r in evaluation.metrics_per_query(spark.createDataFrame(rows, "query_id long, rank long, doc_id long"), spark.createDataFrame(qrels, "query_id long, doc_id long")).collect()}
    for q, v in enumerate(vectors):
        assert got[q]["ndcg_ref"] == pytest.approx(averaged(v))
        assert got[q]["p10"] == pytest.approx(sum(v) / 10) and got[q]["p5"] == pytest.approx(sum(v[:5]) / 5)
        assert got[q]["mrr"] == pytest.approx(1 / (v.index(1) + 1) if any(v) else 0)
        ideal = evaluation.discount(1, sum(v))
        assert got[q]["ndcg_std"] == pytest.approx(sum(x / math.log2(i + 2) for i, x in enumerate(v)) / ideal if any(v) else 0)
    assert averaged([0, 1] + [0] * 8) == pytest.approx(0.393729, abs=1e-6)


def test_queries_without_results_count(spark):
    empty = spark.createDataFrame([], "query_id long, rank long, doc_id long")
    row = evaluation.evaluate(empty, spark.createDataFrame([(1, 5)], "query_id long, doc_id long")).first()
    assert row["p5"] == 0 and row["n_queries"] == 1


def test_experiments_and_table(at, texts, spark):
    qrels = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    rows = evaluation.run_experiments(texts, qrels, at, stem=False)
    got = {r["experiment"]: r for r in rows.collect()}
    assert len(got) == 6
    assert got["BM25"]["mrr"] == got["Metadata boost"]["mrr"] == got["Baseline (pre-Rocchio)"]["mrr"]
    assert evaluation.markdown_table(rows).first()["line"].startswith("| ")


def test_pool_labels_and_qrels(at, texts, spark):
    runs = pooling.system_runs(texts, at, stem=False)
    pool = pooling.build_pool(runs)
    assert pool.groupBy("query_id", "doc_id").count().where("count > 1").isEmpty()
    assert pooling.build_pool(runs, known=spark.createDataFrame([(1,)], "query_id long")).isEmpty()
    a, b = ([(r["doc_id"], r["position"]) for r in pooling.build_pool(runs, seed=4).orderBy("position").collect()] for _ in range(2))
    assert a == b
    labels = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, None)], "query_id long, doc_id long, relevant boolean")
    labelled = pooling.apply_labels(pool, labels)
    assert {r["doc_id"]: r["relevant"] for r in labelled.collect()} == {0: True, 1: False, 2: None}
    assert [(r["query_id"], r["relevant_doc_ids"]) for r in pooling.to_qrels(labelled).collect()] == [(1, [0])]


def test_feedback_loop_adds_up_judgments(at, texts):
    seen = []

    def judge(results, k):
        seen.append(k)
        return results.where("rank = 1").select("query_id", "doc_id", F.lit(True).alias("relevant"))

    assert feedback.feedback_loop(texts, at, judge, stem=False).count() > 0
    assert seen == [0, 1]


def test_display_order(at, texts):
    first = search.display_order(search.search(texts, at, "bm25", 10, True, stem=False)).orderBy("shown").first()
    assert first["source"] in ("python_docs", "mdn")


def test_index_round_trip(at, spark, tmp_path):
    at.write(str(tmp_path / "i"))
    for by in ("term", "doc"):
        again = index.Index.read(spark, str(tmp_path / "i"), by)
        assert again.postings.count() == at.postings.count()
    assert index.get_document(at, 99).isEmpty()


def test_empty_corpus(spark):
    empty = index.build_index(spark.createDataFrame([], SCHEMA), stem=False)
    assert empty.postings.isEmpty() and empty.corpus_stats.first()["avgdl"] is None


def test_plans_of_a_stored_index(at, texts, spark, tmp_path, capsys):
    """Searches push their terms to the scan, feedback its documents to the layout by document; nothing is a nested loop."""
    at.write(str(tmp_path / "i"))
    stored = index.Index.read(spark, str(tmp_path / "i"))
    search.search(texts, stored, "bm25", 10, False, stem=False).explain("formatted")
    plan = capsys.readouterr().out
    assert "In(term, [" in plan and "postings_by_term" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    judged = spark.createDataFrame([(1, 0, True), (1, 1, False)], "query_id long, doc_id long, relevant boolean")
    feedback.rocchio(search.query_vectors(texts, stem=False), judged, stored).explain("formatted")
    plan = capsys.readouterr().out
    assert "In(doc_id, [0,1])" in plan and "postings_by_doc" in plan and "postings_by_term" not in plan
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    evaluation.containing(docs, spark.createDataFrame([(1, "one two three four five")], "query_id long, query string")).explain("formatted")
    assert "NestedLoop" not in capsys.readouterr().out


def test_frequencies_without_room_for_a_broadcast(spark, monkeypatch):
    """Frequent terms are broadcast, others shuffled: the same rows as with one broadcast."""
    rows = [(k, f"w{k % 40}") for k in range(400)] + [(k, "hot") for k in range(900)]
    postings = spark.createDataFrame(rows, "id long, term string")
    df = postings.groupBy("term").count().withColumnRenamed("count", "df")
    want = sorted(tuple(r) for r in index.with_frequencies(postings, df).select("id", "term", "df").collect())
    monkeypatch.setattr(index, "BROADCAST_BYTES", 960)
    monkeypatch.setattr(index, "small", lambda *a: False)
    assert sorted(tuple(r) for r in index.with_frequencies(postings, df).select("id", "term", "df").collect()) == want


def test_containing(spark):
    rng = random.Random(2)
    words = [" ".join(rng.choice(["ab", "abc", "b", "c,", "d\n", "", "é"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    docs = [(k, None if k == 7 else w) for k, w in enumerate(words)]
    queries = [(k, None if k == 3 else words[k][rng.randrange(4) : rng.randrange(4, 40)]) for k in range(100)] + [(200, "no such words at all here"), (201, "")]
    got = evaluation.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((q, d) for q, x in queries if x for d, t in docs if t and x in t)


def test_feedback_asks_only_about_judged_queries(at, spark):
    asked = []

    def judge(results, k):
        asked.append({r["query_id"] for r in results.select("query_id").distinct().collect()})
        return results.where("rank = 1 and query_id = 1").select("query_id", "doc_id", F.lit(True).alias("relevant"))

    two = spark.createDataFrame([(1, "sort list"), (2, "file list")], "query_id long, query string")
    assert {r["query_id"] for r in feedback.feedback_loop(two, at, judge, stem=False).collect()} == {1, 2}
    assert asked == [{1, 2}, {1}]
    asked.clear()
    feedback.feedback_loop(two, at, lambda results, k: judge(results, k).where("false"), stem=False)
    assert len(asked) == 1


@pytest.mark.parametrize("mode", ["bm25", "tfidf"])
def test_large_batches_without_a_row_for_each_pair(spark, monkeypatch, mode):
    """The same rows as the join's: over blocks and chunks, with copies that tie, weights, and a term of all documents."""
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    some = [" ".join(["every", *rng.choices(words, k=rng.randint(1, 40))]) for _ in range(150)]
    corpus = spark.createDataFrame([(i, t[:12], t, "", "mdn", "u", 0, False) for i, t in enumerate(some + some[:60] + some[:30])], SCHEMA)
    at = index.build_index(corpus, stem=False)
    asked = spark.createDataFrame([(q, w, rng.choice([1.0, 1.0, 0.3, -1.0])) for q in range(90) for w in {"every", *rng.choices(words, k=q % 20)}], "query_id long, term string, weight double")
    asked = asked.unionByName(spark.createDataFrame([(None, "every", 1.0), (1000, "nowhere", 1.0)], asked.schema))

    def rows(k):
        return {(r["query_id"], r["doc_id"]): r["raw_score"] for r in search.first_candidates(asked, at, mode, k).collect()}

    want = {k: rows(k) for k in (3, 15)}
    assert sum(d >= 150 for _, d in want[15]) > 20

    def no_join(*_):
        raise AssertionError("a row for each query and document")

    monkeypatch.setattr(search, "MOST_JOINED", 0)
    monkeypatch.setattr(search, "raw_scores", no_join)
    monkeypatch.setattr(batches, "DOCS", 8)
    monkeypatch.setattr(batches, "ENTRIES", 300)
    for k, expected in want.items():
        got = rows(k)
        assert got.keys() == expected.keys()
        assert all(got[x] == pytest.approx(expected[x], abs=1e-12) for x in got)
    empty = index.build_index(corpus.where("false"), stem=False)
    assert search.first_candidates(asked, empty, mode, 5).isEmpty()
