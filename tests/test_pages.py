import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions.html import parse_page, split_body
from lexmill.operators import ingest, pages, session
from lexmill.sources import files


@pytest.mark.parametrize(
    ("html", "parts"),
    [
        ("<p>How to <b>sort</b>?</p><pre><code> x.sort() </code></pre><p>Thanks</p>", ("How to sort ? Thanks", "x.sort()")),
        ("<p>a <code>f(x)</code> b</p><code>g</code><pre> </pre>", ("a b", "f(x)\ng")),
        ("&lt;tag&gt; &amp; more", ("<tag> & more", "")),
        ("<p>unclosed <i>deep", ("unclosed deep", "")),
        ("", ("", "")),
        (None, ("", "")),
    ],
)
def test_split_body(html, parts):
    assert split_body(html) == parts


PAGE = """<html><head><title>T</title></head><body><nav><a href="/nav">n</a></nav><div class="side content-main"><h1>The <em>big</em> title¶</h1>
<p>Some <b>prose</b> here</p><ul><li>one <p>two</p></li></ul><pre>code <a href="/gone">x</a></pre><a href="b.html#frag">b</a></div><p>outside</p></body></html>"""


def test_parse_page():
    title, prose, code, links = parse_page("https://docs.python.org/3/x/a.html", PAGE)
    assert title == "Thebigtitle¶" and code == "code x"
    assert prose == "The big title¶ Some prose here one two two"
    assert links == ["https://docs.python.org/nav", "https://docs.python.org/3/x/b.html"]
    assert parse_page("u", None)[0] == "u"
    assert parse_page("u", "<div>" * 3000 + "<p>deep</p>")[1] == "deep"


def test_extract_and_filters(spark):
    df = spark.createDataFrame([(1, "https://docs.python.org/3/a.html", PAGE), (2, "x", None)], "page_id long, url string, html string")
    row = pages.extract_pages(df).where("page_id = 1").first()
    assert row["title"] == "Thebigtitle" and row["source"] == "python_docs"
    assert [r["link"] for r in pages.page_links(df).collect()] == ["https://docs.python.org/nav", "https://docs.python.org/3/x/b.html".replace("/x", "")]
    flags = spark.createDataFrame([("Research in X", "p" * 100, ""), ("Fine", "p" * 99, "c" * 49), ("Fine", "p" * 99, "c" * 50), (None, None, None)], "t string, p string, c string")
    got = flags.select(pages.is_junk_title(F.col("t")).alias("j"), pages.is_thin(F.col("p"), F.col("c")).alias("thin")).collect()
    assert [(r["j"], r["thin"]) for r in got] == [(True, False), (False, True), (False, False), (False, True)]


def test_crawl(spark):
    def page(*links):
        return "<h1>Good title</h1><article><p>" + "word " * 40 + "".join(f'<a href="{x}">l</a>' for x in links) + "</p></article>"

    host = "https://docs.python.org/3/"
    df = spark.createDataFrame([(host + "a.html", page("b.html", "a.html#x", "http://elsewhere.org/")), (host + "b.html", page("c.html", "a.html")), (host + "c.html", page()), (host + "lost.html", page())], "url string, html string")
    got = pages.crawl(df, [host + "a.html"])
    assert [(r["id"], r["hop"], r["url"][-6:]) for r in got.orderBy("id").collect()] == [(0, 0, "a.html"), (1, 1, "b.html"), (2, 2, "c.html")]
    assert pages.crawl(df, [host + "a.html"], most=2).count() == 2


def test_crawl_of_addresses_with_several_pages(spark):
    """Each page of an address is a document, also one that repeats, and the links of all are followed."""
    host = "https://docs.python.org/3/"

    def page(title, *links):
        return f"<h1>{title}</h1><article><p>" + "word " * 40 + "".join(f'<a href="{x}">l</a>' for x in links) + "</p></article>"

    df = spark.createDataFrame([(host + "a.html", page("Two", "c.html")), (host + "a.html", page("One", "b.html")), (host + "b.html", page("Same")), (host + "b.html", page("Same")), (host + "c.html", page("Last", "a.html"))], "url string, html string")
    got = [(r["id"], r["hop"], r["url"][-6:], r["title"]) for r in pages.crawl(df.repartition(5), [host + "a.html"]).orderBy("id").collect()]
    assert got == [(0, 0, "a.html", "One"), (1, 0, "a.html", "Two"), (2, 1, "b.html", "Same"), (3, 1, "b.html", "Same"), (4, 1, "c.html", "Last")]


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = [(r["id"], r["k"]) for r in pages.with_dense_ids(df, ["k"], start=5).orderBy("id").collect()]
    assert [i for i, _ in got] == list(range(5, 1005)) and [k for _, k in got] == sorted(k for _, k in got)


def test_qa_files(spark, tmp_path):
    q, a = tmp_path / "q.csv", tmp_path / "a.csv"
    q.write_bytes('Id,OwnerUserId,Score,Title,Body\n1,5,3,"Caf\xe9, ""sorted""","<p>Line\nbreak</p>"\n2,,x,NA title,<p>b</p>\n'.encode("latin-1"))
    a.write_bytes(b"Id,ParentId,Score,Body\n10,1,2,<p>yes</p>\n11,77,,<p>no</p>\n")
    questions, answers = files.read_questions(spark, str(q)), files.read_answers(spark, str(a))
    docs = ingest.ingest_qa(questions, answers, start_id=7).orderBy("id").collect()
    assert [r["id"] for r in docs] == [7, 8, 9, 10]
    assert docs[0]["title"] == 'Café, "sorted"' and docs[0]["prose_text"] == "Line break"
    assert [r["title"] for r in docs[2:]] == ['Answer: Café, "sorted"', "Answer to question 77"]
    assert not any(r["is_accepted"] for r in docs)
    assert ingest.ingest_qa(questions, answers, max_docs=3).count() == 3
    assert ingest.accepted_present(questions, answers).first()["n"] == 0


def test_corpus_files(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"id": 4, "source": "mdn", "url": "u", "title": "t"}\n\n{"id": 9, "source": "mdn", "url": "v", "title": "s", "prose_text": "é"}\n', encoding="utf-8")
    corpus = files.read_corpus(spark, str(path))
    assert sorted((r["id"], r["prose_text"], r["score"]) for r in corpus.collect()) == [(4, "", 0), (9, "é", 0)]
    assert files.next_id(corpus) == 10 and files.next_id(corpus.where("false")) == 0
    files.write_corpus(corpus, str(tmp_path / "out"))
    files.write_corpus(corpus, str(tmp_path / "out"), append=True)
    assert files.read_corpus(spark, str(tmp_path / "out")).count() == 4


def test_judgment_files(spark, tmp_path):
    (tmp_path / "pool.json").write_text(files.pool_file([{"query": "q", "doc_id": 1, "title": "t", "url": "u", "snippet": "s", "relevant": True}, {"query": "q", "doc_id": 2, "title": "t", "url": "u", "snippet": "s", "relevant": None}]))
    assert [(r["query"], r["position"], r["doc_id"], r["relevant"]) for r in files.read_pool(spark, str(tmp_path / "pool.json")).orderBy("position").collect()] == [("q", 1, 1, True), ("q", 2, 2, None)]
    (tmp_path / "gt.json").write_text(json.dumps([{"query": "q", "relevant_doc_ids": [3, 1]}]))
    assert sorted(tuple(r) for r in files.read_qrels(spark, str(tmp_path / "gt.json")).collect()) == [("q", 1), ("q", 3)]
    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")
    files.write_qrels(spark.createDataFrame([(1, [1, 3])], "query_id long, relevant_doc_ids array<long>"), queries, str(tmp_path / "qrels"))
    assert files.read_qrels(spark, str(tmp_path / "qrels")).count() == 2
    (tmp_path / "queries.txt").write_text("one\n\n  \ntwo\n")
    assert sorted(r["query"] for r in files.read_queries(spark, str(tmp_path / "queries.txt")).collect()) == ["one", "two"]


def test_pools_and_judgments_of_many_queries(spark, tmp_path):
    """What is written in several files is read again whole; labels beside a pool are in it."""
    names = [(k, f"query {k}" if k else "[odd] {name}") for k in range(50)]
    queries = spark.createDataFrame(names, "query_id long, query string")
    rows = [(k, k * 10 + j, f"t{j}", "u", None if j else 's "x"', "bm25", j + 1, None if j % 2 else True) for k in range(50) for j in range(k % 4 + 1)]
    pool = spark.createDataFrame(rows, "query_id long, doc_id long, title string, url string, snippet string, first_system string, position long, relevant boolean").repartition(6)
    at = str(tmp_path / "pool")
    files.write_pool(pool.where("query_id < 30"), queries, at)
    files.write_pool(pool.where("query_id >= 30"), queries, at, append=True)
    name = dict(names)
    want = sorted((name[r[0]], r[6], r[1], r[4], r[7]) for r in rows)
    assert sorted(tuple(r) for r in files.read_pool(spark, at).select("query", "position", "doc_id", "snippet", "relevant").collect()) == want
    assert files.read_labels(spark, at).isEmpty()
    files.add_labels(spark, [("query 3", 31, False)], at)
    files.add_labels(spark, [("query 3", 33, True)], at)
    labelled = {(r["query"], r["doc_id"]): r["relevant"] for r in session.labelled_pool(spark, at).collect()}
    assert labelled[("query 3", 31)] is False and labelled[("query 3", 33)] is True and labelled[("query 3", 30)] is True
    qrels = spark.createDataFrame([(k, [k, k + 1]) for k in range(50)], "query_id long, relevant_doc_ids array<long>").repartition(7)
    files.write_qrels(qrels, queries, str(tmp_path / "gt"))
    assert sorted(tuple(r) for r in files.read_qrels(spark, str(tmp_path / "gt")).collect()) == sorted((name[k], d) for k in range(50) for d in (k, k + 1))
    (tmp_path / "array.json").write_text(json.dumps([{"query": q, "relevant_doc_ids": [k]} for k, q in names], indent=2))
    assert files.read_qrels(spark, str(tmp_path / "array.json")).count() == 50
