import json

import pytest

from lexmill import __main__ as cli
from lexmill.operators import pooling, session
from lexmill.operators.index import Index
from lexmill.operators.robots import allowed_by_robots
from lexmill.sources import files
from lexmill.streaming.corpus import answer_queries, append_corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    (at / "q.csv").write_text('Id,Score,Title,Body,AcceptedAnswerId\n1,5,Sort a list,"<p>How to sort a python list?</p>",10\n2,1,Read files,"<p>open and read</p>",\n')
    (at / "a.csv").write_text('Id,ParentId,Score,Body\n10,1,9,"<p>Use sorted on the list</p><pre>sorted(x)</pre>"\n')

    def command(*args):
        return cli.run(spark, cli._arguments(list(args)))

    command("ingest", "--questions", str(at / "q.csv"), "--answers", str(at / "a.csv"), "--output", str(at / "corpus"))
    command("ingest", "--questions", str(at / "q.csv"), "--answers", str(at / "a.csv"), "--output", str(at / "corpus"))
    command("index", "--input", str(at / "corpus"), "--index", str(at / "index"))
    return at, command


def test_command_line(folder, spark):
    at, command = folder
    assert sorted(r["id"] for r in spark.read.json(str(at / "corpus")).collect()) == list(range(6))
    rows = command("search", "--query", "python list sorted", "--index", str(at / "index")).collect()
    assert rows[0]["doc_id"] in (2, 5) and rows[0]["is_accepted"]
    assert command("search", "--query", "zzz", "--index", str(at / "index"), "--mode", "tfidf", "--no-boost").isEmpty()
    assert command("explain", "--query", "list", "--index", str(at / "index")).first()["title_hits"] == 1
    (at / "gt.json").write_text(json.dumps([{"query": "sorted list", "relevant_doc_ids": [2]}]))
    assert command("evaluate", "--gt", str(at / "gt.json"), "--index", str(at / "index")).count() == 6
    assert command("index", "--input", str(at / "corpus"), "--index", str(at / "index"), "--test").where("term = 'list'").first()["found"] >= 2


def test_pool_and_labels(folder, spark):
    """Pools grow by new queries only; labels are saved query by query, and a session goes on where the last ended."""
    at, _ = folder
    said, shown = [], []

    def command(*args):
        return cli.run(spark, cli._arguments(["pool", "--pool", str(at / "pool"), "--gt", str(at / "labels"), *args]), lambda q: said.pop(0), shown.append)

    (at / "queries.txt").write_text("python list\n")
    build = ("--queries", str(at / "queries.txt"), "--index", str(at / "index"))
    command(*build, "--pool-only")
    n = files.read_pool(spark, str(at / "pool")).count()
    (at / "queries.txt").write_text("python list\nread files\n")
    command(*build, "--pool-only", "--resume")
    pool = files.read_pool(spark, str(at / "pool"))
    assert pool.where("query = 'python list'").count() == n and pool.select("query").distinct().count() == 2 and pool.where("relevant is not null").isEmpty()
    said[:] = ["maybe", "y", *["n"] * (n - 1), "q"]
    command("--label-only")
    assert not said and shown[-1].startswith("Progress saved") and "  Please enter y, n, s, or q" in shown
    assert [r["query"] for r in files.read_qrels(spark, str(at / "labels")).collect()] == ["python list"]
    said[:] = ["s"] + ["y"] * (pool.count() - n - 1)
    command("--label-only", "--resume")
    assert not said and session.labelled_pool(spark, str(at / "pool")).where("relevant is null").count() == 1
    assert command(*build, "--pool-only") is None
    assert cli.run(spark, cli._arguments(["evaluate", "--gt", str(at / "labels"), "--index", str(at / "index")])).count() == 6


def test_a_system_that_fails_is_left_out(folder, spark, monkeypatch):
    at, _ = folder

    def broken(*a, **k):
        raise ValueError("broken")

    monkeypatch.setattr(pooling, "pseudo_feedback", broken)
    queries = spark.createDataFrame([(1, "python list")], "query_id long, query string")
    told = []
    runs = pooling.system_runs(queries, Index.read(spark, str(at / "index")), failed=lambda name, e: told.append((name, str(e))))
    assert told == [("rocchio", "broken")] and runs.select("system").distinct().count() == 3
    with pytest.raises(ValueError):
        pooling.system_runs(queries, Index.read(spark, str(at / "index")))


def test_search_session(folder, spark):
    at, _ = folder
    said, shown = ["r", "n", "q", "q"], []
    rows = cli.run(spark, cli._arguments(["feedback", "--query", "python list sorted", "--index", str(at / "index")]), lambda q: said.pop(0), shown.append).collect()
    assert not said and "Re-ranked" in shown and rows[0]["rank"] == 1 and any("**list**" in x for x in shown)
    said, shown = ["s"] * 9, []
    session.search_session("python list", Index.read(spark, str(at / "index")), lambda q: said.pop(0), shown.append, top_k=2)
    assert len(said) == 7 and "Re-ranked" not in shown  # nothing judged: no second round


def test_crawl_command(folder, spark):
    at, command = folder
    page = "<h1>Good title</h1><article><p>" + "word " * 40 + '<a href="b.html">l</a></p></article>'
    spark.createDataFrame([("https://docs.python.org/3/a.html", page), ("https://docs.python.org/3/b.html", page)], "url string, html string").write.parquet(str(at / "pages"))
    command("crawl", "--pages", str(at / "pages"), "--output", str(at / "crawled"), "--url", "https://docs.python.org/3/a.html")
    assert sorted((r["id"], r["url"][-6:]) for r in files.read_corpus(spark, str(at / "crawled")).collect()) == [(0, "a.html"), (1, "b.html")]
    command("crawl", "--pages", str(at / "pages"), "--output", str(at / "crawled2"))
    assert files.read_corpus(spark, str(at / "crawled2")).isEmpty()  # none of the built-in addresses is in the table


def test_streams(folder, spark):
    at, _ = folder
    table, check = str(at / "table"), str(at / "check")
    append_corpus(spark, str(at / "corpus"), table, check).awaitTermination()
    append_corpus(spark, str(at / "corpus"), table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 6
    (at / "stream").mkdir()
    (at / "stream" / "q.json").write_text('{"query_id": 1, "query": "python list"}\n')
    queries = spark.readStream.schema("query_id long, query string").json(str(at / "stream"))
    answer_queries(queries, Index.read(spark, str(at / "index")), str(at / "results"), str(at / "check2")).awaitTermination()
    assert spark.read.parquet(str(at / "results")).where("rank = 1").count() == 1


def test_robots(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x/1"), (2, "https://a.org/y"), (3, "https://b.org/x"), (4, None)], "k long, url string")
    robots = spark.createDataFrame([("https://a.org", "User-agent: own\nDisallow: /x\nUser-agent: *\nDisallow: /x\nDisallow: /y")], "site string, text string")
    assert {r["k"]: r["allowed"] for r in allowed_by_robots(pages, robots, "own").collect()} == {1: False, 2: True, 3: True, 4: True}
