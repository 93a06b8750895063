import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.constants import DEFAULT_QUERIES, EFFECTIVE_STOP_WORDS
from lexmill.functions import text as T
from lexmill.functions.porter import stem_column
from lexmill.operators import index, search


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("getUserById(user_id)", "getuserbyid get user by id user_id"),
        ("def calculate_total_price(items):", "def calculate_total_price calculate total price items"),
        ("const fetchUserData = async () => {}", "const fetchuserdata fetch user data async"),
        ("TypeError: list index out of range", "typeerror type error list index out of range"),
        ("addEventListener('click', handleButtonClick)", "addeventlistener add event listener click handlebuttonclick handle button"),
        ("HTMLParser.feed(data)", "htmlparser.feed html parser feed data"),
        ("", ""),
        (None, ""),
    ],
)
def test_code_tokens(spark, text, tokens):
    assert one(spark, text, lambda c: F.array_distinct(T.code_words(c))) == tokens.split()


@pytest.mark.parametrize(("query", "tokens"), [("get user by id", "get user id by"), ("getUserById", "getuserbyid get user by id"), ("python list comprehension", "python list comprehens comprehension"), ("of the", "of the"), ("", "")])
def test_query_tokens(spark, query, tokens):
    got = search.query_terms(spark.createDataFrame([(1, query)], "query_id long, query string")).collect()
    assert {r["term"] for r in got} == set(tokens.split())


def test_prose_words(spark):
    assert one(spark, "The Café is a while-loop, x 42!", T.prose_words) == ["caf", "is", "while", "loop", "42"]
    assert "while" not in EFFECTIVE_STOP_WORDS and "the" in EFFECTIVE_STOP_WORDS
    assert one(spark, None, T.prose_words) == []


PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "comprehension": "comprehens", "is": "is", "as": "as",
}


#: Published with the algorithm: the first words under consig- to consta- and knack to knots of its sample vocabulary.
PORTER_SAMPLE = dict(pair.split() for pair in """
consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consisting consist
consists consist|consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid
consoling consol|consolingly consolingli|consols consol|consonant conson|consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci
conspirator conspir|conspirators conspir|conspire conspir|conspired conspir|conspiring conspir|constable constabl|constables constabl|constance constanc|constancy constanc|constant constant
knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead|knee knee
kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif
knife knife|knight knight|knightly knightli|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive|knob knob
knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot
""".replace("\n", "|").strip("|").split("|"))


def test_porter_sample(spark):
    assert len(PORTER_SAMPLE) == 80
    words = spark.createDataFrame([(w,) for w in PORTER_SAMPLE], "w string")
    assert {r["w"]: r["s"] for r in stem_column(words, "w", "s").collect()} == PORTER_SAMPLE


def test_porter(spark):
    words = spark.createDataFrame([(w,) for w in PORTER], "w string")
    got = {r["w"]: r["s"] for r in stem_column(words, "w", "s").collect()}
    assert got == PORTER


def test_snippet(spark):
    assert one(spark, "  short  ", T.snippet) == "short"
    long = "word " * 60
    assert one(spark, long, T.snippet) == ("word " * 40).strip()[:199] + "..."
    assert one(spark, "x" * 300, T.snippet) == "x" * 200 + "..."
    assert one(spark, None, T.snippet) == ""


def by_counting(text, terms, width=150):
    import re

    places = [m.start() for m in re.finditer("|".join(map(re.escape, terms)), text, re.IGNORECASE)]
    best, count = 0, 0
    for p in places:
        s = max(0, p - width // 2)
        n = sum(s <= q < s + width for q in places)
        if n > count:
            best, count = s, n
    return text[best : best + width]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta", "gamma", "x", "delta!"]), min_size=40, max_size=120), st.lists(st.sampled_from(["alpha", "beta", "zz"]), min_size=1, max_size=3))
def test_window_is_the_densest(words, terms):
    text = " ".join(words)
    if len(text) > 150:
        assert T.window_of(text, terms) == by_counting(text, terms)


def test_window_edges(spark):
    assert T.window_of(None, ["a"]) == "" and T.window_of("abc", None) == "abc" and T.window_of("<b>a</b>&nbsp;b", []) == "a b"
    df = spark.createDataFrame([("q " * 100 + "needle " * 3, ["needle"])], "t string, w array<string>")
    assert "needle needle needle" in df.select(T.best_window("t", "w").alias("y")).first()["y"]


def test_highlight(spark):
    assert one(spark, "A list of Lists", lambda c: T.highlight(c, ["list", "of"])) == "A **list** **of** **List**s"
    assert one(spark, "a", lambda c: T.highlight(c, [])) == "a"


def test_built_in_queries(spark):
    from lexmill.sources.files import read_queries

    assert len(DEFAULT_QUERIES) == 20 == read_queries(spark).count()


def test_repeats_do_not_change_scores(spark):
    schema = "id long, title string, prose_text string, code_text string, source string, url string, score long, is_accepted boolean"
    once = spark.createDataFrame([(0, "", "alpha beta", "", "", "", 0, False), (1, "", "alpha gamma delta", "", "", "", 0, False), (2, "", "", "", "", "", 0, False)], schema)
    twice = once.withColumn("prose_text", F.concat_ws(" ", "prose_text", "prose_text"))
    a, b = ({(r["term"], r["doc_id"]): (round(r["tf_idf"], 6), round(r["bm25"], 6)) for r in index.build_index(c, stem=False).postings.collect()} for c in (once, twice))
    assert a == b == {("alpha", 0): (0.202733, 0.431196), ("beta", 0): (0.549306, 0.899843), ("alpha", 1): (0.135155, 0.345591), ("gamma", 1): (0.366204, 0.721198), ("delta", 1): (0.366204, 0.721198)}
    titled = once.withColumn("title", F.lit("Alpha Gammas"))
    got = {(r["term"], r["doc_id"]): round(r["bm25"], 6) for r in index.build_index(titled, stem=True).postings.collect()}
    assert got["alpha", 0] == 1.07799 and got["gamma", 1] == 1.802995
