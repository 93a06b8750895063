import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from compare import same
from pyspark.sql import functions as F

from lexmill.llm import boosting, bpe, common, exact_dedup, lbl, lm, minhash, mixing, pii, quality, queries, toxicity, url_filter, vectors

DOCS = "doc_id long, text string, source string, TEXT_SHA256 string, row long, kept string, n long"  # names that results use, too


def table(spark, rows):
    """(doc_id, text, source) rows with further columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 7, "y", 9) for r in rows], DOCS)


ODD = [(3, None, "a"), (1, "", None), (2, " \t\n", "b"), (None, "Null id", "a"), (5, "one", "b"), (5, "one", "b"), (6, "x" * 70_000, "c"), (7, "Wörd " * 9000, None), (8, "Wörd  \n" * 9000, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), queries.ORACLES[name], data)


def test_all_ten_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))


# 1: URL filters -------------------------------------------------------------------------------------------------------

URLS = ["https://A.Example.NET/en/1", "http://example.net/en", "http://xnet/", "http://net", "http://a.net/x?q", "HTTP://b.example.com/de/?x", "http://c.org/fr/#t", "ftp://c.org/en/fr/", None, "", "no scheme", "x://y://example.net/en/", "http://example.net:80/en/", "http://ÀB.org/fr/", "http://example.net./en/"]


def by_definition(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(h.count("."), len(p), k, h + p, v) for k, (h, p, v) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


@pytest.mark.parametrize("limit", [url_filter.RULE_BYTES, 0])
@pytest.mark.parametrize("more", [[], [("example.net", "/en/1", "block"), ("example.net", "/e", "block"), ("net", "", "allow"), ("com", "/de", "allow"), ("example.net", "/en/", "block")]])
def test_url_rules(spark, limit, more):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = url_filter.RULES + more
    got = {r[0]: r[1:] for r in rows(url_filter.judge(pages, rules, rule_bytes=limit), "page_id", "host", "path", "rule", "verdict")}
    assert got == {k: by_definition(u, rules) for k, u in enumerate(URLS)}
    long = ["https://" + "a." * 20_000 + "example.net/en/" + "x/" * 20_000, "http://c.org/fr/" + "y" * 100_000 + "?q"]
    again = url_filter.judge(spark.createDataFrame([(k % 2, long[k % 2], "h") for k in range(6)] + [(None, long[1], "h")], pages.schema), rules, rule_bytes=limit).collect()
    assert Counter((r["page_id"], r["path"], r["rule"]) for r in again) == Counter((k, by_definition(u, rules)[1], by_definition(u, rules)[2]) for k, u in [(0, long[0]), (1, long[1])] * 3 + [(None, long[1])])
    assert url_filter.judge(pages.where("false")).isEmpty()


# 2: exact deduplication -----------------------------------------------------------------------------------------------


def exact_by_hand(rows_):
    groups = {}
    for doc, text, *_ in rows_:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    out = []
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i))
        out += [(i, order[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(order)]
    return Counter(out)


@pytest.mark.parametrize(("case", "fits"), [("odd", True), ("hot", True), ("hot", False), ("empty", True)])
def test_exact_dedup(spark, odd, case, fits, monkeypatch):
    if not fits:  # groups are shuffled instead of broadcast
        monkeypatch.setattr(exact_dedup, "small", lambda *a: False)
    many = [(k, "hot  text" if k % 3 == 0 else f"t{k % 300}", "s") for k in range(1500, 0, -1)] + [(9, "hot text", "s")] * 2
    data = {"odd": ODD, "hot": many, "empty": []}[case]
    df = table(spark, data)
    got = Counter(rows(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    assert got == exact_by_hand(data)
    kept = Counter((r[0], r[1]) for r in rows(exact_dedup.keep_first(df), "doc_id", "text"))
    assert sum(kept.values()) == sum(n for (_, _, _, k, _), n in got.items() if k)
    assert exact_dedup.keep_first(df).columns == df.columns


# 3: toxicity ----------------------------------------------------------------------------------------------------------


def toxic_corpus(n=900):
    rng = random.Random(3)
    out = []
    for k in range(n):
        bad = k % 4 == 0
        text = words_of(rng, 60)
        if bad:
            text += " " + rng.choice(["you idiot", "Idi0t you are", "such mordenk" + rng.choice("abc"), "mordenk" + rng.choice("xyz")]) + " " + words_of(rng, 5)
        out.append((k, text, int(bad)))
    return out


def test_toxicity(spark):
    data = toxic_corpus()
    docs = table(spark, [(k, t, "s") for k, t, _ in data] + [(10_000, None, "s"), (10_001, "", "s"), (None, "idiot", "s")])
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {k: y for k, _, y in data}
    held = [r for k, r in got.items() if k in truth and r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert got[10_000]["score"] == got[10_001]["score"] < 0.5
    assert got[None]["held_out"] is False


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(odd, none).collect()] == [0.0] * len(ODD)
    assert toxicity.toxicity(odd.where("false"), none).isEmpty()


def slow_features(text, lexicon):
    """Every feature word by word, by definition."""
    text = text or ""
    w = toxicity._WORD.findall(text.lower())
    if not w:
        return [0.0] * toxicity.FEATURES

    def own(x):
        return max([lexicon.get(x, 0.0)] + [lexicon.get(x[:k] + "*", 0.0) for k in (4, 5, 6)])

    odd = [not x.isalpha() and not x.isdigit() for x in w]
    weight = [max(own(x), own(re.sub(r"[\W\d_]", "", x.translate(toxicity.LEET)))) if o else own(x) for x, o in zip(w, odd, strict=True)]
    at = [i for i, x in enumerate(weight) if x]
    near = sum(any(abs(i - j) <= 4 and w[j] in toxicity.SECOND_PERSON for j in range(len(w))) for i in at)
    exact = sum(w[i] in lexicon for i in at)
    n, k, tokens = len(w), len(at), text.split()
    return [
        math.log(1 + n), k / n, math.log(1 + k), exact / n, math.log(1 + exact), sum(weight) / n, max(weight), math.log(1 + sum(weight)), near / k if k else 0, math.log(1 + near),
        sum(x in toxicity.SECOND_PERSON for x in w) / n, len({w[i] for i in at}), sum(x.isupper() for x in tokens) / len(tokens), sum(not (c.isalnum() or c == "_" or c.isspace()) for c in text) / len(text), sum(odd) / n,
    ]


def test_toxic_features_against_a_slow_version():
    rng = random.Random(7)
    lexicon = {"idiot": 3.5, "idio*": 2.0, "stupi*": 2.5, "trash": 4.0, "scum*": 1.5}
    pieces = ["you", "Dein", "idiot", "IDIOT!", "id1ot", "i-d-i-o-t", "stupidly", "trash,", "tr@sh", "scumbag", "scum", "ok", "12", "a1", "Étude", "they", "vous...", "!!!", "x_y"]
    hits = toxicity.Hits(lexicon)
    for _ in range(500):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert toxicity.features(text, hits) == pytest.approx(slow_features(text, lexicon)), text
    assert toxicity.features(None, hits) == slow_features(None, lexicon)


def test_isotonic_against_max_min():
    """Isotonic regression is, at each point, the greatest over starts of the least over ends of the mean between.

    Its level stretches are the blocks, each at the mean of its margins, with a little of one half mixed in.
    """
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.permutation(30).astype(float)
        y = (rng.random(30) < x / 30).astype(float)
        at, level = boosting.isotonic(x, y)
        s = y[np.argsort(x)]
        want = [max(min(s[j : k + 1].mean() for k in range(i, 30)) for j in range(i + 1)) for i in range(30)]
        groups = [np.flatnonzero(np.isclose(want, v)) for v in sorted({round(v, 9) for v in want})]
        assert at == pytest.approx([g.mean() for g in groups])
        assert level == pytest.approx([(want[g[0]] * len(g) + 0.02) / (len(g) + 0.04) for g in groups])


def test_toxicity_of_string_ids_and_a_hot_id(spark):
    """Ids of text, an id that occurs very often, labels that disagree; and the same scores when rows are dealt otherwise."""
    data = toxic_corpus(600)
    docs = [(f"d{k}", t) for k, t, _ in data] + [("d8", data[8][1])] * 3000 + [(None, "you idiot"), ("d9", None), ("long", "word " * 50_000)]
    labels = [(f"d{k}", y) for k, _, y in data] + [("d3", 0), ("d4", 0), (None, 1), ("d7", None)]
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id string, text string, x string, fitting int")
    own = spark.createDataFrame(labels, "doc_id string, toxic int")
    got = toxicity.toxicity(df, own).collect()
    truth = {f"d{k}": y for k, _, y in data}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != "d9"]
    assert len(got) == len(docs) and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    again = toxicity.toxicity(df.repartition(5), own).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert {r["held_out"] for r in got if r["doc_id"] == "d8"} == {zlib.crc32(b"d8") % 3 == 1}


# 4: quality -----------------------------------------------------------------------------------------------------------


def quality_corpus(n=400):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    out = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(120)]
        for i in range(0, 120, 9):
            w[i] = w[i].capitalize()
            w[i - 1] += "."
        kind = k % 10
        if kind == 0:
            w = [x for x in w[:12] for _ in range(10)]
        elif kind == 1:
            w = [x + "$$$" for x in w]
        elif kind == 2:
            w = [x.upper() + "!!" for x in w]
        out.append((k, " ".join(w), int(kind > 2)))
    return out


def test_quality(spark):
    data = quality_corpus()
    df = table(spark, [(k, t, "s") for k, t, _ in data] + [(999, None, "s"), (998, " ", "s")])
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert sum(got[k]["kept"] == bool(y) for k, _, y in data) / len(data) > 0.97
    assert got[999]["score"] == 0 and not got[998]["kept"] and got[998]["posterior"] is None
    kept = {r[0] for r in rows(quality.keep_good(df), "doc_id")}
    assert kept == {k for k, r in got.items() if r["kept"]} and quality.keep_good(df).columns == df.columns
    assert quality.quality(df.where("false")).isEmpty()


@pytest.mark.parametrize("wrong", [0.003, 0.02, 0.05])
def test_expectation_maximisation_finds_accuracies(wrong):
    """How often each labeller is right about good and about bad documents, with nothing set by hand."""
    rng = np.random.default_rng(1)
    good = rng.random(8000) < 0.8
    sees = (0.95, 0.8, 0.7, 0.4)
    letters = ["".join("-" if rng.random() < 0.1 else "b" if rng.random() < (wrong if t else p) else "g" for p in sees) for t in good]
    post, table, prior = quality.expectation_maximisation(Counter(letters))
    assert abs(prior - good.mean()) < 0.02
    assert table[1, :, 1] == pytest.approx(sees, abs=0.06) and table[0, :, 1] == pytest.approx([wrong] * 4, abs=0.012)
    assert sum((post[v] > 0.5) == t for v, t in zip(letters, good, strict=True)) / len(good) > 0.96
    assert quality.expectation_maximisation({})[0] == {}


def test_expectation_maximisation_of_dependent_labellers():
    """Two kinds of bad documents, each seen by two labellers together and by no other; a fifth is often wrong."""
    rng = np.random.default_rng(2)
    kind = rng.choice(3, 9000, p=[0.85, 0.1, 0.05])
    letters = ["".join("b" if rng.random() < p else "g" for p in ((0.9, 0.9, 0.001, 0.001) if k == 1 else (0.001, 0.001, 0.9, 0.9) if k == 2 else (0.002,) * 4)) + ("b" if rng.random() < 0.2 else "g") for k in kind]
    post, table, prior = quality.expectation_maximisation(Counter(letters))
    assert sum((post[v] > 0.5) == (k == 0) for v, k in zip(letters, kind, strict=True)) / len(kind) > 0.97
    assert table[0, :4, 1].max() < 0.02 and abs(table[0, 4, 1] - 0.2) < 0.02 and abs(table[1, 0, 1] - 0.6) < 0.1 and abs(table[1, 2, 1] - 0.3) < 0.1


def slow_measures(text):
    """The rates, word by word and by definition."""
    w = (text or "").split()
    n = len(w)
    if not n:
        return None
    marked = [x[-1] in quality.MARKS or len(x) > 2 and not x[-1].isalnum() and x[-1] == x[-2] for x in w]
    ends = [x[-1] in ".!?" and not (len(x) > 2 and x[-1] == x[-2]) for x in w]
    letters = [sum(c.isalpha() for c in x) for x in w]
    chars = sum(map(len, w))
    return [
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, sum(not c.isalnum() for x in w for c in x) / chars, len(set(w)) / n, sum(k > 1 and x.isupper() for k, x in zip(letters, w, strict=True)) / n,
        sum(k == 0 for k in letters) / n, sum(marked) / n, sum(ends) / n, max(Counter(w).values()) / n, chars / n, sum(len(x) <= 3 for x in w) / n, n,
    ]


def test_measures_against_a_slow_version():
    rng = random.Random(6)
    pieces = ["a", "The", "USA", "ok.", "what?!", "no!!", "x$", "$$$", "12", "3.5", "É", "ÉCOLE", "état,", "a-b", "end...", "&&", "I", "word#", "IT'S", "Mc9x", "ß"]
    shapes = quality.Shapes()
    for _ in range(600):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        want, got = slow_measures(text), quality.measures(text, shapes)
        assert (got is None) == (want is None)
        if want:
            assert got[0].tolist() == pytest.approx(want), text
    assert quality.measures(None, shapes) is None
    votes = {quality.votes(np.array(slow_measures(t))) for t in ("good words here, and more of them to read.", "$$$ ### !!! " * 20, "a a a a a a a a a a")}
    assert len(votes) == 3 and all(len(v) == len(quality.LABELLERS) for v in votes)


def test_quality_with_a_hot_text_and_odd_rows(spark):
    """A text that nearly all rows have is one of the texts learned from; results of reruns are the same to the bit."""
    data = quality_corpus(300)
    hot = [(10_000 + k, data[5][1], "s") for k in range(9000)]
    extra = [(None, data[4][1], "s"), (20_000, "word " * 60_000, "s"), (20_000, data[6][1], "s"), (20_001, None, "s"), (20_002, "", "s")]
    df = table(spark, [(k, t, "s") for k, t, _ in data] + hot + extra)
    first = quality.quality(df.repartition(5))
    got = {r["doc_id"]: r["kept"] for r in first.collect()}
    assert sum(got[k] == bool(y) for k, _, y in data) / len(data) > 0.97
    assert first.count() == 300 + 9000 + 5 and not got[20_001] and not got[20_002] and got[None]
    again = quality.quality(df.repartition(3))
    assert Counter(map(tuple, first.collect())) == Counter(map(tuple, again.collect()))
    some = quality.fit(df, "text", 100)[0]
    assert (some == quality.fit(df.repartition(2), "text", 100)[0]).all()


def test_posteriors_against_a_slow_count(spark):
    """Patterns are counted over all documents: each document's posterior is that of expectation-maximisation on plain counts."""
    data = quality_corpus(200)
    patterns = {k: quality.votes(np.array(slow_measures(t))) for k, t, _ in data}
    post = quality.expectation_maximisation(Counter(patterns.values()))[0]
    for r in quality.quality(table(spark, [(k, t, "s") for k, t, _ in data])).collect():
        assert r["posterior"] == pytest.approx(post[patterns[r["doc_id"]]])


# 5: language model ----------------------------------------------------------------------------------------------------


def held_out(k):
    return zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 1


LM_DATA = [(k, " ".join(f"{'aeiou'[j % 5]}{(k * 7 + j * 3) % 50}" for j in range(40)), "s") for k in range(60)]


def test_lm_base_scores_and_sums(spark):
    data = [*LM_DATA, (100, None, "s"), (101, "NEW a1", "s"), (100, None, "s"), (None, "b", "s")]
    got = lm.lm_scores(table(spark, data)).collect()
    tokens = {k: [*(t or "").lower().split(), "\n"] for k, t, _ in data}
    counts = Counter()
    for k, t, _ in data:
        if not held_out(k):
            counts.update([*(t or "").lower().split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(data)
    for r in got:
        t = tokens[r["doc_id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(t) and r["held_out"] == held_out(r["doc_id"])
        assert r["n_known"] == sum(counts[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] < 0
    full = [r for r in got if r["n_tokens"] == 41]
    assert sum(r["score"] for r in full) > sum(r["base_score"] for r in full)


def slow_lm(model, counts):
    """P(word | three words before) from the network's numbers by an explicit softmax; None stands for an unseen word."""
    v, net = model.vocabulary, model.scorer
    words = {w: i for i, w in enumerate(v.words.to_pylist())}
    number = lambda w: words[w] if w in words else len(words) + lm.kind_of(w[-lm.ENDING :])
    mass = {}
    for w, c in counts.items():
        i = number(w)
        if v.slots[i] == lbl.SLOTS - 1:
            mass[v.classes[i]] = mass.get(v.classes[i], 0.5) + c + 0.5

    def p(word, before, c=None):
        h = sum(net.turned[k][v.inputs[number(w)]].astype(float) for k, w in enumerate(before))
        i = None if word is None else number(word)
        k, slot = (c, lbl.SLOTS - 1) if word is None else (v.classes[i], v.slots[i])
        s, t = np.exp(net.q.astype(float) @ h), np.exp(net.u[k].astype(float) @ h)
        part = (counts.get(word, 0) + 0.5) / mass.get(k, 0.5) if slot == lbl.SLOTS - 1 else 1.0
        return s[k] / s.sum() * t[slot] / t.sum() * part

    return p


def test_lm_is_normalised_over_the_vocabulary(spark, monkeypatch):
    """Every probability by brute force: they add up to one over all words, and scores are their products."""
    every = lm.frequent
    monkeypatch.setattr(lm, "frequent", lambda counts: every(counts, 120))  # the other words are joined
    monkeypatch.setattr(lm, "PIECE", 700)
    data = [*LM_DATA, (201, "a1 NEVER seen, a1", "s"), (202, None, "s"), (203, "  e4\n\ta1 e4 ", "s")]
    df = table(spark, data)
    model, counted = lm.fit(df, "doc_id", "text")
    counts = {r["token"]: r["c"] for r in counted.collect()}
    assert len(counts) > 130 > len(model.vocabulary.words)
    p = slow_lm(model, counts)
    for before in (("\n", "\n", "\n"), ("a1", "u4", "\n"), ("zzz", "i9", "e1")):
        assert sum(p(w, before) for w in counts) + sum(p(None, before, c) for c in range(lbl.CLASSES)) == pytest.approx(1, abs=1e-4)
    monkeypatch.setattr(lm, "fit", lambda *a: (model, counted))
    texts = {k: t for k, t, _ in data}
    for r in lm.lm_scores(df).collect():
        w = ["\n"] * 3 + (texts[r["doc_id"]] or "").lower().split() + ["\n"]
        assert r["score"] == pytest.approx(sum(math.log10(p(w[k], (w[k - 1], w[k - 2], w[k - 3]))) for k in range(3, len(w))), abs=1e-3)


def test_lm_rounds_in_many_tasks(spark, monkeypatch):
    """Copies trained in several tasks are averaged by a tree of sums, and what they learn stays."""
    monkeypatch.setattr(lm, "TOKENS_A_TASK", 300)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rng = random.Random(4)
    data = [(k, " ".join(f"w{(7 * j + k) % 20}" if rng.random() < 0.9 else f"x{rng.randrange(300)}" for j in range(60)), "s") for k in range(150)]
    got = lm.lm_scores(table(spark, data).repartition(9)).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.3


@pytest.mark.parametrize("texts", [3, 200, 30_000])
def test_lm_targets_are_all_tokens_at_any_size(texts):
    """Each token is learned from once, in few texts and in many, in blocks that don't depend on what comes later."""
    words = [f"w{i}" for i in range(90)] + [lm.END]
    v = lm.Vocabulary.make(words, np.arange(len(words), 0, -1), np.arange(lm.KINDS) % lbl.CLASSES)
    stream = v.code(pa.array([" ".join(f"w{(i * j) % 97}" for j in range(i % 199)) for i in range(texts)]))
    tokens = len(stream.codes)

    class Seen:
        seen = 0

        def __init__(self):
            self.slots, self.blocks = np.zeros((lbl.CLASSES, lbl.SLOTS), int), []

        def learn(self, before, classes, slots, rng):
            assert before.shape == (lbl.PLACES, len(classes))
            np.add.at(self.slots, (classes, slots), 1)
            self.blocks.append(len(classes))

    net, used = Seen(), np.zeros(lm.INPUTS + lm.KINDS, np.float32)
    assert lm.learn(net, stream, v, used, np.random.default_rng(1)) == tokens == net.seen
    want = np.zeros_like(net.slots)
    np.add.at(want, (v.classes[stream.codes], v.slots[stream.codes]), 1)
    assert (net.slots == want).all() and used.sum() == lbl.PLACES * tokens
    at, k = [], 0
    while k < tokens:
        at.append(min(max(32, k // 1024), 1024, tokens - k))
        k += at[-1]
    assert net.blocks == at


def test_network_learns_and_is_normalised():
    """Each word is followed by one of two: noise-contrastive estimation finds them, and the softmax agrees with a slow one."""
    rng = np.random.default_rng(4)
    net = lbl.Network(40, np.ones(8), np.ones((8, 8)))
    for _ in range(400):
        before = rng.integers(0, 40, (lbl.PLACES, 256))
        net.learn(before, before[0] % 8, (before[1] % 4) + 4 * rng.integers(0, 2, 256), rng)
    before = rng.integers(0, 40, (lbl.PLACES, 50))
    own = net.scorer()
    p = np.exp([[own.log_p(before, np.full(50, c), np.full(50, s)) for s in range(8)] for c in range(8)])
    assert p.sum((0, 1)) == pytest.approx(np.ones(50), abs=1e-4)
    assert p.sum(1)[before[0] % 8, np.arange(50)].mean() > 0.9
    right = p[before[0] % 8, before[1] % 4, np.arange(50)] + p[before[0] % 8, before[1] % 4 + 4, np.arange(50)]
    assert right.mean() > 0.8
    h, far = np.ones((3, 2), np.float32), np.array([[90, 90], [-90, -90], [80, 90]], np.float32)  # beyond single precision
    assert lbl.normalised(h, far, np.array([0, 0, 2])) == pytest.approx([0, 0, -10], abs=1e-3)


def test_words_split_as_bytes_do():
    rng = random.Random(3)
    texts = [None, "", " ", "a", " a  b ", "ÀB\u00a0c\u2003D", *("".join(rng.choice(" \t\n\v\f\r\x1c\x85\u00a0aBé") for _ in range(12)) for _ in range(400))]
    words, n = lm.split(pa.array(texts, pa.string()))
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in (t or "").encode().lower().split()]
    assert n.tolist() == [len((t or "").encode().split()) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    assert [x for p in lm.pieces([batch], 0) for x in p.column(0).to_pylist()] == texts


def test_lm_end_token_beyond_the_known(spark, monkeypatch):
    """Few long texts: more words are as frequent as the end token than workers hold. It is known all the same."""
    every = lm.frequent
    monkeypatch.setattr(lm, "frequent", lambda counts: every(counts, 5))
    data = [(k, " ".join([f"w{j}" for j in range(30)] + ["often"] * 9), "s") for k in range(12)]
    data = [d for d in data if not held_out(d[0])]
    counts = Counter(w for _, t, _ in data for w in [*t.split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    for r in lm.lm_scores(table(spark, data)).collect():
        assert r["n_known"] == r["n_tokens"] == 40
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*data[0][1].split(), "\n"]))


def test_lm_on_nothing(spark, odd):
    assert lm.lm_scores(odd.where("false")).isEmpty()
    got = Counter((r["doc_id"], r["n_tokens"], r["held_out"]) for r in lm.lm_scores(odd).collect())
    assert got == Counter((k, len((t or "").encode().split()) + 1, held_out(k)) for k, t, _ in ODD)


# 6: personal data -----------------------------------------------------------------------------------------------------

_REGULAR = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_regex(text):
    out = {}
    for kind, pattern in _REGULAR.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            spans += [m.span()] * ok
        out[kind] = spans
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    pieces = ["a", "B9", "@", ".", "@x.com", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "-", " ", "00", "é", "_", "+", "%", "..", "1", "22", "(", "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == base_by_regex(text), text


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000):
        pii.base_spans(text)


def test_personal_data(spark, odd):
    rng = random.Random(1)
    rows_ = [(k, f"{words_of(rng, 8)} {rng.choice(['reach', 'contact'])} desk a{k}x@mail.example.com {words_of(rng, 5)}", "s") for k in range(40)]
    rows_ += [(100, "please contact desk k0012-77431 soon", "s"), (101, "number 12345678 w1 w2", "s"), (102, None, "s"), (103, "mail: q@r.st or +49 (30) 1234-5678.", "s")]
    got = {r["doc_id"]: r for r in pii.personal_data(table(spark, rows_)).collect()}
    assert got[100]["spans"] == "id:20:31" and got[100]["n_email"] == 0
    assert got[101]["spans"] == "" and got[102]["spans"] == ""
    assert got[103]["spans"] == "email:6:12,phone:16:34" and got[103]["n_phone"] == 1
    assert got[102]["base_sha256"] == got[101]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[103]["base_sha256"] == hashlib.sha256(b"email:6:12,phone:16:34").hexdigest()
    got = Counter((r["doc_id"], r["n_email"], r["n_found"], r["spans"]) for r in pii.personal_data(odd).collect())
    assert got == Counter((k, 0, 0, "") for k, *_ in ODD) and pii.personal_data(odd.where("false")).isEmpty()


def slow_personal(data, confidence=0.8, support=5):
    """Found spans by document, from a plain reading of the rules: tokens, patterns, and beliefs that grow until they settle."""
    edges, places = {}, []
    for n, (_, text, *_) in enumerate(data):
        text = text or ""
        seeds = sorted((a, b) for kind, own in base_by_regex(text).items() for a, b in own)
        done, before = set(), []
        for m in re.finditer(r"[^\x20\x09-\x0D;,|&]+", text):
            words = ["".join(c for c in w.lower() if c.isalpha()) for w in before[-2:]]
            context = ([f"1 {words[-1]}"] if words and words[-1] else []) + ([f"2 {words[0]} {words[1]}"] if len(words) > 1 and all(words) else [])

            def key(part):
                k = re.match(r"[\"'(\[{<]*([A-Za-z_][A-Za-z_.-]*[=:])[\"']?", part)
                return ["k " + "".join(c for c in k[1].lower() if c.isalpha())] if k else []

            touching = [x for x in seeds if x[0] < m.end() and x[1] > m.start()]
            for x in touching:
                if x not in done:
                    done.add(x)
                    for p in key(text[m.start() : x[0]]) + context:
                        edges[p, text[x[0] : x[1]]] = True
            if not touching and re.search("[0-9]", m[0]):
                head = re.match(r"[\"'(\[{<]*([A-Za-z_][A-Za-z_.-]*[=:][\"']?)?", m[0]).end()
                value = m[0][head:].rstrip("\"')]}>.:!?")
                if len(value) >= 4 and re.search("[0-9]", value):
                    for p in key(m[0]) + context:
                        edges[p, value] = edges.get((p, value), False)
                        places.append((n, m.start() + head, m.start() + head + len(value), p))
            before.append(m[0])
    seed_ids = {i for (_, i), x in edges.items() if x}
    belief, accepted = dict.fromkeys(seed_ids, 1.0), None
    while True:
        by = {}
        for p, i in edges:
            by.setdefault(p, []).append(belief.get(i, 0.0))
        now = {p: sum(x) / (len(x) + 0.5) for p, x in by.items() if sum(x) >= support and sum(x) / (len(x) + 0.5) >= confidence}
        if accepted is not None and len(now) == len(accepted) or not now:
            return {(n, a, b) for n, a, b, p in places if p in now}
        accepted, doubt = now, {}
        for p, i in edges:
            if p in now and i not in seed_ids:
                doubt[i] = doubt.get(i, 1.0) * (1 - min(now[p], 0.99))
        belief = dict.fromkeys(seed_ids, 1.0) | {i: 1 - x for i, x in doubt.items()}


def personal_corpus():
    """Seeds stand behind `desk`; so do account numbers, which also stand behind `acct=`, and so do others that no seed is near."""
    rng = random.Random(4)
    number = lambda k: f"AC{k:05}"
    out = [f"{words_of(rng, 4)} reach desk a{k}x@mail.example.com {words_of(rng, 3)}" for k in range(240)]
    out += [f"please reach desk {number(k)}, thanks" for k in range(30)]
    out += [f"order acct={number(k)};total=17 of {words_of(rng, 3)}" for k in range(30)]
    out += [f'see (acct="{number(k)}") there' for k in range(100, 103)]
    out += [f"on page {rng.randrange(1000, 9999)} we read w{k}" for k in range(40)] + [f"mail=q{k}@r.st;id=ZZ{k}99 x" for k in range(9)]
    out += [None, "", "9" * 5000, "k" * 3000 + "=AC00100 desk " + "7" * 400, "desk " + "x" * 300 + "5", "+49 (30) 1234-5678 desk 4111 1111 1111 1111 AC00007"]
    return [(k, t, "s") for k, t in enumerate(out)]


def test_personal_data_grows_by_what_it_finds(spark):
    """Found identifiers carry a pattern that no seed stands behind; the graph is scored as by a slow version."""
    data = personal_corpus()
    want = slow_personal(data)
    got = set()
    for r in pii.personal_data(table(spark, data)).collect():
        got |= {(r["doc_id"], int(a), int(b)) for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x) if kind == "id"}
    assert got == want
    text = {k: t for k, t, _ in data}
    values = {text[k][a:b] for k, a, b in got}
    assert {"AC00100", "AC00101", "AC00102"} <= values  # by acct alone, which found numbers support
    assert not any(v.isdigit() and len(v) == 4 for v in values)  # page numbers stay


def test_personal_data_without_room_for_a_broadcast(spark, monkeypatch):
    data = personal_corpus()
    monkeypatch.setattr(pii, "small", lambda *a: False)
    got = {(r["doc_id"], r["spans"]) for r in pii.personal_data(table(spark, data).repartition(3)).collect()}
    monkeypatch.undo()
    assert got == {(r["doc_id"], r["spans"]) for r in pii.personal_data(table(spark, data)).collect()}


def test_candidates_take_linear_time():
    for text in ("!" * 300_000 + "a1", "a1" + "." * 300_000 + "b", "x=" * 150_000 + "1234", "a." * 150_000 + "=12345", "(" * 300_000 + "1234", "1;" * 150_000):
        pii.candidates(text, [])


# 7: vectors -----------------------------------------------------------------------------------------------------------


def links_by_hand(data):
    part, x = {}, {}
    for k, (vid, v, label) in enumerate(data):
        if v is not None and label is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v):
            part.setdefault((label, len(v)), []).append(k)
            x[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = {k: set() for k in range(len(data))}
    for own in part.values():
        s = np.array([x[k] for k in own])
        for a, b in np.argwhere(s @ s.T >= 0.98):
            if a != b:
                links[own[a]].add(own[b])
    least = {}
    for k in links:
        seen, stack = {k}, [k]
        while stack:
            for y in links[stack.pop()] - seen:
                seen.add(y)
                stack.append(y)
        least[k] = min((data[y][0] for y in seen if data[y][0] is not None), default=None)
    return sorted(((d[0], len(links[k]), least[k], d[0] == least[k]) for k, d in enumerate(data)), key=str)


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    data = []

    def add(v, label):
        data.append((1000 - len(data), None if v is None else [None if c is None else float(c) for c in v], label))

    for _ in range(150):
        add(rng.normal(size=16), int(rng.integers(3)))
    for label, size in ((0, 60), (1, 5), (2, 2)):
        centre = rng.normal(size=16)
        for _ in range(size):
            add(centre + 0.03 * rng.normal(size=16), label)
    chain = np.eye(16)[0]
    for k in range(8):
        angle = 0.15 * k
        add([math.cos(angle), math.sin(angle), *chain[2:]], 1)
    for v, label in ((None, 1), ([], 1), ([0.0] * 16, 1), ([1.0, None], 1), ([1.0, float("nan")], 1), ([1.0, float("inf")], 1), ([1.0, 2.0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e-30] * 16, 2), ([1e-30] * 16, 2)):
        add(v, label)
    df = spark.createDataFrame([(*d, "z") for d in data], "vec_id long, embedding array<double>, label int, row string")
    got = sorted(rows(vectors.near_vectors(df), "vec_id", "n_links", "component_id", "kept"), key=str)
    assert got == links_by_hand(data)
    assert vectors.near_vectors(df.where("false")).isEmpty()


def dense_groups(rng, sizes, cosine=0.987, label=0, first=0):
    """Groups of vectors much closer to each other than to the other groups, which they link with all the same."""
    c, *turns = np.linalg.qr(rng.normal(size=(16, 1 + len(sizes))))[0].T
    out = []
    for turn, size in zip(turns, sizes, strict=True):
        # two centres at equal angles from c have this cosine with each other
        centre = math.sqrt(cosine) * c + math.sqrt(1 - cosine) * turn
        out += [(centre + 0.003 * rng.normal(size=16), label) for _ in range(size)]
    return [(first + k, [float(x) for x in v], y) for k, (v, y) in enumerate(out)]


@pytest.mark.parametrize("copies", [0, 25])
def test_near_vectors_saturated(spark, copies):
    """Lists of 10 hold none of the links between the groups."""
    rng = np.random.default_rng(3)
    data = dense_groups(rng, (30, 30), label=0) + dense_groups(rng, (12, 12), label=1, first=100)
    data += [(200 + k, [float(x) for x in rng.normal(size=16)], k % 2) for k in range(60)]
    data += [(300 + 30 * k + j, data[k][1], data[k][2]) for k in (0, 30, 65) for j in range(copies)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    want = links_by_hand(data)
    assert len({c for i, _, c, _ in want if i is not None and i < 60}) == 1 == len({c for i, _, c, _ in want if 100 <= i < 124})
    assert sorted(rows(vectors.near_vectors(df), "vec_id", "n_links", "component_id", "kept"), key=str) == want


def test_audit_is_a_mean_over_vectors(spark):
    """A large group that is counted whole doesn't outweigh pairs that are lost."""
    far = np.eye(40)
    vecs = [far[0]] * 100 + [far[1 + k // 2] for k in range(20)]
    points = spark.createDataFrame([(k, "0/40", [float(x) for x in v], 1) for k, v in enumerate(vecs)], "row long, part string, vec array<double>, w long")
    counted = spark.createDataFrame([(k, 99, 99) for k in range(100)], "row long, n long, m long")
    lists = spark.createDataFrame([], "a long, b long, s double")
    assert vectors.audit(points, lists, counted, 0.98) == pytest.approx(100 / 120)


def test_audit_finds_rare_links(spark, monkeypatch):
    """Of 3,000 points two are linked: they are drawn, as their lists say that they are near."""
    monkeypatch.setattr(vectors, "AUDITED", 20)
    rng = np.random.default_rng(2)
    vecs = [rng.normal(size=12) for _ in range(3000)]
    vecs[1777] = vecs[5] + 0.01
    points = spark.createDataFrame([(k, f"{k % 7}/12" if k not in (5, 1777) else "3/12", [float(x) for x in v], 1) for k, v in enumerate(vecs)], "row long, part string, vec array<double>, w long")
    lists = spark.createDataFrame([(5, 1777, 0.97), (8, 9, 0.5)], "a long, b long, s double")
    assert vectors.audit(points, lists, spark.createDataFrame([(5, 0, 0)], "row long, n long, m long"), 0.98) == 0.0
    assert vectors.audit(points, lists, spark.createDataFrame([(5, 1, 1)], "row long, n long, m long"), 0.98) == 1.0


def test_near_vectors_with_null_and_repeated_ids(spark):
    """Each row has its own result, whatever other row has its id."""
    data = [(None, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (5, [3.0, -1.0], 1), (5, [1.0, 2.001], 1), (None, None, 1), (None, [0.0, 0.0], 1), (None, [-1.0, 1.0], 2), (None, [-1.0, 1.0], 2), (7, [9.0, 9.0], None)]
    df = spark.createDataFrame([(*d, "z", 1) for d in data], "vec_id long, embedding array<double>, label int, digest string, n_links int")
    assert sorted(rows(vectors.near_vectors(df), "vec_id", "n_links", "component_id", "kept"), key=str) == links_by_hand(data)


def test_near_vectors_with_very_many_copies(spark):
    """Copies are one point: 100,000 of them are no work of their own."""
    df = spark.range(100_000).selectExpr("id as vec_id", "array(1.0D, 2.0D, 3.0D) as embedding", "1 as label").union(spark.createDataFrame([(200_000, [1.0, 2.0, 3.01], 1), (200_001, [-1.0, 0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int"))
    got = vectors.near_vectors(df).groupBy("n_links", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(100_000, 0, 100_001), (0, 200_001, 1)}


def test_near_vectors_when_the_audit_fails(spark, monkeypatch):
    """Lists grow from attempt to attempt; if they find nothing, all vectors are compared."""
    asked = []

    def none(points, tables, first, sizes, k=vectors.NEIGHBOURS):
        asked.append(k)
        return spark.createDataFrame([], "a long, b long, s double")

    monkeypatch.setattr(vectors, "start", none)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    data = dense_groups(rng, (14, 3, 14)) + [(100 + k, [float(x) for x in rng.normal(size=16)], 0) for k in range(20)]
    data += [(200 + k, data[40][1], 0) for k in range(3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted(rows(vectors.near_vectors(df), "vec_id", "n_links", "component_id", "kept"), key=str)
    assert got == links_by_hand(data) and asked == [10, 20, 40]


# 8: mixing ------------------------------------------------------------------------------------------------------------


def budgets_by_hand(sizes, weights=mixing.WEIGHTS):
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight, size, out = {x: weights[k % 3] for k, (x, _) in enumerate(order)}, dict(sizes), {}
    free = set(size)
    while free:
        rest, total = 1.5 * sum(size.values()) - sum(out.values()), sum(weight[x] for x in free)
        full = {x for x in free if rest * weight[x] / total > 2 * size[x]}
        out |= {x: 2.0 * size[x] for x in full} if full else {x: rest * weight[x] / total for x in free}
        free -= full or free
    return out


def test_budgets(spark):
    rng = random.Random(3)
    cases = [[("a", 100), ("b", 100), (None, 100)], [("a", 0)], [(f"s{k}", k + 1) for k in range(9)], [(f"s{k:04}", int(1000 * rng.random() ** 6)) for k in range(500)] + [("S", 10**6), ("é", 5)]]
    for sizes in cases:
        got = {r["source"]: r["target"] for r in mixing.budgets(spark.createDataFrame(sizes, "source string, n long")).collect()}
        assert got == {x: pytest.approx(t) for x, t in budgets_by_hand(sizes).items()}
    assert mixing.budgets(spark.createDataFrame([], "source string, n long")).isEmpty()


def test_mixing(spark, odd):
    rng = random.Random(7)
    data = [(k, words_of(rng, rng.randrange(1, 60)), rng.choice(["hot"] * 6 + ["b", "c", None])) for k in range(3000)]
    df = table(spark, data)
    got = mixing.mix(df).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got} and len(got) == 3000
    source = {k: s for k, _, s in data}
    for s in ("hot", "b", "c", None):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    again = mixing.repeat_rows(df)
    assert again.columns == df.columns
    assert Counter(r[0] for r in rows(again, "doc_id")) == Counter({r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]})
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.where("false")).isEmpty()
    assert mixing.repeat_rows(odd.where("false")).isEmpty()
    assert {r["size"] for r in mixing.mix(odd).where("doc_id in (1, 2, 3)").collect()} == {0}


def test_mixing_with_null_and_repeated_ids(spark, monkeypatch):
    """A source whose ids are null, or all one, comes near its target all the same; no side is broadcast here."""
    monkeypatch.setattr(mixing, "small", lambda *a: False)
    rng = random.Random(8)
    data = [(None if k % 2 else 7, words_of(rng, rng.randrange(1, 30)), "one" if k % 2 else rng.choice(["two", None])) for k in range(1200)] + [(k, f"w {k}", f"s{k}") for k in range(40)]
    df = table(spark, data)
    sizes = Counter()
    for _, t, x in data:
        sizes[x] += len(t.split())
    targets = budgets_by_hand(list(sizes.items()))
    taken = Counter()
    for r in mixing.repeat_rows(df).collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[x] - targets[x]) <= 30 for x in sizes)
    by_target = Counter()
    for r in mixing.mix(df).collect():
        by_target[round(r["target"], 6)] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = Counter()
    for x in sizes:
        want[round(targets[x], 6)] += taken[x]
    assert by_target == want


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("__part"))
    got = rows(common.numbered(df, [F.col("__part").desc()], "k"), "k", "__part")
    assert [p for _, p in sorted(got)] == sorted((p for _, p in got), reverse=True) and {k for k, _ in got} == set(range(500))


# 9: byte-level BPE ----------------------------------------------------------------------------------------------------

TEXTS = ["Hello, world's  3rd\n\n test", "", "é" * 50, "日本語のテキスト 🙂🙂", "a" * 300, " \t\u00a0 x", "<|endoftext|> don't", "12 3456\r\n7"]


def test_chunks_do_not_change_tokens():
    enc = bpe.encoding(*bpe.default_ranks())
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "Bc", "'s", "'", "1", "23", "é", "!", "\u00a0", "'ll "]) for _ in range(rng.randrange(200)))
        pieces = bpe.chunks(text, rng.randrange(1, 20))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@pytest.mark.parametrize("unit", [" ", "\n", "\u3000", " \t", "é", "a", "!", "7", "日本", "\x1c"])
def test_bpe_of_very_long_runs(unit):
    """Two million characters of a kind neither crash nor differ from what the library gives for as much as it can take."""
    path, pattern = bpe.default_ranks()
    enc, whole = bpe.encoding(path, pattern), bpe.encoding(path, bpe.WHOLE)
    for text in (unit * (300_000 // len(unit)), "x" + unit * 30_000 + "y z", unit * 10_000 + " ok " + unit * 10_001, unit * 9_999 + "1", unit * 50_000):
        assert bpe.encode(text, enc, whole) == enc.encode_ordinary(text)
    for text in (unit * (2_000_000 // len(unit)), "a " + unit * (2_000_000 // len(unit)) + "x"):
        assert enc.decode_bytes(bpe.encode(text, enc, whole)) == text.encode()


def test_bpe_of_many_blank_runs():
    path, pattern = bpe.default_ranks()
    enc, whole = bpe.encoding(path, pattern), bpe.encoding(path, bpe.WHOLE)
    text = ("a" + " " * 9_990) * 150 + ("b" + "\t" * 12_000 + " ") * 20
    assert bpe.encode(text, enc, whole) == enc.encode_ordinary(text)


def test_bpe(spark, odd):
    data = [(k, t, "s") for k, t in enumerate(TEXTS)] + [(50, None, "s"), (51, " ".join(TEXTS) * 900, "s"), (51, "again", "s")]
    path, pattern = bpe.default_ranks()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe(table(spark, data)).collect()
    want = {(k, tuple(enc.encode_ordinary(t or ""))): (t or "").encode() for k, t, _ in data}
    assert {(r["doc_id"], tuple(r["ids"])): bytes(r["decoded"]) for r in got} == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest()
    assert bpe.bpe(odd, ids=False).count() == len(ODD) and bpe.bpe(odd.where("false")).isEmpty()


# 10: MinHash ----------------------------------------------------------------------------------------------------------


def near_by_hand(data, width):
    sets = []
    for _, text, *_ in data:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    least = list(range(len(data)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                least[find(a)] = find(b)
    groups = {}
    for k, d in enumerate(data):
        groups.setdefault(find(k), []).append(d[0])
    out = []
    for k, d in enumerate(data):
        ids = [i for i in groups[find(k)] if i is not None]
        c = (min(ids) if ids else None) if sets[k] else d[0]
        out.append((d[0], len(sets[k]), c, d[0] == c))
    return Counter(out)


def near_corpus(seed):
    rng = random.Random(seed)
    out = []

    def vary(base, share):
        return " ".join(w if rng.random() > share else f"v{rng.randrange(10**6)}" for w in base.split())

    for n in (3, 8, 20, 36, 42, 60, 200):
        base = words_of(rng, n, 5000)
        out += [vary(base, share) for share in (0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.1, 0.2) for _ in range(3)]
    hot = words_of(rng, 90, 5000)
    out += [vary(hot, 0.055) for _ in range(60)]
    out += [words_of(rng, 1, 5), "One", "one", "ONE\ttwo", "one two", *(f"common line here {k} {k * 7} tail" for k in range(50))]
    out += [words_of(rng, rng.randrange(5, 150), 9000) for _ in range(60)]
    rng.shuffle(out)
    return [(k * 3 + 1, t, "s") for k, t in enumerate(out)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, width, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SIGNED_BLOCK", 32)
    data = near_corpus(width)
    df = table(spark, data)
    got = Counter(rows(minhash.near_dedup(df, width=width), "doc_id", "n_shingles", "component_id", "kept"))
    assert got == near_by_hand(data, width)
    kept = minhash.keep_one(df, width=width)
    assert kept.columns == df.columns and {r[0] for r in rows(kept, "doc_id")} == {i for (i, _, _, k) in got if k}


def test_near_dedup_odd(spark, odd):
    got = Counter(rows(minhash.near_dedup(odd, width=2), "doc_id", "n_shingles", "component_id", "kept"))
    assert got == near_by_hand(ODD, 2)
    assert minhash.near_dedup(odd.where("false")).isEmpty()
    with pytest.raises(ValueError):
        minhash.near_dedup(odd, similarity=50)


def test_keep_one_with_null_and_clashing_ids(spark):
    """One row of each component stays, and no row leaves because another has its id."""
    rng = random.Random(5)
    a, b, c, d, e, f, g = (words_of(rng, 60, 5000) for _ in range(7))
    data = [
        (1, a, "s"), (None, a + " x", "s"), (None, b, "s"), (None, None, "s"), (None, "", "s"),  # a null id near a document with an id, and others
        (None, c, "s"), (None, c + " y", "s"), (None, c, "s"),  # near copies and a copy, all without id
        (2, d, "s"), (9, d + " z", "s"), (9, e, "s"),  # an id of two texts, one a near copy
        (4, f, "s"), (4, f, "s"), (5, f + " t", "s"), (6, g, "s"), (6, g.upper(), "s"), (7, "", "s"), (7, "", "s"),
    ]
    df = table(spark, data)
    kept = minhash.keep_one(df)
    got = Counter((i, t if t is None else t.lower()) for i, t in rows(kept, "doc_id", "text"))
    c_kept = [x for x in got if x[1] in (c, c + " y")]
    assert len(c_kept) == 1 and got.pop(c_kept[0]) == 1
    assert got == Counter({(1, a): 1, (None, b): 1, (None, None): 1, (None, ""): 1, (2, d): 1, (9, e): 1, (4, f): 1, (6, g): 1, (7, ""): 2})
    assert kept.columns == df.columns


def test_merged_lists_against_plain_counting():
    """Who agrees in enough coordinates: prefix and skip find all of them and nobody else."""
    rng = np.random.default_rng(1)
    for size in (2, 40, 300):
        base = rng.integers(-30_000, 30_000, (5, 64)).astype(np.int16)
        brief = base[rng.integers(0, 5, size)]
        change = rng.random(brief.shape) < rng.random((size, 1)) * 0.6
        brief[change] = rng.integers(-5, 5, change.sum())
        signed, allowed = rng.random(size) < 0.9, rng.random(size) < 0.8
        lists = minhash.Merged(brief, signed)
        for x in np.flatnonzero(signed):
            others = allowed & signed
            want = np.flatnonzero(others & ((brief == brief[x]).sum(1) >= minhash.LEAST))
            got = lists.meet(int(x), others, minhash.LEAST)
            assert set(got) | {x} == set(want) | {x}


def test_join_spread(spark, monkeypatch):
    """Heavy keys are broadcast, others shuffled: the same rows as by a plain join."""
    monkeypatch.setattr(common, "HEAVY_KEYS", 3)
    rng = random.Random(3)
    data = [(k, rng.choice([1, 1, 1, 2, 2] + list(range(3, 90)))) for k in range(900)]
    df = spark.createDataFrame(data, "a long, k long")
    side = df.where("k % 7 != 0").groupBy("k").agg(F.count("*").alias("n"), F.min("a").alias("m"))
    got = sorted(rows(common.join_spread(df, side, "k", "n"), "a", "k", "n", "m"))
    assert got == sorted(rows(df.join(side, "k"), "a", "k", "n", "m"))
    assert common.join_spread(df, side.where("false"), "k", "n").isEmpty()


def test_linked_pairs():
    rng = np.random.default_rng(0)
    for _ in range(15):
        base = [np.unique(rng.integers(0, 1 << 62, rng.integers(5, 120), dtype=np.uint64)) for _ in range(4)]

        def some():
            s = base[rng.integers(4)]
            keep = rng.random(len(s)) < 0.9
            return np.unique(np.concatenate([s[keep], rng.integers(0, 1 << 62, (~keep).sum(), dtype=np.uint64)]))

        a, b = [some() for _ in range(rng.integers(1, 70))], [some() for _ in range(rng.integers(1, 70))]
        want = [[100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)) for y in b] for x in a]
        assert (minhash.linked_pairs(a, b, 80) == np.array(want)).all()


# Shared ---------------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 90)] + [(7, 7), (3, 2), (2, 3)] + [(rng.randrange(600, 800), rng.randrange(600, 800)) for _ in range(90)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for x in parent if x != 7}
    own = {x for e in edges if e[0] != e[1] for x in e}
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {x: r for x, r in want.items() if x in own}
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_without(spark, odd):
    gone = spark.createDataFrame([(5,), (None,)], "id long")
    for size in (8, common.BROADCAST_BYTES):
        left = common.without(odd, gone, "doc_id", size)
        assert sorted(r[0] for r in rows(left, "doc_id")) == [1, 2, 3, 6, 7, 8] and left.columns == odd.columns
    assert common.free_name(odd, "Row") == "Row_"
    assert rows(odd.where("doc_id = 7").select(common.ascii_lower(F.lit("ÀB")).alias("x")), "x") == [("Àb",)]


# Pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [(k, t, "s" + str(k % 3)) for k, t, y in quality_corpus(120) if y]
    bad = [(1000 + k, t, "s0") for k, t, y in quality_corpus(120) if not y]
    copies = [(2000 + k, t.replace(" ", "  "), "s1") for k, t, _ in good[:9]]
    near = [(3000 + k, t + " tail", "s2") for k, t, _ in good[9:18]]
    df = table(spark, good + bad + copies + near)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        docs, _ = common.stored(out)
        seen.append((name, {r[0] for r in rows(docs, "doc_id")}))
    after = dict(seen)
    assert len(after["quality_classifier"] & {r[0] for r in bad}) <= 2 and len({r[0] for r in good} - after["quality_classifier"]) <= 2
    assert not after["exact_dedup"] & {r[0] for r in copies} and not after["minhash_near_dedup"] & {r[0] for r in near}
    assert after["minhash_near_dedup"] == after["quality_classifier"] - {r[0] for r in copies + near}
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in rows(last, "doc_id")} == after["source_mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    """Null and empty texts go, repeated rows become one, and nothing crashes; an empty table gives no rows."""
    import corpus_pipeline

    for name, df in (("odd", odd), ("empty", odd.where("false"))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()}
    assert got <= {None, 5, 6, 7, 8} and not {7, 8} <= got
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).isEmpty()
