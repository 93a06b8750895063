"""Toxicity: boosted trees over dense features of the whole text, calibrated by isotonic regression.

The lexicon is learned: words, and beginnings of words, that mark toxic documents among the labelled ones of the
fitting part. Features are densities of lexicon hits, their nearness to second-person words, and rates of capitals,
punctuation and obfuscation. A further part of the labelled rows calibrates. Label, language, source and id are never
features.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, isotonic
from .common import arrow_map, cut

#: The bound of labelled ids that the classifier is fitted on: those of the least hashes.
MAX_LABELLED = 20_000
LEXICON = 4000
STEMS = (4, 5, 6)
THRESHOLD = 0.7
NEAR = 4
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
#: Marks that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W_]+(?:[*@$!0-9.\-_]+[^\W_]+)*")
_MARK = re.compile(r"[^\w\s]")
FEATURES = 15
ODD = 1000.0


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def plain(word: str) -> str:
    """The word without obfuscation: marks read as letters, separators gone."""
    return re.sub(r"[\W\d_]", "", word.translate(LEET))


class Hits(dict):
    """Weights of words: 0 without a hit, the better of the word's own and of its beginnings' weight else.

    ODD more for words that mix letters with other marks, which are read without them, too.
    """

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def best(self, word: str) -> float:
        get = self.lexicon.get
        return max(get(word, 0.0), *[get(word[:k] + "*", 0.0) for k in STEMS])

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        got = self.best(word)
        if not word.isalpha() and not word.isdigit():
            got = max(got, self.best(plain(word))) + ODD
        self[word] = got
        return got


def features(text: str | None, hits: Hits) -> list[float]:
    text = text or ""
    w = words(text)
    n = len(w)
    if not n:
        return [0.0] * FEATURES
    weights = np.fromiter(map(hits.__getitem__, w), float, n)
    odd = weights >= ODD
    weights[odd] -= ODD
    at = np.flatnonzero(weights)
    k = len(at)
    near = spread = exact = 0
    if k:
        found = [w[i] for i in at]
        exact = sum(x in hits.lexicon for x in found)
        spread = len(set(found))
        near = sum(any(x in SECOND_PERSON for x in w[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    second = sum(map(SECOND_PERSON.__contains__, w))
    tokens = text.split()
    capitals = sum(map(str.isupper, tokens))
    marks = len(_MARK.findall(text))
    return [np.log1p(n), k / n, np.log1p(k), exact / n, np.log1p(exact), float(weights.sum()) / n, float(weights.max()), np.log1p(float(weights.sum())), near / k if k else 0.0, np.log1p(near), second / n, spread, capitals / len(tokens), marks / len(text), int(odd.sum()) / n]


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Words and beginnings (marked *) whose presence is far likelier in toxic documents of train (text, toxic).

    An entry must be improbable as chance among so many: its log likelihood ratio against the rate of toxic documents
    is 1 at least above the logarithm of the number of entries that three toxic documents hold.
    """

    def make():
        def run(texts, toxic):
            pos, neg = Counter(), Counter()
            for text, t in zip(texts, toxic, strict=True):
                own = {x for x in words(text or "") if len(x) > 2}
                own |= {x[:k] + "*" for x in own for k in STEMS if len(x) >= k}
                (pos if t else neg).update(own)
            every = list(pos.keys() | neg.keys())
            return [every, [pos[x] for x in every], [neg[x] for x in every]]

        return run

    size = train.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p, n = float(size["p"] or 0), float(size["n"])
    if not 0 < p < n:
        return {}
    counts = arrow_map(train, ["text", "toxic"], "word string, p long, n long", make).groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    a, b = F.col("p"), F.col("n")
    rate = a / (a + b)
    gain = a * F.log(rate / (p / n)) + F.when(b > 0, b * F.log((b / (a + b)) / (1 - p / n))).otherwise(0.0)
    odds = F.log((a + 0.5) / (p + 1) / ((b + 0.5) / (n - p + 1)))
    often = cut(counts.where(a >= 3).withColumns({"gain": gain, "odds": odds}))
    chance = 1 + np.log(max(often.count(), 1))
    top = often.where((F.col("gain") >= chance) & (F.col("odds") >= 2.5)).orderBy(F.desc("gain"), "word").limit(LEXICON)
    return {r["word"]: float(r["odds"]) for r in top.collect()}


class Scorer:
    def __init__(self, lexicon: dict[str, float], model: Boosted | None, knots: tuple[np.ndarray, np.ndarray] | None, prior: float):
        self.lexicon, self.model, self.knots, self.prior = lexicon, model, knots, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, and never level where the trees tell two texts apart: a fiftieth is the trees' own rate."""
        if self.model is None:
            return np.full(len(x), self.prior)
        m = self.model.margin(x)
        return np.clip(0.98 * np.interp(m, *self.knots) + 0.02 / (1 + np.exp(-m)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int = MAX_LABELLED) -> Scorer:
    """Fit on labelled documents whose crc32(id as text) mod 3 isn't 1: 7 in 10 for lexicon and trees, 3 for calibration.

    The labelled ids of the least hashes, at most max_labelled; of rows that share an id one.
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    own = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(order, "doc_id").limit(max_labelled).select(F.col("doc_id").alias("__id"), "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)) < 7).alias("fitting"))
    met = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("__id"))
    rows = met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"), F.first("fitting").alias("fitting"))
    lexicon = learn_lexicon(rows.where("fitting").select("text", "toxic"))
    shared = spark.sparkContext.broadcast(lexicon)

    def make():
        hits = Hits(shared.value)

        def run(ids, texts, toxic, fitting):
            return [ids, [features(t, hits) for t in texts], toxic, fitting]

        return run

    got = arrow_map(rows, ["doc_id", "text", F.col("toxic").cast("int"), "fitting"], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>, toxic int, fitting boolean", make).orderBy("doc_id").toPandas()
    y = got["toxic"].to_numpy(float)
    prior = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return Scorer(lexicon, None, None, prior)
    x, part = np.stack(got["x"].to_numpy()), got["fitting"].to_numpy(bool)
    if not 0 < y[part].sum() < part.sum() or not 0 < y[~part].sum() < (~part).sum():
        part = np.ones(len(y), bool)
    model = Boosted().fit(x[part], y[part])
    rest = ~part if not part.all() else part
    return Scorer(lexicon, model, isotonic(model.margin(x[rest]), y[rest]), prior)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, from its whole text.

    Null and empty texts have features of zero and are scored like any other. Without labels of both kinds in the
    training part every score is the rate of toxic labels there, 0 without any. Labels of a document that disagree:
    the highest counts. Null labels and ids are not learned from; a null id is scored, and counts as an empty one for
    held_out. Ids may be of any type that labels and documents share. Other columns are not read; repeated rows are
    scored each. No rows in, no rows out.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def make():
        hits = Hits(scorer.value.lexicon)

        def run(ids, texts):
            s = scorer.value.scores(np.array([features(t, hits) for t in texts]).reshape(-1, FEATURES))
            return [ids, s, (s >= threshold).astype(np.int32)]

        return run

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = arrow_map(docs, [id_col, text_col], f"doc_id {kind}, score double, predicted int", make)
    return out.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out"), "score", "predicted")
