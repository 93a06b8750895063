"""Quality: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a document. The counts of vote patterns over all documents (3 to the power
of the labellers at most) are all that expectation-maximisation needs. Labellers overlap, so their votes depend on each
other; what they share are kinds of bad documents. Each document is good or of one of as many hidden kinds as there are
labellers, and votes are independent within a kind only. For good documents and for every kind it is estimated how often
each labeller casts each vote, and from these its accuracies. The posterior of a pattern labels its documents, and on
those a linear scorer is trained over hashed features of word shapes; it alone decides. No label of any table is used.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_add, arrow_map, free_name

#: The bound of posterior-labelled distinct texts that the scorer is trained on: those of the least hashes.
MAX_TRAINING = 12_000
HASHED = 1024
THRESHOLD = 0.5
LABELLERS = ("repeats", "symbols", "variety", "capitals", "letterless", "marked ends", "sentences", "top word", "word length", "short words")


#: Marks that end no ordinary word.
MARKS = "#$%&*|~^@"
#: Words that a worker remembers.
REMEMBERED = 100_000


@lru_cache(maxsize=4096)
def _hash(shape: str) -> int:
    return zlib.crc32(shape[:24].encode())


def shape_of(word: str) -> tuple[int, ...]:
    """Hash of the shape, letters, symbols, all capitals, marked end, sentence end, length. Plain words take short cuts."""
    n = len(word)
    end = "" if word[-1].isalpha() else word[-1]
    bare = word[:-1] if end else word
    if bare.isalpha() and not end.isdigit():
        case = "a" if bare.islower() else "A" if bare.isupper() else "Aa" if bare.istitle() else "x"
        return _hash(case + end), len(bare), len(end), int(case == "A" and len(bare) > 1), int(end != "" and end in MARKS), int(end != "" and end in ".!?"), n
    letters = sum(map(str.isalpha, word))
    symbols = n - sum(map(str.isalnum, word))
    folded = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    marked = n > 2 and not word[-1].isalnum() and word[-1] == word[-2]
    return _hash(re.sub(r"(.)\1+", r"\1\1", folded)), letters, symbols, int(letters > 1 and word.isupper()), int(marked or word[-1] in MARKS), int(word[-1] in ".!?" and not marked), n


class Shapes(dict):
    """Rows of a table by word: hash of its shape, letters, symbols, all capitals, marked end, sentence end, length."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((4096, 7), np.int64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = shape_of(word)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def measures(text: str | None, shapes: Shapes, hashed: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
    """Rates that labellers look at, and hashed features if wanted; none for a text without words."""
    w = (text or "").split()
    n = len(w)
    if not n:
        return None
    at = shapes.rows(w)
    table = shapes.table[at]
    same = at[1:] == at[:-1]
    counts = np.unique(at, return_counts=True)[1]
    sums = table.sum(0)
    chars = sums[6]
    rates = np.array([same.sum() / n, sums[2] / chars, len(counts) / n, sums[3] / n, (table[:, 1] == 0).sum() / n, sums[4] / n, sums[5] / n, counts.max() / n, chars / n, (table[:, 6] <= 3).sum() / n, n])
    if not hashed:
        return rates, rates
    s = table[:, 0]
    pair = (s[:-1] * 1_000_003 + s[1:] + 977 * same) % 2_147_483_647
    edges = np.array([zlib.crc32(b"%d/%d" % (k, min(9, int(v * 10)))) for k, v in enumerate(rates[:8])])
    x = (np.bincount(s % HASHED, minlength=HASHED) + np.bincount(pair % HASHED, minlength=HASHED)) / np.float32(n) + np.bincount(edges % HASHED, minlength=HASHED) * np.float32(0.25)
    return rates, np.sqrt(x, dtype=np.float32, casting="same_kind")


def votes(r: np.ndarray) -> str:
    """One letter a labeller: g(ood), b(ad) or - (nothing)."""
    repeats, symbols, variety, capitals, bare, marked, ends, top, length, short, n = r

    def vote(good: bool, bad: bool) -> str:
        return "b" if bad else "g" if good else "-"

    return "".join((
        vote(repeats < 0.03, n >= 8 and repeats > 0.15),
        vote(symbols < 0.06, n >= 20 and symbols > 0.15),
        vote(n < 60 or variety > 0.4, n >= 60 and variety < 0.15),
        vote(capitals < 0.1, n >= 8 and capitals > 0.4),
        vote(bare < 0.03, n >= 20 and bare > 0.2),
        vote(marked < 0.03, marked > 0.2),
        vote(0.01 <= ends <= 0.4, n >= 60 and (ends < 0.002 or ends > 0.5)),
        vote(top < 0.15, n >= 20 and top > 0.3),
        vote(2.5 <= length <= 12, length < 1.8 or length > 20),
        vote(0.1 <= short <= 0.6, n >= 20 and (short < 0.02 or short > 0.9)),
    ))


def expectation_maximisation(patterns: dict[str, int], rounds: int = 300) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class, a vote is cast) as class x labeller x (g, b), and the prior of good.

    The classes are good and bad; bad is a mixture of kinds, one for each labeller to begin with, of which those stay
    that the counts call for. No vote tells nothing.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((2, 0, 2)), 0.5
    one = np.array([[["gb".find(c) == v for v in range(2)] for c in k] for k in keys], float)
    n = np.array([patterns[k] for k in keys], float)
    bad = one[:, :, 1]
    against = bad.sum(1, keepdims=True)
    # where to start: the more votes against a document the likelier it is bad, of the kinds of those who cast them
    good = np.where(against > 0, 0.5 / (1 + against), 0.98)
    post = np.concatenate([good, (1 - good) * np.where(against > 0, bad / np.maximum(against, 1), 1 / bad.shape[1])], 1)
    post, prior, table, fit_ = _settled(one, n, post, rounds)
    kind = 1
    while post.shape[1] > 2 and kind < post.shape[1]:
        # a kind that the counts don't call for, by the Bayesian criterion, is but the false alarms of a labeller
        without = np.delete(post, kind, 1)
        without[:, 0] += post[:, kind]
        fewer = _settled(one, n, without, rounds)
        if fewer[3] > fit_ - 0.5 * (bad.shape[1] + 1) * np.log(n.sum()):
            post, prior, table, fit_ = fewer
        else:
            kind += 1
    kinds = np.einsum("k,klv->lv", prior[1:], table[1:]) / prior[1:].sum()
    return dict(zip(keys, post[:, 0].tolist(), strict=True)), np.stack([table[0], kinds]), float(prior[0])


def _settled(one: np.ndarray, n: np.ndarray, post: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posteriors, priors, vote rates and the logarithm of the likelihood when expectation-maximisation has settled."""
    for _ in range(rounds):
        w = post * n[:, None]
        prior = (w.sum(0) + 1) / (n.sum() + w.shape[1])
        table = np.einsum("pk,plv->klv", w, one) + 0.1
        table /= table.sum(2, keepdims=True)
        log = np.log(prior) + np.einsum("plv,klv->pk", one, np.log(table))
        top = log.max(1, keepdims=True)
        new = np.exp(log - top)
        total = new.sum(1, keepdims=True)
        new /= total
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-7:
            break
    order = np.argsort(table[:, :, 1].sum(1), kind="stable")  # good is the class that the fewest votes are against
    return post[:, order], prior[order], table[order], float(n @ (top + np.log(total))[:, 0])


def train_linear(x: np.ndarray, y: np.ndarray, steps: int = 500, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression to soft labels; the last entry is the intercept."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        g = np.append(x.T @ d + l2 * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit(docs: DataFrame, text_col: str, max_training: int = MAX_TRAINING) -> tuple[np.ndarray, dict[str, float]]:
    """The scorer's weights, learned from docs alone; and the posterior of every pattern in docs."""

    def pattern_of():
        shapes = Shapes()
        return lambda texts: [[votes(m[0]) if (m := measures(t, shapes, False)) else None for t in texts]]

    counts = {r["v"]: r["n"] for r in arrow_map(docs, [text_col], "v string", pattern_of).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).collect()}
    posterior, *_ = expectation_maximisation(counts)
    n = sum(counts.values())
    if not n:
        return np.zeros(HASHED + 1), posterior
    hashed = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col, F.lit(11)).alias("h"), text_col)
    least = hashed.select("h").distinct().orderBy("h").limit(max_training).agg(F.max("h")).first()[0]

    def rows():
        shapes, met = Shapes(), set()

        def run(hashes, texts):
            new = {h: t for h, t in zip(hashes, texts, strict=True) if h not in met}
            met.update(new)  # as many as are trained on at most
            got = {h: m for h, t in new.items() if (m := measures(t, shapes))}
            at = [np.flatnonzero(x) for _, x in got.values()]
            return [list(got), [posterior.get(votes(r), 0.5) for r, _ in got.values()], [a.astype(np.int32) for a in at], [x[a] for (_, x), a in zip(got.values(), at, strict=True)]]

        return run

    made = arrow_map(hashed.where(F.col("h") <= least), ["h", text_col], "h long, p double, k array<int>, x array<float>", rows)
    got = made.groupBy("h").agg(F.min_by(F.struct("p", "k", "x"), "p").alias("m")).select("h", "m.*").toPandas().sort_values("h")
    if got.empty:
        return np.append(np.zeros(HASHED), 5.0), posterior
    x = np.zeros((len(got), HASHED), np.float32)
    for i, (k, values) in enumerate(zip(got["k"], got["x"], strict=True)):
        x[i, k] = values
    return train_linear(x, got["p"].to_numpy(float)), posterior


def _scored(docs: DataFrame, text_col: str, score: str, posterior: str) -> DataFrame:
    """docs with the scorer's probability that the whole text is good, 0 without a word, and the weak label's."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col))

    def make():
        shapes = Shapes()
        w, by_pattern = weights.value

        def run(texts):
            out = [[], []]
            for t in texts:
                m = measures(t, shapes)
                out[0].append(1 / (1 + np.exp(-float(m[1] @ w[:-1]) - w[-1])) if m else 0.0)
                out[1].append(by_pattern.get(votes(m[0]), 0.5) if m else None)
            return out

        return run

    return arrow_add(docs, text_col, f"`{score}` double, `{posterior}` double", make)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (of being good), posterior (the weak label's), kept (score >= threshold).

    A null, empty or blank text has no word: score 0, posterior null, not kept. Patterns are counted over all
    documents, and the scorer's training texts are distinct and taken in order, so that reruns agree. Repeated rows are
    scored each; ids are not read but returned; other columns are not read. No rows in, no rows out.
    """
    out = _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "score", "posterior")
    return out.select("doc_id", "score", "posterior", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the scorer keeps, with their columns."""
    score = free_name(docs, "__quality")
    posterior = free_name(docs, score + "_weak")
    return _scored(docs, text_col, score, posterior).where(F.col(score) >= threshold).select(*docs.columns)
