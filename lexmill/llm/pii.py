"""Personal data: regular kinds as seeds, and contextual extraction bootstrapped from them.

Seeds are e-mail addresses, IP addresses, card and phone numbers. The words before an identifier, and a key it is
written behind, are lexical patterns; identifiers and patterns form a graph over the whole corpus. In each round a
pattern's confidence is the mean belief in the identifiers that it extracts, and an identifier's belief comes from the
confident patterns around it; seeds are believed outright. A pattern is accepted if it is confident and its identifiers'
beliefs add up to enough, whether seeds or found ones, so that found identifiers bring in further patterns, until none
comes. Accepted patterns mark identifiers that no seed rule knows. One pass reads the texts; the graph holds only tokens
that look like identifiers.
"""

from __future__ import annotations

import hashlib
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, small

KINDS = ("email", "ip", "card", "phone", "id")
CONFIDENCE = 0.8
#: What the beliefs in a pattern's distinct identifiers must add up to.
SUPPORT = 5
#: An identifier that is no seed has a digit, and so many characters.
SHORTEST = 4
#: A longer word stands in a pattern by its hash.
WORD_LENGTH = 40

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does: a later digit of the run is followed by the same rest.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Tokens end at white space and at what separates fields.
_TOKEN = re.compile(r"[^\x20\x09-\x0D;,|&]+")
_KEY = re.compile(r"([A-Za-z_][A-Za-z_.-]*+[=:])[\"']?")
_OPEN, _CLOSE = "\"'([{<", "\"')]}>.:!?"
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in time linear in the text: around each @, its run to the left and the domain to the right."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, as code points with the end exclusive. A match that fails its check is dropped without retry."""

    def parts_fit(m: re.Match) -> bool:
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))

    def card(m: re.Match) -> bool:
        d = m[0].replace(" ", "").replace("-", "")
        return 12 <= len(d) <= 19 and luhn(d)

    numbers = bool(_DIGIT.search(text))
    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if parts_fit(m)] if numbers else [],
        "card": [m.span() for m in _CARD.finditer(text) if card(m)] if numbers else [],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15] if "+" in text else [],
    }


def _word(w: str) -> str:
    w = "".join(_LETTERS.findall(w.lower()))
    return w if len(w) <= WORD_LENGTH else f"#{xxhash.xxh64_hexdigest(w)}"


def patterns(before: list[str], key: str | None) -> list[str]:
    """Lexical patterns of a token: the key it is written behind, the word before it, the two words before it."""
    words = [_word(w) for w in before]
    out = [f"k {_word(key)}"] if key else []
    if words and words[-1]:
        out.append(f"1 {words[-1]}")
        if len(words) > 1 and words[-2]:
            out.append(f"2 {words[-2]} {words[-1]}")
    return out


def parts(token: str) -> tuple[int, str | None, int]:
    """Where a token's value begins, the key before it, and where the value ends: without quotes, brackets and marks around."""
    begin = len(token) - len(token.lstrip(_OPEN))
    m = _KEY.match(token, begin)
    if m:
        begin = m.end()
    return begin, m[1] if m else None, max(begin, len(token.rstrip(_CLOSE)))


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int, int, bool, list[str]]]:
    """(start, end, hash, whether it is a seed, patterns) of seeds, and of tokens beside them that hold a digit."""
    out, before, k = [], [], 0
    covered = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][2] <= start:
            k += 1
        met, j = False, k
        while j < len(base) and base[j][0] < end:  # a token may hold several seeds, and a seed several tokens
            a, _, b = base[j]
            if a >= covered:  # once a seed, at its first token
                key = parts(text[start:a])[1] if a > start else None
                out.append((a, b, xxhash.xxh64_intdigest(text[a:b]) - (1 << 63), True, patterns(before, key)))
                covered = b
            met, j = True, j + 1
        if not met and start >= covered and _DIGIT.search(m[0]):
            low, key, high = parts(m[0])
            if high - low >= SHORTEST and _DIGIT.search(m[0], low, high):
                a, b = start + low, start + high
                out.append((a, b, xxhash.xxh64_intdigest(text[a:b]) - (1 << 63), False, patterns(before, key)))
        before = [*before[-1:], m[0]]
    return out


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with its base spans and candidates; cut."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:long,k:int,end:long>>, found array<struct<start:long,end:long,id:long,seed:boolean,patterns:array<string>>>"

    def make():
        def run(ids, texts):
            out = [ids, *([] for _ in range(7))]
            for text in texts:
                by_kind = base_spans(text or "")
                spans = sorted((a, KINDS.index(kind), b) for kind, own in by_kind.items() for a, b in own)
                for col, kind in zip(out[1:5], KINDS, strict=False):
                    col.append(len(by_kind[kind]))
                out[5].append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())
                out[6].append([{"start": a, "k": k, "end": b} for a, k, b in spans])
                got = candidates(text, [(a, KINDS[k], b) for a, k, b in spans]) if text and _DIGIT.search(text) or spans else []
                out[7].append([{"start": a, "end": b, "id": h, "seed": s, "patterns": p} for a, b, h, s, p in got])
            return out

        return run

    return cut(arrow_map(docs, [id_col, text_col], schema, make).withColumn("row", F.monotonically_increasing_id()))


def confident(edges: DataFrame, confidence: float = CONFIDENCE, support: float = SUPPORT) -> DataFrame:
    """(pattern, conf) of the accepted patterns in the graph of edges (pattern, id, seed); cut.

    Beliefs only grow, and so do the accepted patterns: a round that adds none is the last. Sums are pre-aggregated by
    pattern and by identifier, and what either is joined with is broadcast if it is small by count, so that a word before
    a third of all numbers is no hot task; larger ones are joined like any skewed key.
    """
    graph = cut(edges.groupBy("pattern", "id").agg(F.max("seed").alias("seed")))
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = cut(graph.where("seed").select("id", F.lit(1.0).alias("belief")).distinct())
    believed, before = seeds, -1
    while True:
        met = graph.select("pattern", "id").join(F.broadcast(believed) if small(believed, 48) else believed, "id")
        sums = met.groupBy("pattern").agg(F.sum("belief").alias("s")).where(F.col("s") >= support)
        scored = sums.join(sizes, "pattern").withColumn("conf", F.col("s") / (F.col("n") + 0.5))
        accepted = cut(scored.where(F.col("conf") >= confidence).select("pattern", "conf"))
        now = accepted.count()
        if now == before or not now:
            return accepted
        before = now
        own = graph.where("not seed").join(F.broadcast(accepted) if small(accepted, 96) else accepted, "pattern")
        found = own.groupBy("id").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.99)))))).alias("belief"))
        believed = cut(seeds.unionByName(found.join(seeds.select("id"), "id", "left_anti")))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Counts and base_sha256 are of the base kinds. spans lists those and what the patterns find, kind `id`, as
    kind:start:end in code points, by start and kind. Null and empty texts have none: base_sha256 is then that of the
    empty string. Kinds may overlap each other; a found span overlaps none. Repeated rows are searched each, and count
    once in the graph. Other columns are not read. No rows in, no rows out.
    """
    rows = extract(docs, id_col, text_col)
    met = rows.select("row", F.explode("found").alias("f")).select("row", "f.start", "f.end", "f.id", "f.seed", F.explode("f.patterns").alias("pattern"))
    good = confident(met.select("pattern", "id", "seed")).select("pattern")
    good = F.broadcast(good) if small(good, 96) else good
    found = met.where("not seed").join(good, "pattern", "left_semi").groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("k"), "end")).alias("more"))
    found = cut(found)
    found = F.broadcast(found) if small(found, 256) else found
    joined = rows.join(found, "row", "left").withColumn("more", F.coalesce("more", F.expr("array()").cast("array<struct<start:long,k:int,end:long>>")))
    every = F.array_sort(F.concat("base", "more"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size("more").cast("long").alias("n_found"))
