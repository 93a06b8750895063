"""Porter's stemmer (1980) from one table of rules, as SQL that both Spark and DuckDB read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a stem must look like, as regular expressions without look-around. C, V: runs of consonants, vowels.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_H = f"(?:{_C}{_V}|[aeiou]+)"
M_OVER_0, M_IS_1, M_OVER_1 = f"^{_H}{_C}", f"^{_H}{_C}(?:{_V})?$", f"^{_H}{_C}{_V}{_C}"
HAS_VOWEL = f"^(?:[aeiou]|{_C}[aeiouy])"
ENDS_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
ANY = "^"

# Fixed values: (condition of the stem, suffix, replacement) by step; the longest suffix that fits decides.
STEP_1A = [(ANY, "sses", "ss"), (ANY, "ies", "i"), (ANY, "ss", "ss"), (ANY, "s", "")]
STEP_1C = [(HAS_VOWEL, "y", "i")]
STEP_2 = [(M_OVER_0, a, b) for a, b in (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)]
STEP_3 = [(M_OVER_0, a, b) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))]
M_OVER_1_ST = f"^{_H}{_C}{_V}(?:{_C}.*)?[st]$"
STEP_4 = [(M_OVER_1_ST if a == "ion" else M_OVER_1, a, "") for a in (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)]


def _sql(dialect: str) -> tuple[str, str]:
    return {"spark": ("regexp_like", "endswith"), "duckdb": ("regexp_matches", "ends_with")}[dialect]


def _step(w: str, rules: list[tuple[str, str, str]], dialect: str) -> str:
    match, ends = _sql(dialect)
    cases = []
    for condition, suffix, new in sorted(rules, key=lambda r: -len(r[1])):
        stem = f"substr({w}, 1, length({w}) - {len(suffix)})"
        new_word = f"concat({stem}, '{new}')"
        cases.append(f"WHEN {ends}({w}, '{suffix}') THEN " + (new_word if condition == ANY else f"CASE WHEN {match}({stem}, '{condition}') THEN {new_word} ELSE {w} END"))
    return "CASE " + " ".join(cases) + f" ELSE {w} END"


def steps(dialect: str = "spark", w: str = "w") -> list[str]:
    """Expressions of a column w, to be applied one after the other; words of up to two letters stay."""
    match, ends = _sql(dialect)

    def cut(n: int) -> str:
        return f"substr({w}, 1, length({w}) - {n})"

    def removed(suffix: str) -> str:
        stem = cut(len(suffix))
        return f"WHEN {ends}({w}, '{suffix}') AND {match}({stem}, '{HAS_VOWEL}') THEN concat({stem}, '+')"  # + marks a removal

    bare = cut(1)
    short = f"{match}({bare}, '{M_IS_1}') AND {match}({bare}, '{ENDS_CVC}')"
    doubles = "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxy")
    step_1b = f"CASE WHEN {ends}({w}, 'eed') THEN CASE WHEN {match}({cut(3)}, '{M_OVER_0}') THEN {bare} ELSE {w} END {removed('ed')} {removed('ing')} ELSE {w} END"
    tidy = f"CASE WHEN NOT {ends}({w}, '+') THEN {w} WHEN {match}({bare}, '(?:at|bl|iz)$') THEN concat({bare}, 'e') WHEN {match}({bare}, '(?:{doubles})$') THEN {cut(2)} WHEN {short} THEN concat({bare}, 'e') ELSE {bare} END"
    step_5a = f"CASE WHEN NOT {ends}({w}, 'e') THEN {w} WHEN {match}({bare}, '{M_OVER_1}') THEN {bare} WHEN {match}({bare}, '{M_IS_1}') AND NOT {match}({bare}, '{ENDS_CVC}') THEN {bare} ELSE {w} END"
    step_5b = f"CASE WHEN {ends}({w}, 'll') AND {match}({bare}, '{M_OVER_1}') THEN {bare} ELSE {w} END"
    middle = [_step(w, rules, dialect) for rules in (STEP_1C, STEP_2, STEP_3, STEP_4)]
    return [_step(w, STEP_1A, dialect), step_1b, tidy, *middle, step_5a, step_5b]


def stem_column(words: DataFrame, word: str, stem: str) -> DataFrame:
    """words with a column stem of its column word. Meant for a vocabulary, each word once.

    The stem leaves through an explode of one element: a filter on it, as joins infer, would otherwise be pushed below
    the steps and double in each.
    """
    columns = words.columns
    out = words.withColumn("__w", F.col(word))
    for e in steps("spark", "__w"):
        out = out.withColumn("__w", F.expr(f"CASE WHEN length({word}) <= 2 THEN {word} ELSE {e} END"))
    return out.select(*columns, F.explode(F.array("__w")).alias(stem))


def stem_sql(table: str, word: str = "term") -> str:
    """DuckDB common table expressions p0 .. p9, the last with columns (word, w) for the distinct words of table."""
    out = [f"p0 AS (SELECT DISTINCT {word} AS word, {word} AS w FROM {table})"]
    for k, e in enumerate(steps("duckdb")):
        out.append(f"p{k + 1} AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE {e} END AS w FROM p{k})")
    return ", ".join(out)
