"""Tokenizers and other functions of text, as column expressions inside the JVM."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import EFFECTIVE_STOP_WORDS, SNIPPET_LENGTH

# What separates tokens of code, and parts of a name; white space is Unicode's, as (?U) makes \s mean.
CODE_BREAKS = r"""(?U)[\s\(\)\[\]\{\},:;=<>!+\-*/&|^~%"'`\\@#]+"""
NAME_BREAKS = r"(?U)[\s_.\-]+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def prose_words(text: Column, stop: bool = True) -> Column:
    """Lower-case words of letters a-z and digits, two characters at least, without stop words; repeats stay."""
    words = F.split(F.lower(text_or_empty(text)), "[^a-z0-9]+")
    banned = sorted(EFFECTIVE_STOP_WORDS)  # so many literals become a hash set
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*banned) if stop else F.length(w) >= 2)


def name_parts(token: Column) -> Column:
    """Parts of an identifier, lower-case: split at lower-upper borders, before the last capital of a run, and at _ . -"""
    spaced = F.regexp_replace(F.regexp_replace(token, "([a-z])(?=[A-Z])", "$1 "), "([A-Z])(?=[A-Z][a-z])", "$1 ")
    return F.transform(F.filter(F.split(spaced, NAME_BREAKS), lambda p: F.length(p) > 1), F.lower)


def code_words(text: Column) -> Column:
    """Each token of code in lower case, followed by its parts; repeats stay."""
    raw = F.filter(F.split(text_or_empty(text), CODE_BREAKS), lambda w: F.length(w) >= 2)
    return F.flatten(F.transform(raw, lambda w: F.concat(F.array(F.lower(w)), F.filter(name_parts(w), lambda p: p != F.lower(w)))))


def title_words(title: Column) -> Column:
    """What re-ranking compares with a query: no stop list, no stemming."""
    return F.array_distinct(F.filter(F.split(F.lower(text_or_empty(title)), "[^a-z0-9]+"), lambda w: F.length(w) > 1))


def snippet(text: Column, most: int = SNIPPET_LENGTH) -> Column:
    """The text's beginning, cut at the last space within `most` characters if there is one after the first."""
    t = F.regexp_replace(text_or_empty(text), r"(?U)^\s+|\s+$", "")
    head = F.substring(t, 1, most)
    at = most - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("...")))


def _marked(terms: list[str]) -> str | None:
    words = [t for t in sorted(set(terms), key=lambda t: (-len(t), t)) if t]
    return "(?i)(" + "|".join(map(re.escape, words)) + ")" if words else None


def mark_terms(text: str, terms: list[str], mark: str = "**") -> str:
    """highlight for a line that is shown."""
    pattern = _marked(terms)
    return re.sub(pattern, rf"{mark}\1{mark}", text) if pattern else text


def highlight(text: Column, terms: list[str], mark: str = "**") -> Column:
    """text with each occurrence of a term, in any case, between marks; longer terms first."""
    pattern = _marked(terms)
    return F.regexp_replace(text, pattern, f"{mark}$1{mark}") if pattern else text


# What a window is cleaned of, in this order.
CLEAN_UP = ((r"<[^>]+>", ""), (r"&\w+;", " "), (r"\s+", " "))


def window_of(text: str | None, terms: list[str] | None, width: int = 150) -> str:
    """The window of `width` characters, half of it before a match, with the most matches; the first of equals.

    Tags and entities go first. Without a term or a match, or in a short text, the beginning.
    """
    bare = text or ""
    for pattern, by in CLEAN_UP:
        bare = re.sub(pattern, by, bare)
    bare = bare.strip()
    wanted = [t for t in (terms if terms is not None else ()) if t]
    places = [m.start() for m in re.finditer("|".join(map(re.escape, wanted)), bare, re.IGNORECASE)] if wanted and len(bare) > width else []
    starts = [max(0, p - width // 2) for p in places]
    inside = [bisect_left(places, s + width) - bisect_left(places, s) for s in starts]
    best = starts[inside.index(max(inside))] if starts else 0
    return bare[best : best + width]


@F.pandas_udf(StringType())
def best_window(text: pd.Series, terms: pd.Series) -> pd.Series:
    """window_of for the few results that are shown."""
    return pd.Series([window_of(t, w) for t, w in zip(text, terms, strict=True)], dtype=object)
