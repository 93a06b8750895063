"""Byte-level BPE with tiktoken over a local rank file; long texts are cut where no match of the pattern can cross."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import arrow_map

#: Encoded at once; a longer text is cut at the first safe boundary beyond it.
CHUNK = 20_000
#: A place before which every match ends and at which one starts: white space after anything else, or a change between
#: letters and digits. No alternative of the pattern spans these, and none looks back.
SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[0-9])|(?<=[0-9])(?=\p{L})")
#: White space so long is matched by hand: the library's pattern engine goes back over it character by character.
BLANK = 10_000
_BLANK = regex.compile(r"(?<!\p{White_Space})\p{White_Space}{%d,}+" % BLANK)


#: A pattern of which any text is one match.
WHOLE = r"(?s).+"


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(f"local-{path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, most: int = CHUNK) -> list[str]:
    """text in pieces of about `most` characters, cut at safe boundaries only; letters or marks without any are one piece."""
    out, start = [], 0
    while len(text) - start > most:
        m = SAFE.search(text, start + most)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def blanks(text: str) -> list[tuple[str, bool]]:
    """text in parts, and of each whether it is one match: long white space is, but for its last character if more follows."""
    out, at = [], 0
    for m in _BLANK.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += [(text[at : m.start()], False), (text[m.start() : end], True)]
        at = end
    return [*out, (text[at:], False)]


def encode(text: str | None, enc: tiktoken.Encoding, whole: tiktoken.Encoding | None = None) -> list[int]:
    """Ids of the whole text; null and empty give none. Strings of special tokens are ordinary text.

    whole: the same ranks under a pattern that takes any text as one match, for long white space.
    """
    if not text:
        return []
    if len(text) <= min(CHUNK, BLANK):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part, one in blanks(text):
        for piece in [part] if one and part else chunks(part):
            out += (whole if one and whole else enc).encode_ordinary(piece)
    return out


def bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded unless ids is false.

    The ids are decoded to raw bytes again; decoded_sha256 is of these. A decoded text that differs from the encoded
    one raises. Null text counts as empty: no tokens. Repeated rows are coded each; other columns are not read.
    ranks is a path that every executor can open, by default of the installed vocabulary. A pattern of another kind than
    the installed one must also end every match before white space that follows anything else.
    """
    schema = "doc_id " + docs.select(id_col).schema[0].dataType.simpleString() + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if ids else "")

    def make():
        path, pat = default_ranks()
        enc, whole = encoding(ranks or path, pattern or pat), encoding(ranks or path, WHOLE)
        number = [b"%d" % i for i in range(enc.n_vocab)]

        def run(keys, texts):
            n, a, b, all_ids, raws = [], [], [], [], []
            for text in texts:
                got = encode(text, enc, whole)
                raw = enc.decode_bytes(got)
                if raw != (text or "").encode():
                    raise ValueError("ids do not decode to their text")
                n.append(len(got))
                a.append(hashlib.sha256(b",".join([number[i] for i in got])).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
                if ids:
                    all_ids.append(got)
                    raws.append(raw)
            return [keys, n, a, b, *([all_ids, raws] if ids else [])]

        return run

    return arrow_map(docs, [id_col, text_col], schema, make)
