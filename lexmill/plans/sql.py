"""DuckDB SQL that says what the library's queries say, built from common table expressions."""

from __future__ import annotations

from ..constants import (
    ACCEPTED_FACTOR, ALPHA, BETA, EFFECTIVE_STOP_WORDS, GAMMA, HOSTS, JUNK_TITLES, K1, MDN_UNWANTED, OFFICIAL_FACTOR,
    OFFICIAL_SOURCES, OVERFETCH, PYTHON_UNWANTED, STATIC_FILES, THIN_CODE, THIN_PROSE, TITLE_BONUS, TITLE_FACTOR, VOTE_WEIGHT, B,
)
from ..functions.porter import stem_sql


def texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


CORPUS = """corpus AS (
  SELECT d.doc_id AS id, substr(split_part(d.text, chr(10), 1), 1, 80) AS title, d.text AS prose_text, 'doc://' || d.doc_id AS url, 'load' || upper(d.lang) || 'Doc(' || d.source || '_' || (d.doc_id % 50) || ')' AS code_text,
         CASE CAST(substr(d.source, 4) AS INTEGER) % 3 WHEN 0 THEN 'stackoverflow' WHEN 1 THEN 'python_docs' ELSE 'mdn' END AS source,
         CAST(coalesce(l.quality, 0) * (d.doc_id % 100) AS BIGINT) AS score, coalesce(l.quality = 1, false) AS is_accepted
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
OFFICIAL = f"source IN ({texts(OFFICIAL_SOURCES)})"


def prose(t: str, stop: bool = True) -> str:
    words = f"list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda x: length(x) >= 2)"
    return f"list_distinct(list_filter({words}, lambda x: x NOT IN ({texts(sorted(EFFECTIVE_STOP_WORDS))})))" if stop else f"list_distinct({words})"


def code(t: str) -> str:
    raw = rf"""list_filter(string_split_regex({t}, '[\s\(\)\[\]\{{\}},:;=<>!+\-*/&|^~%"''`\\@#]+'), lambda r: length(r) >= 2)"""
    spaced = r"regexp_replace(regexp_replace(r, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    parts = rf"list_transform(list_filter(string_split_regex({spaced}, '[\s_.\-]+'), lambda p: length(p) > 1), lambda p: lower(p))"
    return f"list_distinct(flatten(list_transform({raw}, lambda r: list_concat([lower(r)], list_filter({parts}, lambda p: p <> lower(r))))))"


def title(t: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda x: length(x) > 1))"


def document() -> str:
    return f"list_distinct(list_concat({prose('prose_text')}, {code('code_text')}))"


def index(stem: bool = False) -> list[str]:
    """corpus, doc_terms, dl, df, stats, title_terms, postings."""
    out = [CORPUS]
    if stem:
        out += [f"raw_terms AS (SELECT id, unnest({prose('prose_text')}) AS term FROM corpus)", f"raw_titles AS (SELECT id, unnest({prose('title')}) AS term FROM corpus)", f"raw_queries AS (SELECT item_id AS query_id, unnest({prose('text')}) AS term FROM benchmark)"]
        out += ["vocabulary AS (SELECT term FROM raw_terms UNION SELECT term FROM raw_titles UNION SELECT term FROM raw_queries)", stem_sql("vocabulary")]
        out += [f"doc_terms AS (SELECT id, w AS term FROM raw_terms JOIN p9 ON term = word UNION SELECT id, unnest({code('code_text')}) AS term FROM corpus)", "title_terms AS (SELECT DISTINCT id, w AS term FROM raw_titles JOIN p9 ON term = word)"]
    else:
        out += [f"doc_terms AS (SELECT id, unnest({document()}) AS term FROM corpus)", f"title_terms AS (SELECT id, unnest({prose('title')}) AS term FROM corpus)"]
    return out + [
        "dl AS (SELECT id, count(*) AS dl FROM doc_terms GROUP BY id)",
        "df AS (SELECT term, count(*) AS df FROM doc_terms GROUP BY term)",
        "stats AS (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT count(*) FROM doc_terms) / (SELECT count(*) FROM corpus)::DOUBLE AS avgdl)",
        f"""postings AS (
  SELECT t.term, t.id AS doc_id, ln(n::DOUBLE / df) / dl AS tf_idf,
         ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * ({K1 + 1}::DOUBLE / (1 + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * dl / avgdl))) * CASE WHEN tt.term IS NULL THEN 1 ELSE {TITLE_FACTOR}::DOUBLE END AS bm25
  FROM doc_terms t JOIN dl ON t.id = dl.id JOIN df ON t.term = df.term CROSS JOIN stats LEFT JOIN title_terms tt ON t.id = tt.id AND t.term = tt.term)""",
    ]


def queries(stem: bool = False, texts: str = "SELECT item_id AS query_id, text FROM benchmark") -> list[str]:
    """q_terms (query_id, term) and q0, the vectors of weight 1, for the texts: the benchmark's, for stems these alone."""
    by_prose = "SELECT query_id, w AS term FROM raw_queries JOIN p9 ON term = word" if stem else f"SELECT query_id, unnest({prose('text')}) AS term FROM texts"
    return [f"texts AS ({texts})", f"q_terms AS ({by_prose} UNION SELECT query_id, unnest({code('text')}) FROM texts)", "q0 AS (SELECT query_id, term, 1.0::DOUBLE AS weight FROM q_terms)"]


def score(name: str, vectors: str, mode: str, k: int, boost: bool) -> list[str]:
    """name (query_id, rank, doc_id, title, source, final_score, raw_score, is_accepted, votes)."""
    column = "bm25" if mode == "bm25" else "tf_idf"
    final = f"raw_score * CASE WHEN is_accepted THEN {ACCEPTED_FACTOR}::DOUBLE ELSE 1 END * CASE WHEN {OFFICIAL} THEN {OFFICIAL_FACTOR}::DOUBLE ELSE 1 END + CASE WHEN score > 0 THEN {VOTE_WEIGHT}::DOUBLE * ln(1 + score::DOUBLE) ELSE 0 END" if boost else "raw_score"
    return [
        f"{name}_raw AS (SELECT query_id, doc_id, sum(weight * {column}) AS raw_score FROM {vectors} v JOIN postings p ON v.term = p.term WHERE weight > 0 GROUP BY query_id, doc_id)",
        f"{name}_cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 9) DESC, doc_id) AS k FROM {name}_raw) WHERE k <= {OVERFETCH * k})",
        f"{name}_met AS (SELECT query_id, doc_id, title, source, raw_score, is_accepted, score AS votes, {final} AS final_score FROM {name}_cut JOIN corpus ON doc_id = id)",
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, doc_id) AS rank FROM {name}_met) WHERE rank <= {k})",
    ]


def rerank(name: str, results: str, flags: dict[str, bool] | None = None) -> list[str]:
    on = {"accepted": True, "docs": True, "votes": True, "title": True} | (flags or {})
    return [
        f"{name}_lists AS (SELECT query_id, list(term) AS terms FROM q_terms GROUP BY query_id)",
        f"""{name}_parts AS (SELECT r.* EXCLUDE (final_score, rank), {f"CASE WHEN is_accepted THEN {ACCEPTED_FACTOR}::DOUBLE ELSE 1 END" if on["accepted"] else "1.0::DOUBLE"} AS accepted_factor,
  {f"CASE WHEN {OFFICIAL} THEN {OFFICIAL_FACTOR}::DOUBLE ELSE 1 END" if on["docs"] else "1.0::DOUBLE"} AS docs_factor,
  {f"CASE WHEN votes > 0 THEN {VOTE_WEIGHT}::DOUBLE * ln(1 + votes::DOUBLE) ELSE 0 END" if on["votes"] else "0.0::DOUBLE"} AS vote_bonus,
  len(list_intersect(terms, {title('title')})) AS title_hits FROM {results} r LEFT JOIN {name}_lists l ON r.query_id = l.query_id)""",
        f"{name}_sum AS (SELECT *, {f'{TITLE_BONUS}::DOUBLE * title_hits' if on['title'] else '0.0::DOUBLE'} AS title_bonus FROM {name}_parts)",
        f"{name}_final AS (SELECT *, raw_score * accepted_factor * docs_factor + vote_bonus + title_bonus AS final_score FROM {name}_sum)",
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, doc_id) AS rank FROM {name}_final)",
    ]


def rocchio(name: str, vectors: str, judgments: str) -> list[str]:
    """name (query_id, term, weight); judgments (query_id, doc_id, relevant)."""
    return [
        f"{name}_n AS (SELECT query_id, relevant, count(*) AS n FROM {judgments} GROUP BY ALL)",
        f"{name}_all AS (SELECT query_id, term, {ALPHA}::DOUBLE * weight AS weight FROM {vectors} UNION ALL SELECT j.query_id, p.term, CASE WHEN j.relevant THEN {BETA}::DOUBLE ELSE -{GAMMA}::DOUBLE END / n * tf_idf FROM {judgments} j JOIN {name}_n c ON j.query_id = c.query_id AND j.relevant = c.relevant JOIN postings p ON p.doc_id = j.doc_id)",
        f"{name} AS (SELECT query_id, term, sum(weight) AS weight FROM {name}_all GROUP BY query_id, term HAVING sum(weight) > 0)",
    ]


QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def metrics(name: str, results: str, by: str = "") -> list[str]:
    """name (by, query_id, p5, p10, mrr, ndcg_ref, ndcg_std); results (by, query_id, rank, doc_id)."""
    lead = f"{by}, " if by else ""
    every = f"SELECT DISTINCT s.{by}, q.query_id FROM qrels q CROSS JOIN (SELECT DISTINCT {by} FROM {results}) s" if by else "SELECT DISTINCT query_id FROM qrels"
    on = "e.query_id = h.query_id" + (f" AND e.{by} = h.{by}" if by else "")

    def d(first: str, last: str) -> str:
        return f"coalesce(list_sum(list_transform(range({first}, {last} + 1), lambda i: 1 / log2(i + 1))), 0)"

    return [
        f"{name}_hits AS (SELECT {lead}r.query_id, rank FROM {results} r JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE rank <= 20)",
        f"{name}_every AS ({every})",
        f"{name}_m AS (SELECT {'e.' + by + ', ' if by else ''}e.query_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS m, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS gain FROM {name}_every e LEFT JOIN {name}_hits h ON {on} GROUP BY ALL)",
        f"{name}_c AS (SELECT {'m.' + by + ', ' if by else ''}m.query_id, count(*) FILTER (rank <= m.m) AS c FROM {name}_m m LEFT JOIN {name}_hits h ON {on.replace('e.', 'm.')} GROUP BY ALL)",
        f"""{name} AS (SELECT {'m.' + by + ', ' if by else ''}m.query_id, h5 / 5.0::DOUBLE AS p5, m / 10.0::DOUBLE AS p10, coalesce(1.0::DOUBLE / first, 0) AS mrr,
  CASE WHEN m = 0 THEN 0 ELSE (c::DOUBLE / m * {d('1', 'm')} + CASE WHEN m < 10 THEN (m - c)::DOUBLE / (10 - m) * {d('m + 1', '10')} ELSE 0 END) / {d('1', 'm')} END AS ndcg_ref,
  CASE WHEN m = 0 THEN 0 ELSE gain / {d('1', 'm')} END AS ndcg_std FROM {name}_m m JOIN {name}_c c ON m.query_id = c.query_id{f' AND m.{by} = c.{by}' if by else ''})""",
    ]


def statement(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# Addresses made from page numbers, so that every rule of the URL filter has cases.
URL_CASE = """CASE page_id % 12 WHEN 0 THEN 'https://docs.python.org/3/library/text.html' WHEN 1 THEN 'https://docs.python.org/2.7/howto/' WHEN 2 THEN 'https://docs.python.org/3/tutorial/classes.html'
 WHEN 3 THEN 'https://developer.mozilla.org/en-US/blog/' || page_id WHEN 4 THEN 'https://developer.mozilla.org/en-US/docs/Web/API/' || page_id WHEN 5 THEN 'https://developer.mozilla.org/a/b.PNG'
 WHEN 6 THEN 'ftp://docs.python.org/3/x' WHEN 7 THEN 'https://docs.python.org/3/library/debug/' WHEN 8 THEN 'https://docs.python.org/3.8/library/os.html' WHEN 9 THEN 'HTTPS://docs.python.org/3/library/os.html?x=1' ELSE url END"""
URL_FILTER = rf"""
WITH u AS (SELECT page_id, {URL_CASE} AS url FROM pages),
p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, replace(list_extract(string_split(rtrim(path, '/'), '/'), -1), '.html', '') AS last FROM p)
SELECT page_id, url, CASE WHEN contains(host, 'python.org') THEN 'python_docs' ELSE 'mdn' END AS source,
  scheme IN ('http', 'https') AND host IN ({texts(HOSTS)}) AND NOT regexp_matches(path, '(?i)\.({"|".join(STATIC_FILES)})$')
  AND NOT (host = '{HOSTS[0]}' AND (regexp_matches(path, '^/(2|3\.[0-9]+|2\.[0-9]+)/') OR last IN ({texts(PYTHON_UNWANTED)})))
  AND NOT (host = '{HOSTS[1]}' AND ({" OR ".join(f"starts_with(path, '{p}')" for p in MDN_UNWANTED)})) AS allowed
FROM s"""
JUNK = f"list_bool_or(list_transform([{texts(JUNK_TITLES)}], lambda j: contains(lower(t), j)))"
THIN = THIN_PROSE

#: Addresses without their hosts' made-up parts, so that links stay on a site.
SITE_URL = r"regexp_replace(url, '://[^/]*(example\.[a-z]+)', '://\1')"
LINKS = rf"""
WITH p AS (SELECT page_id, {SITE_URL} AS url, html FROM pages),
l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM p)
SELECT page_id, link FROM l WHERE regexp_matches(link, '^https?://example\.(com|net|org)/') AND NOT regexp_matches(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), '(?i)\.({"|".join(STATIC_FILES)})$')"""


def _plain(t: str) -> str:
    """Without the three entities that the pages at hand have in their main text."""
    return f"replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _bare(t: str) -> str:
    """Pieces of text between tags, stripped, joined by spaces."""
    return _plain(rf"list_aggregate(list_filter(list_transform(string_split_regex({t}, '<[^>]*>'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 'string_agg', ' ')")


# The pages at hand have their main text in an article: a heading, then paragraphs, of which one that isn't closed holds
# all that follow.
PAGE = rf"""
WITH a AS (SELECT page_id, url, len(regexp_extract_all(html, '<a href="')) AS n_links, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
s AS (SELECT *, string_split(body, '<p>') AS parts FROM a),
t AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS k, unnest(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i = 1 THEN h1 WHEN contains(parts[i], '</p>') THEN split_part(parts[i], '</p>', 1) ELSE array_to_string(parts[i:], '<p>') END)) AS part FROM s),
b AS (SELECT page_id, k, {_bare("part")} AS words FROM t),
j AS (SELECT page_id, string_agg(words, ' ' ORDER BY k) FILTER (words <> '') AS prose FROM b GROUP BY page_id)
SELECT a.page_id, trim(regexp_replace({_plain("list_aggregate(list_transform(string_split_regex(h1, '<[^>]*>'), lambda x: trim(x)), 'string_agg', '')")}, '[^\x00-\x7F]+', '', 'g')) AS title,
  trim(regexp_replace(replace(coalesce(prose, ''), 'Â', ''), '[^\x00-\x7F]+', ' ', 'g')) AS prose_text, '' AS code_text, CASE WHEN contains(url, 'python.org') THEN 'python_docs' ELSE 'mdn' END AS source, n_links::BIGINT AS n_links
FROM a JOIN j ON a.page_id = j.page_id"""


def crawl(seeds: str, depth: int) -> str:
    """Pages by hop and address with dense ids, breadth first from the seeds (a condition on url), over LINKS."""
    return rf"""
WITH RECURSIVE site AS (SELECT page_id, {SITE_URL} AS url FROM pages), links AS ({LINKS}), text AS ({PAGE}),
step AS (SELECT DISTINCT s.url AS source_url, l.link FROM links l JOIN site s ON l.page_id = s.page_id),
reach AS (SELECT DISTINCT url, 0 AS hop FROM site WHERE {seeds} UNION SELECT link, hop + 1 FROM reach JOIN step ON source_url = url WHERE hop + 1 < {depth}),
first AS (SELECT url, min(hop) AS hop FROM reach GROUP BY url),
met AS (SELECT f.hop, f.url, t.title, t.prose_text, t.code_text FROM first f JOIN site s ON f.url = s.url JOIN text t ON t.page_id = s.page_id),
kept AS (SELECT * FROM met WHERE NOT (length(prose_text) < {THIN_PROSE} AND length(code_text) < {THIN_CODE}) AND NOT {JUNK.replace("lower(t)", "lower(title)")})
SELECT row_number() OVER (ORDER BY hop, url) - 1 AS id, hop, url, title FROM kept"""


def window_snippet(results: str, lists: str, width: int = 150) -> str:
    """query_id, rank, doc_id, snippet: the window with the most matches. Matches come from splitting the text at them."""
    return rf"""
w AS (SELECT r.query_id, r.rank, r.doc_id, trim(regexp_replace(regexp_replace(regexp_replace(c.prose_text, '<[^>]+>', '', 'g'), '&\w+;', ' ', 'g'), '\s+', ' ', 'g')) AS bare, '(?i)' || array_to_string(list_transform(l.terms, lambda t: regexp_escape(t)), '|') AS pattern
      FROM {results} r JOIN corpus c ON r.doc_id = c.id JOIN {lists} l ON r.query_id = l.query_id),
m AS (SELECT *, list_transform(string_split_regex(bare, pattern), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(bare, pattern), lambda x: length(x)) AS sizes FROM w),
places AS (SELECT *, list_transform(range(1, len(sizes) + 1), lambda i: coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(sizes[1:i - 1]), 0)) AS spots FROM m),
starts AS (SELECT *, list_transform(spots, lambda p: greatest(0, p - {width // 2})) AS s FROM places),
counted AS (SELECT *, list_transform(s, lambda x: len(list_filter(spots, lambda p: p >= x AND p < x + {width}))) AS n FROM starts)
SELECT query_id, rank, doc_id, substr(bare, CASE WHEN len(spots) = 0 OR length(bare) <= {width} THEN 1 ELSE s[list_position(n, list_max(n))] + 1 END::BIGINT, {width}) AS snippet FROM counted"""
