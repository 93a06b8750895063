"""URL filters: one trie over reversed host labels, then path segments; the longest rule wins, whether it allows or blocks.

The trie is built from the driver's rule list and goes to each executor. A list whose text exceeds RULE_BYTES isn't
broadcast: then every URL's host suffixes and path prefixes are joined with the rules as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ascii_lower

#: Fixed by the contract of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
RULE_BYTES = 16 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are [children by host label, paths]; paths are [children by whole segment, rules by the start of a further segment]."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = node[1] or [{}, {}]
            at = node[1]
            *whole, part = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            at[1][part] = (f"{host}{path}", verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule of most host labels that fits, among these of the longest path."""
        node, stack = self.root, []
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1]:
                stack.append(node[1])
        segments = path.split("/")
        for at in reversed(stack):
            best = None
            for segment in segments:
                best = next((at[1][segment[:k]] for k in range(len(segment), -1, -1) if segment[:k] in at[1]), best) if at[1] else best
                at = at[0].get(segment)
                if at is None:
                    break
            if best:
                return best
        return None


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", rule_bytes: int = RULE_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all its subdomains if the path starts with the rule's. More host labels win, then the
    longer path; two rules of the same host and path: the later one. No rule: rule is null and verdict the default.
    Null and malformed URLs have an empty host and path, which only a rule for the empty host could fit.
    Other columns are not read; repeated rows are judged each.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if sum(len(h) + len(p) + 16 for h, p, _ in rules) > rule_bytes:
        return _by_join(split, rules, default)
    schema = f"page_id {split.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def make():
        trie = Trie(rules)

        def run(ids, hosts, paths):
            found = [trie.find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            return [ids, hosts, paths, [f[0] for f in found], [f[1] for f in found]]

        return run

    return arrow_map(split, ["page_id", "host", "path"], schema, make)


def _by_join(split: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same by a shuffled join: each page meets the rules of its host suffixes and whole-segment path prefixes.

    Only suffixes and prefixes of as many labels and segments as some rule has are looked up.
    """
    spark = split.sparkSession
    table = spark.createDataFrame([(k, h.lower(), p[: p.rfind("/") + 1], p, h + p, v) for k, (h, p, v) in enumerate(rules)], "k long, rule_host string, stem string, rule_path string, rule string, rule_verdict string")
    rows = split.withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    some_labels = F.array(*map(F.lit, sorted({h.count(".") + 1 for h, _, _ in rules})))
    suffixes = F.transform(F.filter(some_labels, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    segments = F.split("path", "/")
    some_segments = F.array(*map(F.lit, sorted({p.count("/") for _, p, _ in rules})))
    stems = F.transform(F.filter(some_segments, lambda i: i < F.size(segments)), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/"))))
    keys = rows.select("row", "path", F.explode(suffixes).alias("rule_host"), stems.alias("stems")).select("row", "path", "rule_host", F.explode("stems").alias("stem"))
    best = keys.join(table, ["rule_host", "stem"]).where("startswith(path, rule_path)").groupBy("row").agg(F.max(F.struct(F.size(F.split("rule_host", r"\.")).alias("n"), F.length("rule_path").alias("m"), "k", "rule", "rule_verdict")).alias("b"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", "b.rule", F.coalesce("b.rule_verdict", F.lit(default)).alias("verdict"))
