"""MinHash near-deduplication by a signature-coordinate inverted join.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets fall into one class first, so copies are
never compared. A class of a large set posts itself under (coordinate, value) pairs of its MinHash signature; a class
of a small set under its shingles themselves, which makes that part exact. Sets near the border do both, so that any
two sets of similar size meet in one of the two ways.

Prefix and skip: of the `coordinates` tokens of two classes at least `least` must agree. With tokens taken from the
rarest to the most frequent, two such classes share one of their first `coordinates - least + 1`. A token that only one
class has is a place skipped without posting: a class with fewer than `least` shared tokens posts nothing at all. What
is posted are the rarest shared tokens, so a line that half the corpus has is almost never among them.

A posting list is never expanded into its pairs. Collisions are first counted with one leader of each list: a member
meets the leader with which it shares the most lists, and they are compared on the full sets if their signatures agree
in `least` coordinates. Members that are in one component by then need no comparison with each other. In the lists whose
members are still apart, collisions are counted by merging: the task of a list posts its members under their
coordinate-value pairs, and goes breadth first from member to member, merging only the shortest of a member's lists, as
many as the prefix has; lists of the member alone are skipped, and only who turns up has its other coordinates counted.
A task returns no more candidates than a forest of them has. The trees of that forest, which hold only sets that look
alike, are compared exactly in blocks: a task holds the full sets of two blocks and returns no more links than join what
was apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, cut, free_name, join_spread, small

COORDINATES = 64
#: The chance that a pair of similarity 0.8 agrees in fewer of 64 coordinates is 4e-5.
LEAST = 38
#: Sets up to LITTLE shingles post these; sets from LARGE shingles post signatures. LARGE <= 0.8 * LITTLE.
LITTLE, LARGE = 40, 32
LEADER_ROUNDS = 1
#: Classes in a block of signatures, and in a block of full sets.
SIGNED_BLOCK, BLOCK = 8192, 512
#: Words whose hash a worker remembers.
REMEMBERED = 100_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; of fewer words the whole sequence is one; of none it is empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mixed(acc * _GOLD + h[j : j + len(acc)])
    return np.unique(acc)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _GOLD)
    return seeds[:n, None], seeds[n:, None] | np.uint64(1)


def signature(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One token a coordinate: its number and its minimum, hashed together."""
    flip, times = family
    least = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, ((s[None, at : at + 4096] ^ flip) * times).min(axis=1))
    return mixed(least + np.arange(len(flip), dtype=np.uint64) * _GOLD).view(np.int64)


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def profile(docs: DataFrame, id_col: str, text_col: str, width: int, marked: bool = False) -> DataFrame:
    """(row, doc_id, n, digest, large, little, brief): size, digest and tokens of every document's set; cut.

    brief holds 16 bits of each coordinate: enough to look for candidates. If marked, the text's MD5 is in `mark`.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def make():
        known, family = Words(), _family(COORDINATES)

        def run(ids, texts, *marks):
            n, digest, large, little, brief = [], [], [], [], []
            for text in texts:
                s = shingle_set(text, width, known)
                n.append(len(s))
                digest.append(_name(s) if len(s) else None)
                large.append(signature(s, family) if len(s) >= LARGE else None)
                little.append(mixed(s + np.uint64(1)).view(np.int64) if 0 < len(s) <= LITTLE else None)
                brief.append(None if large[-1] is None else large[-1].astype(np.int16).tobytes())
            return [ids, n, digest, large, little, brief, *marks]

        return run

    cols, fields = ([F.md5(text_col)], ", mark string") if marked else ([], "")
    got = arrow_map(docs, [id_col, text_col, *cols], f"doc_id {kind}, n long, digest binary, large array<long>, little array<long>, brief binary{fields}", make)
    return cut(got.withColumn("row", F.monotonically_increasing_id()))


def postings(classes: DataFrame, share: float) -> DataFrame:
    """(node, n, token): each class under the rarest of its shared tokens, as many as its prefix has beside skipped places."""
    large = classes.where("large is not null").select("node", "n", F.lit(0).alias("way"), F.lit(LEAST).alias("least"), F.explode("large").alias("token"))
    little = classes.where("little is not null").select("node", "n", F.lit(1).alias("way"), F.ceil(F.col("n") * share - 1e-9).cast("int").alias("least"), F.explode("little").alias("token"))
    tokens = large.unionByName(little)
    often = cut(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    met = join_spread(tokens, often, "token", "df")
    shared = met.groupBy("node", "n", "way", "least").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    taken = shared.withColumn("k", F.size("t") - F.col("least") + 1).where("k > 0")
    return cut(taken.select("node", "n", F.explode(F.expr("slice(t, 1, k)")).alias("p")).select("node", "n", "p.token").distinct())


def confirm(docs: DataFrame, id_col: str, text_col: str, width: int, names: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= similarity * union of their full sets; cut.

    Sets are made anew from the texts: a's with its partner's name beside it, b's once, and both meet at b. names:
    (node, least_id, digest). The wanted documents are marked at the map side if their count allows it.
    """

    def sets(wanted: DataFrame, keep: str, kind: str, out: str) -> DataFrame:
        wanted = cut(wanted.select(F.col("least_id").alias("__id"), F.col("digest").alias("__digest"), F.col(keep).alias("__keep")))
        side = F.broadcast(wanted) if small(wanted, 128) else wanted
        rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(side, F.col("__doc").eqNullSafe(F.col("__id")))

        def make():
            known = Words()

            def run(texts, digests, kept):
                got = [[], []]
                for text, digest, k in zip(texts, digests, kept, strict=True):
                    s = shingle_set(text, width, known)
                    if _name(s) == digest:  # another text may have the same id
                        got[0].append(k)
                        got[1].append(s.view(np.int64))
                return got

            return run

        return arrow_map(rows, ["__text", "__digest", "__keep"], f"{keep} {kind}, {out} array<long>", make)

    ours = pairs.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("partners")).join(names, "node").withColumn("of", F.struct(F.col("node").alias("a"), F.col("partners").alias("b")))
    a = sets(ours, "of", "struct<a:long,b:array<long>>", "sa").select(F.col("of.a").alias("a"), F.explode("of.b").alias("b"), "sa")
    b = sets(pairs.select(F.col("b").alias("node")).distinct().join(names, "node"), "node", "long", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    return cut(a.join(b.withColumnRenamed("node", "b"), "b").where(100 * both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= similarity * union of their sets of `width`-word shingles (A-Z
    lower-cased, words between ASCII white space); component_id is the least id reachable, kept whether it is the
    document's own. Null, empty and blank texts have no set and no link, and are kept. Rows that repeat an id and a
    set are in one component; a null id is never the least of a component with other ids. Ids may repeat. Other
    columns are not read. No rows in, no rows out. Similarity below 80 isn't supported: the borders above depend on it.
    """
    rows, of = _rooted(docs, id_col, text_col, width, similarity)
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = rows.where("digest is not null").select("doc_id", "n", "digest").join(of.join(least, "root").select("digest", "component_id"), "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _rooted(docs, id_col, text_col, width, similarity, marked=False) -> tuple[DataFrame, DataFrame]:
    """The profile of docs, and (digest, least_id, root) of its classes."""
    if similarity < 80:
        raise ValueError("similarity must be 80 at least")
    share = similarity / 100
    rows = profile(docs, id_col, text_col, width, marked)
    full = rows.where("digest is not null")
    classes = full.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("large").alias("large"), F.first("little").alias("little"))
    posts = postings(classes, share)
    names = cut(full.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")))
    linked = _components(docs, id_col, text_col, width, similarity, rows, names, posts)
    return rows, names.join(linked, "node", "left").select("digest", "least_id", F.coalesce("root", "node").alias("root"))


def _components(docs, id_col, text_col, width, similarity, rows, names, posts) -> DataFrame:
    """(node, root) of linked classes.

    In each leader round a class is compared with one leader, that with which it meets in the most lists among those
    of other components. What is still apart after them is compared pair by pair.
    """
    share = similarity / 100
    spark = docs.sparkSession
    names = cut(names.join(posts.select("node").distinct(), "node", "left_semi"))
    signs = cut(rows.where("large is not null").select(F.col("row").alias("node"), "large").join(names, "node", "left_semi"))
    links = tested = spark.createDataFrame([], "a long, b long")
    linked = spark.createDataFrame([], "node long, root long")
    open_ = posts.withColumn("root", F.col("node"))
    near = (F.col("na") >= share * F.col("nb") - 1e-9) & (F.col("nb") >= share * F.col("na") - 1e-9)
    agree = F.size(F.filter(F.arrays_zip("x", "y"), lambda z: z["x"] == z["y"]))
    for turn in range(LEADER_ROUNDS):
        lead = open_.groupBy("token").agg(F.min(F.struct(F.xxhash64("root", F.lit(turn)).alias("h"), F.xxhash64("node", F.lit(turn)).alias("g"), "node", "n", "root")).alias("lead"), F.count("*").alias("df"))
        met = join_spread(open_, cut(lead.where("df > 1")), "token", "df").where(F.col("root") != F.col("lead.root")).select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("lead.node").alias("b"), F.col("lead.n").alias("nb"))
        met = met.where(near).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k")).join(tested, ["a", "b"], "left_anti")
        pairs = cut(met.groupBy("a").agg(F.max(F.struct("k", "b", "na", "nb")).alias("m")).select("a", "m.b", F.least("m.na", "m.nb").alias("low")))
        signed = pairs.where(F.col("low") > LITTLE).join(signs.select(F.col("node").alias("a"), F.col("large").alias("x")), "a").join(signs.select(F.col("node").alias("b"), F.col("large").alias("y")), "b").where(agree >= LEAST)
        likely = cut(signed.select("a", "b").unionByName(pairs.where(F.col("low") <= LITTLE).select("a", "b")))
        got = confirm(docs, id_col, text_col, width, names, likely, similarity)
        tested = tested.unionByName(pairs.select("a", "b"))
        if not got.isEmpty():
            links = links.unionByName(got)
            linked = components(links)
        joined = posts.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = joined.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("token")
        open_ = cut(joined.join(apart, "token", "left_semi"))
        if open_.isEmpty():
            return linked
    forest = cut(candidate_forest(rows, names, open_, similarity))
    if forest.isEmpty():
        return linked
    got = cut(compare_blocks(docs, id_col, text_col, width, names, components(forest), open_.select("node", "root").distinct(), similarity))
    return linked if got.isEmpty() else components(links.unionByName(got))


class Forest:
    """Union-find over any numbers."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def in_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with (i, j), for every pair of the blocks, of `size` rows each, of a key; a key of one block isn't repeated."""
    blocks = rows.groupBy(key).agg(F.ceil(F.count("*") / float(size)).cast("int").alias("blocks"))
    laid = rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), "blocks").cast("int"))
    one = laid.where("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0)})
    more = laid.where("blocks > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return one.unionByName(more.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o")).drop("blocks")


class Merged:
    """Posting lists of some signatures by coordinate and value."""

    def __init__(self, brief: np.ndarray, signed: np.ndarray):
        self.brief, at = brief, np.flatnonzero(signed)
        order = np.argsort(brief[at], 0, kind="stable")
        values = np.take_along_axis(brief[at], order, 0)
        self.members = at[order]  # column by column the members, those of one list beside each other
        edge = np.ones((len(at) + 1, brief.shape[1]), bool)
        edge[1:-1] = values[1:] != values[:-1]
        place = np.arange(len(at) + 1)[:, None]
        low = np.maximum.accumulate(np.where(edge[:-1], place[:-1], 0), 0)
        high = np.minimum.accumulate(np.where(edge[1:], place[1:], len(at))[::-1], 0)[::-1]
        self.low, self.high = (np.zeros((len(brief), brief.shape[1]), np.int32) for _ in range(2))
        for whole, own in ((self.low, low), (self.high, high)):
            np.put_along_axis(whole, self.members, own.astype(np.int32), 0)

    def meet(self, x: int, allowed: np.ndarray, least: int) -> np.ndarray:
        """Allowed members that agree with x in `least` coordinates: the prefix is merged, the rest counted of whom it has."""
        size = self.high[x] - self.low[x]
        prefix = np.argsort(size, kind="stable")[: len(size) - least + 1]
        merged = [self.members[self.low[x, c] : self.high[x, c], c] for c in prefix.tolist() if size[c] > 1]
        if not merged:
            return np.empty(0, np.int64)
        met = np.zeros(len(allowed), bool)
        met[np.concatenate(merged)] = True
        found = np.flatnonzero(met & allowed)
        return found[(self.brief[found] == self.brief[x]).sum(1) >= least]


def forest_of_candidates(node, root, n, block, brief, little: dict[int, np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """Breadth first over one list: edges between candidates of different components, as many as a forest has.

    Arrays by member; little: tokens of little sets by place. Members of two blocks are compared across these alone.
    Two little sets are counted by their tokens, all others by their coordinates.
    """
    share, out = similarity / 100, []
    if (root == root[0]).all():
        return out
    posts: dict[int, list[int]] = {}
    for k, tokens in little.items():
        for t in tokens.tolist():
            posts.setdefault(t, []).append(k)
    crossed = (block != block[0]).any()
    signed, small_ = n >= LARGE, n <= LITTLE
    lists = Merged(brief, signed)
    waiting = np.ones(len(node), bool)
    queue: list[int] = []
    for first in range(len(node)):
        if not waiting[first]:
            continue
        queue.append(first)
        waiting[first] = False
        while queue:
            x = queue.pop()
            fits = waiting & (root != root[x]) & (n >= share * n[x] - 1e-9) & (share * n <= n[x] + 1e-9)
            if crossed:
                fits &= block != block[x]
            if not fits.any():
                continue
            found = lists.meet(x, fits & ~small_ if small_[x] else fits, LEAST) if signed[x] else np.empty(0, np.int64)
            if small_[x]:
                both = np.zeros(len(node), np.int64)
                for t in little[x].tolist():
                    both[posts[t]] += 1
                found = np.concatenate([found, np.flatnonzero(fits & small_ & (both > 0) & (100 * both >= similarity * (n + n[x] - both)))])
            waiting[found] = False
            queue.extend(found.tolist())
            out.extend((int(node[x]), int(node[y])) for y in found)
    return out


def candidate_forest(rows: DataFrame, names: DataFrame, open_: DataFrame, similarity: int) -> DataFrame:
    """(a, b): candidates of different components that share a list of open_, as many as spanning forests have.

    Large sets are candidates if their signatures agree; two little ones if they are links, which their tokens tell.
    Lists are dealt by token and read in order, a list (or two blocks of a long one) at a time.
    """
    tokens = rows.select(F.col("row").alias("node"), "brief", "little").join(names.select("node"), "node", "left_semi")
    laid = in_blocks(open_, "token", SIGNED_BLOCK).join(tokens, "node").select("token", "i", "j", "block", "node", "root", "n", "brief", "little")
    dealt = laid.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    empty = b"\0" * (2 * COORDINATES)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def search(table: pa.Table) -> pa.RecordBatch:
            cols = {c: table[c].to_numpy() for c in ("token", "i", "j", "block", "node", "root", "n")}
            brief = np.frombuffer(b"".join(x or empty for x in table["brief"].to_pylist()), np.int16).reshape(-1, COORDINATES)
            little = table["little"].to_pylist()
            change = np.flatnonzero((np.diff(cols["token"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
            out = []
            for low, high in zip([0, *change], [*change, table.num_rows], strict=True):
                own = {k - low: np.array(little[k]) for k in range(low, high) if little[k] is not None}
                out += forest_of_candidates(*(cols[c][low:high] for c in ("node", "root", "n", "block")), brief[low:high], own, similarity)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def last_list(batch: pa.RecordBatch) -> int:
            """Where the batch's last list begins."""
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            other = np.flatnonzero((keys != keys[:, -1:]).any(0))
            return int(other[-1]) + 1 if len(other) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            at = last_list(batch)
            if held and (at or [c[-1].as_py() for c in held[-1].columns[:3]] != [c[0].as_py() for c in batch.columns[:3]]):
                yield search(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            elif at:
                yield search(pa.Table.from_batches([batch.slice(0, at)]))
            held.append(batch.slice(at))
        if held:
            yield search(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def compare_blocks(docs, id_col, text_col, width, names, trees, roots, similarity) -> DataFrame:
    """Links (a, b) that join components, found by comparing all of a tree: trees (node, root), roots (node, root).

    The work grows with the square of a tree of look-alikes that are no links, in tasks of two blocks; nothing of a
    pair but a joining link leaves its task.
    """
    placed = in_blocks(trees.withColumnRenamed("root", "tree").join(roots, "node"), "tree", BLOCK)
    pairs = placed.groupBy("node", "root", "tree", "block").agg(F.collect_list(F.struct("i", "j")).alias("pairs")).join(names, "node")
    of = cut(pairs.select(F.col("least_id").alias("__id"), F.col("digest").alias("__digest"), F.struct("node", "root", "tree", "block", "pairs").alias("__of")))
    side = F.broadcast(of) if small(of, 512) else of
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(side, F.col("__doc").eqNullSafe(F.col("__id")))
    kind = of.schema["__of"].dataType.simpleString()

    def make():
        known = Words()

        def run(texts, digests, ofs):
            got = [[], []]
            for text, digest, o in zip(texts, digests, ofs, strict=True):
                s = shingle_set(text, width, known)
                if _name(s) == digest:  # another text may have the same id
                    got[0].append(o)
                    got[1].append(s.tobytes())
            return got

        return run

    sets = arrow_map(rows, ["__text", "__digest", "__of"], f"of {kind}, set binary", make)
    laid = sets.select("of.node", "of.root", "of.tree", "of.block", F.explode("of.pairs").alias("p"), "set").select("node", "root", "tree", "block", "p.i", "p.j", "set")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        a, b = pdf[pdf["block"] == pdf["i"].iloc[0]], pdf[pdf["block"] == pdf["j"].iloc[0]]
        linked = linked_pairs([np.frombuffer(s, np.uint64) for s in a["set"]], [np.frombuffer(s, np.uint64) for s in b["set"]], similarity)
        ra, rb, na, nb = (x.to_numpy() for x in (a["root"], b["root"], a["node"], b["node"]))
        forest = Forest()
        out = [(na[x], nb[y]) for x, y in np.argwhere(linked & (ra[:, None] != rb[None, :])) if forest.join(int(ra[x]), int(rb[y]))]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return laid.groupBy("tree", "i", "j").applyInPandas(compare, "a long, b long")


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray], similarity: int) -> np.ndarray:
    """Whether 100 * intersection >= similarity * union, for every set of a with every set of b; sets hold no repeats."""
    if not a or not b:
        return np.zeros((len(a), len(b)), bool)
    sa, sb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    in_a, in_b = np.unique(np.concatenate(a), return_counts=True), np.unique(np.concatenate(b), return_counts=True)
    common, ka, kb = np.intersect1d(in_a[0], in_b[0], assume_unique=True, return_indices=True)
    both = np.zeros((len(a), len(b)), np.int64)
    if not len(common):
        return both > 0
    often = (in_a[1][ka] * in_b[1][kb]) > (len(a) * len(b)) // 64

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the matrix of sets by common shingles."""
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, every), len(common) - 1)
        good = common[at] == every
        return owner[good], at[good]

    (ra, ca), (rb, cb) = entries(a), entries(b)
    dense = np.flatnonzero(often)
    place = np.full(len(common), -1)
    for start in range(0, len(dense), 4096):  # what many hold, by matrix products; float32 is exact far beyond such counts
        some = dense[start : start + 4096]
        place[:] = -1
        place[some] = np.arange(len(some))
        ma, mb = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for m, r, c in ((ma, ra, ca), (mb, rb, cb)):
            k = place[c] >= 0
            m[r[k], place[c[k]]] = 1
        both += (ma @ mb.T).astype(np.int64)
    ka, kb = ~often[ca], ~often[cb]  # what few hold, by meeting at the shingle
    if ka.any() and kb.any():
        ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
        order = np.argsort(cb, kind="stable")
        rb, cb = rb[order], cb[order]
        low, high = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
        count = high - low
        left = np.repeat(ra, count)
        right = rb[np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
        both += np.bincount(left * len(b) + right, minlength=both.size).reshape(both.shape)
    return 100 * both >= similarity * (sa[:, None] + sb[None, :] - both)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = 80) -> DataFrame:
    """One row of docs of each of near_dedup's components, and all rows without a set, with all their columns.

    The row of the least id stays, null ids after all others; of several texts under that id that of the least MD5,
    and of rows that share text and id any one. Rows leave by (id, MD5 of the text), so that no other row of their id
    does, at the map side when their count shows that they fit.
    """
    rows, of = _rooted(docs, id_col, text_col, width, similarity, marked=True)
    placed = cut(rows.select("doc_id", "mark", "digest").join(of.select("digest", "root"), "digest").drop("digest"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = placed.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    pair = placed.join(first, "root").groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__md5")).agg(F.max(own).alias("__kept"), F.count("*").alias("__n"))
    pair = cut(pair.where("not __kept or __n > 1"))
    again = not pair.where("__kept").isEmpty()
    pair = F.broadcast(pair) if small(pair, 128) else pair
    mark = free_name(docs, "__text_mark")
    joined = docs.withColumn(mark, F.md5(text_col)).join(pair, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col(mark) == F.col("__md5")), "left")
    whole = joined.where("coalesce(__kept, true)").select(*docs.columns, mark, F.coalesce("__n", F.lit(1)).alias("__n"))
    once = whole.where("__n = 1").select(*docs.columns)
    return once.unionByName(whole.where("__n > 1").dropDuplicates([id_col, mark]).select(*docs.columns)) if again else once
