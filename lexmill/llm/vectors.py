"""Near-duplicate vectors by NN-descent, within labels, in cosine distance.

Start: vectors of a label are dealt, several times, by the signs of random projections into small groups, and each
takes its nearest of the group. Refinement: every vector is a pivot at which its neighbours, forward and backward, meet
and are compared with each other; each keeps its nearest. Links are the listed pairs above the threshold.

Equal vectors are one weighted point. A list that holds nothing but links is saturated: it may be too short. Its point is
then compared with all of its label, in blocks, so that the list is as long as there are links and components that only
a link beyond its end joins are joined. An audit compares a fixed number of vectors with all of their label; while their
mean recall of links is too low, further starts and refinements follow, with lists twice as long each time. If that
doesn't help, all vectors are compared with all of their label.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, components, cut, small

SIMILARITY = 0.98
NEIGHBOURS = 10
TABLES, GROUP = 6, 40
REFINEMENTS = 2
#: Points of a label that one task compares with as many others at a time.
BLOCK = 512
AUDITED, RECALL, ATTEMPTS, MARGIN = 200, 0.99, 3, 0.03


def units(vecs: list) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.array(vecs, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def marked(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, part, vec, digest) of every row; cut. part: label and length; digest: of part and vector, equal for equal ones.

    part, vec and digest are null where a vector can't link.
    """
    kind, element = (vectors.select(c).schema[0].dataType.simpleString() for c in (id_col, vec_col))
    element = element if element in ("array<float>", "array<double>") else "array<double>"

    def make():
        def run(ids, vecs, labels):
            out = [ids, [], [], []]
            for v, label in zip(vecs, labels, strict=True):
                part = digest = None
                if v and label is not None and None not in v:
                    x = np.asarray(v, np.float64) + 0.0  # -0.0 becomes 0.0
                    top = np.abs(x).max()  # NaN if there is any
                    if np.isfinite(top) and top > 0:
                        part = f"{label}/{len(v)}"
                        digest = hashlib.blake2b(part.encode() + b"\n" + x.tobytes(), digest_size=16).digest()
                for col, value in zip(out[1:], (part, v if part else None, digest), strict=True):
                    col.append(value)
            return out

        return run

    out = arrow_map(vectors, [id_col, F.col(vec_col).cast(element), F.col(label_col).cast("string")], f"vec_id {kind}, part string, vec {element}, digest binary", make)
    return cut(out.withColumn("row", F.monotonically_increasing_id()))


def distinct_points(vectors: DataFrame) -> DataFrame:
    """(row, part, vec, digest, w, least_id): equal vectors of a label as one, their number and least id beside it; cut."""
    first = F.first(F.struct("part", "vec")).alias("v")
    return cut(vectors.where("digest is not null").groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("w"), F.min("vec_id").alias("least_id"), first).select("row", "v.part", "v.vec", "digest", "w", "least_id"))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) of each row's k nearest others, above its floor, block by block."""
    out = []
    for at in range(0, len(ids), 256):
        s = x[at : at + 256] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        m = min(k, len(ids) - 1)
        best = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sim = np.take_along_axis(s, best, 1)
        a = np.repeat(np.arange(at, at + len(s)), m)
        b, sim = best.ravel(), sim.ravel()
        if floor is not None:
            good = sim > floor[a]
            a, b, sim = a[good], b[good], sim[good]
        out.append((ids[a], ids[b], sim))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def start(points: DataFrame, tables: int, first: int, sizes: dict[str, int], k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, s): nearest within groups of about GROUP vectors of like signs; crowded groups are dealt on by id."""
    bits = {p: max(0, int(np.ceil(np.log2(max(n, 1) / GROUP)))) for p, n in sizes.items()}

    def make():
        planes: dict[int, np.ndarray] = {}

        def run(rows, parts, vecs):
            out = [[], [], [], []]
            for row, part, v in zip(rows, parts, vecs, strict=True):
                n = len(v)
                if n not in planes:
                    planes[n] = np.random.default_rng([n, first]).normal(size=(tables, 24, n))
                signs = planes[n] @ np.asarray(v) > 0
                for t in range(tables):
                    b = bits.get(part, 0)
                    out[0].append(row)
                    out[1].append(f"{part}/{t}/" + "".join("01"[int(z)] for z in signs[t, :b]))
                    out[2].append(v)
                    out[3].append((row * 2654435761 + t * 40503) % 2_147_483_647)
            return out

        return run

    dealt = arrow_map(points, ["row", "part", "vec"], f"row long, grp string, vec {points.schema['vec'].dataType.simpleString()}, salt long", make)
    # only crowded groups have more than one part; where they are too many to broadcast, a crowded key is split like any skewed one
    crowd = cut(dealt.groupBy("grp").agg(F.ceil(F.count("*") / (2.0 * GROUP)).cast("long").alias("m")).where("m > 1"))
    dealt = dealt.join(F.broadcast(crowd) if small(crowd, 256) else crowd, "grp", "left").withColumn("salt", F.pmod("salt", F.coalesce("m", F.lit(1))))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"a": [], "b": [], "s": []})
        a, b, s = _nearest(pdf["row"].to_numpy(), units(list(pdf["vec"])), k)
        return pd.DataFrame({"a": a, "b": b, "s": s})

    return dealt.groupBy("grp", "salt").applyInPandas(near, "a long, b long, s double")


def best_lists(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of each a, all its links besides; cut."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return cut(once.withColumn("k", rank).where(F.col("k") <= k).drop("k"))


def refine(points: DataFrame, lists: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Neighbours of neighbours: at each pivot its k nearest and k of those that list it are compared with each other."""
    back = lists.select(F.col("b").alias("p"), F.col("a").alias("m")).withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64("m", "p")))).where(F.col("k") <= k).drop("k")
    floor = lists.groupBy("a").agg(F.min("s").alias("floor"), F.count("*").alias("n"))
    members = lists.select(F.col("a").alias("p"), F.col("b").alias("m")).unionByName(back).distinct()
    at = members.join(points.select(F.col("row").alias("m"), "vec"), "m").join(floor.select(F.col("a").alias("m"), F.when(F.col("n") < k, -2.0).otherwise(F.col("floor")).alias("floor")), "m", "left")
    met = at.groupBy("p").agg(F.collect_list(F.struct("m", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor"))).alias("l"))

    def make():
        def run(groups):
            out = [[], [], []]
            for g in groups:
                if len(g) > 1:
                    ids = np.array([z["m"] for z in g])
                    got = _nearest(ids, units([z["vec"] for z in g]), k, np.array([z["floor"] for z in g]))
                    for col, values in zip(out, got, strict=True):
                        col.extend(values)
            return out

        return run

    return lists.unionByName(arrow_map(met, ["l"], "a long, b long, s double", make))


def enlarge(points: DataFrame, links: DataFrame, wanted: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Link counts (row, n, m) and components (node, root), both cut. n: linked vectors, own copies left out; m: points.

    The points of wanted (row) are compared with all of their label, in blocks; links between others are those listed.
    Nothing of a pair leaves a task but a link that joins components of listed links.
    """
    roots = components(links)
    wanted = cut(wanted.distinct())
    own = points.join(wanted.withColumn("wanted", F.lit(True)), "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left")
    own = own.select("row", "part", "vec", "w", F.coalesce("wanted", F.lit(False)).alias("wanted"), F.coalesce("root", "row").alias("root"))
    blocks = own.groupBy("part").agg(*(F.ceil(F.sum(x) / float(BLOCK)).cast("int").alias(c) for x, c in ((F.col("wanted").cast("int"), "m"), (F.lit(1), "n")))).where("m > 0")
    laid = own.join(blocks, "part")
    asks = laid.where("wanted").withColumns({"i": F.pmod(F.xxhash64("row", F.lit(5)), "m").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("n") - 1)), "asks": F.lit(True)})
    others = laid.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("m") - 1)), "j": F.pmod(F.xxhash64("row"), "n").cast("int"), "asks": F.lit(False)})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"row": [], "n": [], "m": [], "to": []}, dtype="int64")
        ids, to, ra, rb = (x.to_numpy() for x in (a["row"], b["row"], a["root"], b["root"]))
        hit = (units(list(a["vec"])) @ units(list(b["vec"])).T >= similarity) & (ids[:, None] != to[None, :])
        more = ~b["wanted"].to_numpy()  # a wanted point counts its links itself
        n = np.concatenate([hit @ b["w"].to_numpy(), a["w"].to_numpy() @ hit[:, more]])
        m = np.concatenate([hit.sum(1), hit[:, more].sum(0)])
        counted = pd.DataFrame({"row": np.concatenate([ids, to[more]]), "n": n, "m": m, "to": -1})
        x, y = np.nonzero(hit & (ra[:, None] != rb[None, :]))
        joined = np.unique(np.stack([ra[x], rb[y]]), axis=1)
        return pd.concat([counted[counted["n"] > 0], pd.DataFrame({"row": joined[0], "n": 0, "m": 0, "to": joined[1]})])

    found = cut(asks.unionByName(others).groupBy("part", "i", "j").applyInPandas(compare, "row long, n long, m long, to long"))
    joins = found.where("to >= 0").select(F.col("row").alias("a"), F.col("to").alias("b")).distinct()
    if not joins.isEmpty():
        roots = components(links.unionByName(joins))
    listed = links.join(wanted.withColumnRenamed("row", "a"), "a", "left_anti").join(wanted.withColumnRenamed("row", "b"), "b", "left_anti")
    listed = listed.join(points.select(F.col("row").alias("b"), "w"), "b").select(F.col("a").alias("row"), F.col("w").alias("n"), F.lit(1).cast("long").alias("m"))
    return cut(listed.unionByName(found.where("to < 0").drop("to")).groupBy("row").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))), roots


def to_audit(points: DataFrame, lists: DataFrame, similarity: float, most: int) -> list:
    """Points to audit, drawn by hash: up to half of them among those listed beside something nearly linked.

    Where links are rare, points drawn from all would hardly have any, and the audit would say nothing.
    """

    def drawn(of: DataFrame, n: int) -> list:
        return of.orderBy(F.xxhash64("row")).limit(n).select("row", "part", "vec").collect()

    near = lists.where(F.col("s") >= similarity - MARGIN).select(F.col("a").alias("row")).distinct()
    some = drawn(points.join(near, "row", "left_semi"), most // 2)
    known = {r["row"] for r in some}
    return some + [r for r in drawn(points, most - len(some)) if r["row"] not in known]


def audit(points: DataFrame, lists: DataFrame, counted: DataFrame, similarity: float) -> float:
    """Mean recall of linked points over those of AUDITED that have any, by brute force against all of their label."""
    some = to_audit(points, lists, similarity, AUDITED)
    if not some:
        return 1.0
    by_part: dict[str, tuple[list[int], list]] = {}
    for r in some:
        ids, vecs = by_part.setdefault(r["part"], ([], []))
        ids.append(r["row"])
        vecs.append(r["vec"])
    shared = points.sparkSession.sparkContext.broadcast({p: (np.array(i), units(v)) for p, (i, v) in by_part.items()})

    def make():
        def run(rows, parts, vecs):
            total: dict[int, int] = {}
            for part in set(parts):
                if part in shared.value:
                    ids, q = shared.value[part]
                    own = [k for k, p in enumerate(parts) if p == part]
                    hit = q @ units([vecs[k] for k in own]).T >= similarity
                    hit &= ids[:, None] != np.array([rows[k] for k in own])[None, :]
                    for i, n in zip(ids, hit.sum(1), strict=True):
                        total[int(i)] = total.get(int(i), 0) + int(n)
            return [list(total), list(total.values())]

        return run

    true = arrow_map(points, ["row", "part", "vec"], "row long, t long", make).groupBy("row").agg(F.sum("t").alias("t")).where("t > 0")
    got = true.join(counted, "row", "left").agg(F.avg(F.least("t", F.coalesce("m", F.lit(0))) / F.col("t")).alias("recall")).first()
    return 1.0 if got["recall"] is None else got["recall"]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link within a label if their cosine in double precision is at least `similarity`. Null, empty and zero
    vectors, those with null or non-finite components, and null labels link with nothing; vectors of different lengths
    don't link. component_id is the least vec_id reachable; a row without links is its own. Repeated rows are vectors of
    their own, linked with each other; rows that share an id, or have none, have each their own result, and a null id is
    the least of a component only if there is no other. Other columns are not read. No rows in, no rows out.
    """
    rows = marked(vectors, id_col, vec_col, label_col)
    points = distinct_points(rows)
    sizes = {r["part"]: r["n"] for r in points.groupBy("part").agg(F.count("*").alias("n")).collect()}
    lists = None
    for attempt in range(ATTEMPTS):
        k = NEIGHBOURS << attempt
        begun = start(points, TABLES, attempt, sizes, k)
        lists = best_lists(begun if lists is None else lists.unionByName(begun), k)
        for _ in range(REFINEMENTS):
            lists = best_lists(refine(points, lists, k), k)
        near = lists.where(F.col("s") >= similarity)
        links = cut(near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        full = links.groupBy(F.col("a").alias("row")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select("row")
        counted, roots = enlarge(points, links, full, similarity)
        if audit(points, lists, counted, similarity) >= RECALL:
            break
    else:
        counted, roots = enlarge(points, links, points.select("row"), similarity)
    own = points.join(roots.withColumnRenamed("node", "row"), "row", "left").join(counted, "row", "left")
    own = own.select("digest", "least_id", F.coalesce("root", "row").alias("root"), (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    least = cut(own.groupBy("root").agg(F.min("least_id").alias("component_id")))
    settled = cut(own.join(F.broadcast(least) if small(least, 64) else least, "root").select("digest", "n", "component_id"))
    settled = F.broadcast(settled) if small(settled, 128) else settled
    out = rows.select("vec_id", "digest").join(settled, "digest", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
