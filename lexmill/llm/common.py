"""What the training-data operators share: Arrow maps over rows, durable cuts of lineage, row removal, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space, the separator of words in every contract of this subpackage.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to a Python function at a time: bounds what a worker holds beside one Arrow batch.
SLICE = 256
#: Rows in an Arrow batch, where the session has Spark's default of ten times as many: a batch of long texts must fit
#: several times into an executor, beside the JVM's heap.
BATCH = 1000
#: A side is broadcast only when its counted rows times their width stay below this many bytes.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. Where the session names none, a local session gets one of its own; a cluster's raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexmill-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from there; executors may go at any time afterwards.

    For narrow tables: rows are written as they are in memory. Spark removes them when nothing refers to them, if so set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, for wide tables, and its path, to be removed by the caller."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str | None) -> None:
    if path is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH rows, unless it was set lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH:
        spark.conf.set(key, str(BATCH))


def arrow_map(df: DataFrame, cols: list[str | Column], schema: T.StructType | str, make: Callable[[], Callable[..., list]]) -> DataFrame:
    """Map slices of rows in Python workers, Arrow in and out.

    make() runs once a partition and returns a function from lists of values, one a column, to lists of values,
    one a field of schema. The number of rows may change.
    """
    short_batches(df.sparkSession)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                out = function(*(c.to_pylist() for c in piece.columns))
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(out, fields, strict=True)], schema=fields)

    return df.select(*cols).mapInArrow(run, schema)


def arrow_add(df: DataFrame, col: str, fields: str, make: Callable[[], Callable[..., list]]) -> DataFrame:
    """df with further columns, made like arrow_map's from one column; no row is added or lost."""
    short_batches(df.sparkSession)
    more = T._parse_datatype_string(fields)
    schema = T.StructType([*df.schema.fields, *more.fields])
    arrow, new = to_arrow_schema(schema), to_arrow_schema(more)
    at = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                out = function(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(v, f.type) for v, f in zip(out, new, strict=True))], schema=arrow)

    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; lower() would touch other alphabets."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether df, counted, may be broadcast. Count a cut table: counting another computes it twice."""
    return df.limit(BROADCAST_BYTES // row_bytes + 1).count() * row_bytes <= BROADCAST_BYTES


#: Keys that join_spread broadcasts, at most.
HEAVY_KEYS = 50_000


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with table, a cut table of one row a key (long) that says in column n how many rows the key has.

    The keys of the most rows, of which there can be no more than HEAVY_KEYS, are broadcast; their rows are spread by a
    hash of themselves in the shuffled join of the others, so that no task gets a hot key.
    """
    names = [c for c in table.columns if c != key]
    least = (table.agg(F.sum(n)).first()[0] or 0) / HEAVY_KEYS
    held = table.select(F.col(key).alias("__key"), F.struct(*names).alias("__own"), (F.col(n) > least).alias("__heavy"))
    heavy = F.broadcast(held.where("__heavy").select(F.col("__key").alias(key), F.col("__own").alias("__near")))
    met = rows.join(heavy, key, "left").withColumn("__key", F.when(F.col("__near").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    far = met.join(held.where("not __heavy").select("__key", F.col("__own").alias("__far")), "__key", "left")
    return far.withColumn("__own", F.coalesce("__near", "__far")).where("__own is not null").select(*rows.columns, *(F.col(f"__own.{c}").alias(c) for c in names))


def without(rows: DataFrame, dropped: DataFrame, id_col: str, row_bytes: int = 64) -> DataFrame:
    """Rows whose id isn't among dropped.id: at the map side if that table is small by count, else by a shuffled anti-join."""
    gone = dropped.select(F.col(dropped.columns[0]).alias("__gone")).distinct()
    gone = F.broadcast(gone) if small(gone, row_bytes) else gone
    return rows.join(gone, rows[id_col].eqNullSafe(gone["__gone"]), "left_anti")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their numbers, from 0, in the given order: a range sort, then an offset for each partition. No task sees all."""
    part, at = free_name(rows, "__part"), free_name(rows, "__at")
    sorted_ = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    ends = sorted_.groupBy(part).agg(F.count("*").alias("n"), F.min(at).alias("low")).collect()
    shift, total = [], 0
    for r in sorted(ends, key=lambda r: r[part]):
        shift.append((r[part], total - r["low"]))
        total += r["n"]
    moves = rows.sparkSession.createDataFrame(shift, f"`{part}` int, __shift long")  # one row a partition
    return sorted_.join(F.broadcast(moves), part).withColumn(name, F.col(at) + F.col("__shift")).drop(part, at, "__shift")


def components(edges: DataFrame, rounds: int = 60, edges_a_task: int = 200_000) -> DataFrame:
    """Connected components of edges (a, b: long) by alternating large and small stars.

    Minima are pre-aggregated before each shuffle and joined back, so that a node with very many neighbours is split
    like any skewed join key. Returns (node, root), root the least node of the component; nodes without an edge to
    another node are left out. Self-loops and repeated edges do no harm. Every round is cut. Between shuffles a task
    takes about edges_a_task edges, so that a small graph isn't dealt over as many files as the corpus.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = max(8, now.count() // edges_a_task + 1)

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(tasks)

    def minima(e: DataFrame) -> DataFrame:
        return few(e.groupBy("a").agg(F.min("b").alias("m")))

    now, before = few(now), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = few(few(both.join(minima(both), "a")).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        low = minima(large)
        star = few(large.join(low, "a"))
        now = cut(few(star.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()))
        at = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if at == before:
            break
        before = at
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
