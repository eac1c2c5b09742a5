"""What the operators share: durable intermediate tables, word rules, joins that stand skew, components of a graph."""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than these six ASCII white spaces.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of at most so many rows and bytes may be broadcast; both are counted before, and a salted join serves beyond them.
SMALL_ROWS, SMALL_BYTES = 100_000, 64 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: With each so many tables written, and every so many seconds while one is written, the driver collects its garbage.
TIDY_EVERY, TIDY_S = 8, 15.0

_stashes: list[Stash] = []
_shipped: set[str] = set()
_lock = threading.Lock()
_written = itertools.count(1)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run, and bounds what crosses to them at a time by bytes, unless the session
    has a bound of its own."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")
    key = spark.sparkContext.applicationId
    with _lock:
        if key in _shipped:
            return
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(key)


def settle(spark: SparkSession) -> None:
    """Has executors collect their garbage, so that heaps which earlier stages filled shrink before Python workers grow beside them: one short
    task a core. An executor that none of them reaches stays as it is."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def settle_driver(spark: SparkSession) -> None:
    """Has the driver collect its garbage: its heap shrinks, and Spark lets go of broadcasts, shuffles and metrics of queries that are over.
    Left to itself the heap grows to its limit with the number of tasks, beside what the JVM and Python hold outside it. Python gives back what
    it doesn't use."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def tended(spark: SparkSession) -> Iterator[None]:
    """While this lasts, the driver collects its garbage every TIDY_S seconds, so that a long job's tasks don't fill its heap."""
    over = threading.Event()

    def tend() -> None:
        while not over.wait(TIDY_S):
            try:
                settle_driver(spark)
            except Exception:  # the session has ended; the job itself says why
                return

    thread = threading.Thread(target=tend, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a session that sets none (tests), a temporary one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stash:
    """Tables written once as Parquet in the shared folder and read from there: lineage ends, and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"
        _stashes.append(self)

    def inner(self) -> Stash:
        """A stash of its own names that goes with this one."""
        made = object.__new__(Stash)
        made.spark, made.path = self.spark, f"{self.path}/inner-{uuid.uuid4().hex}"
        return made

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        with tended(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        if next(_written) % TIDY_EVERY == 0:
            settle_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for where in [f"{self.path}/{n}" for n in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Deletes all intermediate tables of this process; frames made from them can't be read afterwards."""
    while _stashes:
        try:
            _stashes.pop().drop()
        except Exception:  # that session may have ended before; others may not
            continue


atexit.register(release)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def is_small(df: DataFrame) -> bool:
    """Whether df may be broadcast, by rows and by bytes."""
    each = lambda f: F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 16 * F.size(f.name) if isinstance(f.dataType, T.ArrayType) else F.lit(8)
    size = sum((F.coalesce(each(f), F.lit(0)).cast("long") for f in df.schema), F.lit(0).cast("long"))
    found = df.select(size.alias("size")).limit(SMALL_ROWS + 1).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    return found.n <= SMALL_ROWS and (found.size or 0) <= SMALL_BYTES


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int = 64) -> DataFrame:
    """left ⋈ right on columns that are not null, where right has one row a key. right is broadcast if it has SMALL_ROWS rows and SMALL_BYTES at most;
    else left is salted and right repeated once for each salt, so that no key of left meets in one task."""
    if is_small(right):
        return left.join(F.broadcast(right), on, how)
    salt = F.pmod(F.xxhash64(*[c for c in left.columns if c not in on] or on), F.lit(salts))
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.withColumn("_salt", salt.cast("long")).join(many, [*on, "_salt"], how).drop("_salt")


def components(stash: Stash, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): component is the smallest id that a node reaches.

    Each round every node points to the one of most neighbours among its neighbours and itself, of those to the one with the least hash of
    the round, and the graph is contracted along these pointers: a star falls to its hub in one round, a chain by a constant factor.
    Rounds end in written tables, so joins start from fresh exchanges, which adaptive execution can split where a hub is hot."""
    edges = stash.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    chain, r = None, 0
    while not edges.isEmpty():
        degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
        degree = stash.keep(degree, f"{name}-degree{r}")
        known = edges.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
        rank = lambda c, d, r=r: F.struct((-F.col(d)).alias("d"), F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("id"))
        seen = known.select(F.explode(F.array("a", "b")).alias("node"), F.least(rank("a", "da"), rank("b", "db")).alias("top"))
        step = stash.keep(seen.groupBy("node").agg(F.min("top").alias("top")).select("node", F.col("top.id").alias("to")), f"{name}-step{r}")
        to_a, to_b = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
        edges = stash.keep(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), f"{name}-edges{r + 1}")
        if chain is None:
            chain = step
        else:
            later = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            chain = stash.keep(chain.join(later, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"{name}-chain{r}")
        r += 1
    if chain is None:
        return stash.spark.createDataFrame([], "node long, component long")
    least = stash.keep(chain.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component")), f"{name}-least")
    return stash.keep(chain.join(least, "to").select("node", "component"), f"{name}-components")


def by_rows(stash: Stash, df: DataFrame, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run over df, for a run that takes the key for a name of one row and returns it with component_id and kept. Where keys repeat, rows
    are numbered, run links the numbers, and a component is called by its least key; each row is judged by its own content."""
    named = df.where(F.col(key).isNotNull())
    if named.groupBy(key).count().where("count > 1").isEmpty():
        return run(df)
    rows = stash.keep(named.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = stash.keep(run(rows.drop(key).withColumnRenamed("_row", key)).drop("kept").withColumnRenamed(key, "_row").join(rows.select(key, "_row"), "_row").drop("_row"), "by-rows")
    least = found.groupBy("component_id").agg(F.min(key).alias("_least"))
    done = join_small(found, stash.keep(least, "least-keys"), ["component_id"], "inner").drop("component_id").withColumnRenamed("_least", "component_id")
    nameless = run(df.where(F.col(key).isNull()))
    return nameless.drop("kept").unionByName(done).select(*nameless.drop("kept").columns, F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def text_parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in parts of at most so many bytes, one text at least: the place of the first, and the texts. Only one part
    is held as Python strings at a time."""
    texts = batch.column(column)
    ends, at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)), 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, texts.slice(at, to - at).to_pylist()
        at = to


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at a task's end the worker, which lives on, gives what it doesn't use back to the machine."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
