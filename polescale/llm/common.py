"""Helpers shared by the corpus operators: work tables, row ids, components.

Intermediate results that several later steps read are written once as
Parquet in the folder that the cluster names in ``spark.checkpoint.dir``.
That folder is shared, so a lost executor costs only its running tasks, and
the shuffle files behind a written table are freed with the write.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that separate words, and a regular expression of a word.
WHITE = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: While a work table is written: Spark deletes a query's shuffle files as soon as it has ended, and Python gets texts in batches of a few MB.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A session on this machine alone may name none and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a shared folder for work tables")
        found = tempfile.mkdtemp(prefix="polescale-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[list[Workspace]] = []


@contextmanager
def scratch():
    """Deletes at its end the work tables of all operators called within: for results that have been written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for ws in _scopes.pop():
            ws.close()


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, each query's shuffle files go when the query ends, and not when the driver happens to collect its garbage."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """Tables of one operator call in the shared folder.

    ``save`` writes a table and returns it read back, without its lineage.
    ``drop`` deletes tables that no later step reads, ``close`` all. What is
    left goes at the end of the ``scratch`` around the operator's call, else
    when the session's process ends, as results may still be read lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: set[str] = set()
        if _scopes:
            _scopes[-1].append(self)
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        with freed_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_table = path
        self._paths.add(path)
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._remove(df._work_table)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        for path in self._paths - {df._work_table for df in tables}:
            self._remove(path)

    def close_tables(self) -> None:
        self.keep()

    def _remove(self, path: str) -> None:
        if path in self._paths:
            self._paths.discard(path)
            self._delete(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; its folder is cleaned by whoever owns it
            pass


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, however it is written."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        out.append(w)
    return out


def in_order(ws: Workspace, df: DataFrame, order: list[Column], name: str = "ranged") -> tuple[DataFrame, str, str]:
    """``df`` range-partitioned and sorted, written with two more columns: partition and place in it. Also their names.

    Rows alike in ``order`` are dealt over partitions too, by a number of
    their own, so no task gets a large group of copies.
    """
    part, at = free_names(df, "_part", "_at")
    salted = df.withColumn(at, F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*order, F.col(at).asc()).sortWithinPartitions(*order, F.col(at).asc()).drop(at)
    ranged = ranged.withColumn(at, F.monotonically_increasing_id())  # partition and place, as one number
    ranged = ws.save(ranged, name).withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1))
    return ranged, part, at


def global_row_number(ws: Workspace, df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out`` = 0, 1, ... in the given order, without a single-task window.

    Places within a partition are written with it, then shifted by the rows
    of the partitions before it (one small row for each partition).
    """
    ranged, part, at = in_order(ws, df, order)
    sizes = ranged.groupBy(F.col(part).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("p").alias(part), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_s"))
    [s] = free_names(ranged, "_shift")
    return ranged.join(F.broadcast(shift.withColumnRenamed("_s", s)), part).withColumn(out, F.col(at) + F.col(s)).drop(part, at, s)


def documents_of(ws: Workspace, docs: DataFrame, *more: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_uid`` long, ``_id`` (the key), ``_text`` and further columns of ``docs``; others, with whatever names, are left behind.

    ``_uid`` is unique and rises with the key. It is the key itself unless
    the key has nulls or repeats; then rows are numbered by the key (nulls
    last), then by the text, so rows alike in both are in either order.
    """
    base = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), *more)
    ids = docs.select(F.col(key).cast("long").alias("i"))
    clash = ids.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null").limit(1).count()
    if not clash:
        return base.withColumn("_uid", F.col("_id"))
    return global_row_number(ws, base, [F.col("_id").asc_nulls_last(), F.col("_text").asc_nulls_last()], "_uid")


class Bitmap:
    """Bits of hashed 64-bit keys: tells most other keys apart, whatever their number."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, rows: pa.Table, bits: int) -> Bitmap:
        """From rows ``word, bits``."""
        words = np.zeros(max(1, bits // 64), np.int64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return cls(words, bits)

    def hit(self, keys: np.ndarray) -> np.ndarray:
        at = place_of(keys, self.bits)
        return self.words[at >> 6] >> (at & 63) & 1 == 1


def place_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """As ``bitmap`` places them: ``bits`` is a power of two."""
    return (keys ^ keys >> 32) & (bits - 1)


def bitmap(df: DataFrame, key: str, bits: int) -> Bitmap:
    """Of the keys (long, not null) of ``df``. ``bits / 64`` small rows at most reach the driver, for any number of keys."""
    at = F.col(key).bitwiseXOR(F.shiftright(key, 32)).bitwiseAND(bits - 1)
    got = df.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    return Bitmap.of(got, bits)


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: a row ``(node, comp)`` for each node, ``comp`` the smallest node.

    Large-star and small-star steps in turn (Kiveris et al. 2014): each keeps
    the components and hangs neighbours on their smallest one, until nothing
    changes; there is no other end. Every step is a partially aggregated
    minimum and an equi-join, so no component's nodes are gathered in one
    task. The minima are dealt out anew before the join, which adaptive
    execution then may split at a node with very many neighbours.
    """

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()

    tasks = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    e = ws.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    now = state(e)
    while now[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition(tasks)
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = ws.save(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).repartition(tasks)
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        new = ws.save(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
        ws.drop(large, e)
        before, now, e = now, state(new), new
        if before == now:
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return nodes.union(roots)
