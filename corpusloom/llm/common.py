"""What the operators share: word rules, scratch tables, connected components.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, which the
driver and all executors share; they cut lineage, so a lost executor costs a
re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null doc_id in orderings: after every other.
LAST_ID = 9223372036854775807


#: Bytes of rows that travel to Python at once. Spark's default is sixteen times as much, for each of an executor's tasks, on both sides.
BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's limit for Arrow batches, unless the session has set one of its own."""
    if (spark.conf.get(BATCH, None) or "").rstrip("bB") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH, str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local master without it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
    """Write df as a scratch table and read it back; :func:`discard` deletes it.

    Not compressed: codecs hold native buffers that outlive their readers and writers, beside the heap of a long-lived executor, and what is
    written is mostly hashes or already compressed.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, beside other stages' heaps."""
    pa.default_memory_pool().release_unused()
    _libc()(0)


def thrifty(run):
    """A function for mapInArrow that gives memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of edges (a, b); component: the smallest node reachable.

    Alternates large-star and small-star steps, each of them one aggregation and
    one join on narrow rows, until the edge set is a set of stars. Both steps
    only ever replace edges, so the table never outgrows its start; a hot node's
    minimum is pre-aggregated before the shuffle, and adaptive execution splits
    its side of the join. Rounds grow with the logarithm of the longest path; if they do not end, an error is raised.
    """
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = materialize(small, "cc")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
