"""A project as a folder of Parquet tables: facts with provenance, replaced partitions, all-or-nothing writes, export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import scratch

SCHEMA_VERSION = 6
META = "_meta"


class Project:
    """Tables below ``path``. Each table has generations, and a pointer to the one that holds.

    A write makes a new generation beside the old one; readers follow the pointer, which is moved by a rename once the
    generation is complete. So a reader sees a whole table, and a writer that dies leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self, table: str) -> str:
        return f"{self.path}/{table}/current"

    def _generation(self, table: str) -> str | None:
        if not scratch.exists(self.spark, self._pointer(table)):
            return None
        return self.spark.read.text(self._pointer(table)).first()["value"]

    def read(self, table: str) -> DataFrame:
        generation = self._generation(table)
        if generation is None:
            raise FileNotFoundError(f"{self.path}/{table}")
        return self.spark.read.parquet(f"{self.path}/{table}/{generation}")

    def write(self, **tables: DataFrame) -> None:
        """Replace tables: all are written first, then all pointers move. If a write fails, none has moved."""
        made = {}
        try:
            for name, rows in tables.items():
                made[name] = scratch.scratch_path(self.spark, "generation").rsplit("/", 1)[-1]
                rows.write.parquet(f"{self.path}/{name}/{made[name]}")
        except Exception:
            for name, generation in made.items():
                scratch.delete(self.spark, f"{self.path}/{name}/{generation}")
            raise
        for name, generation in made.items():
            old, fresh = self._generation(name), f"{self.path}/{name}/next"
            self.spark.createDataFrame([(generation,)], "value string").coalesce(1).write.mode("overwrite").text(fresh)
            scratch.delete(self.spark, self._pointer(name))
            scratch.rename(self.spark, fresh, self._pointer(name))
            if old is not None:
                scratch.delete(self.spark, f"{self.path}/{name}/{old}")

    def replace_papers(self, table: str, rows: DataFrame, papers: DataFrame) -> None:
        """Delete the papers' (paper_id) rows of a table and put rows in their place."""
        kept = self.read(table).join(papers.select("paper_id").distinct(), "paper_id", "left_anti").select(*rows.columns)
        self.write(**{table: kept.unionByName(rows)})

    def remove_papers(self, papers: DataFrame, tables: list[str], chunks: str | None = None, of_chunks: tuple[str, ...] = ()) -> None:
        """Delete papers from tables that have paper_id, and from those of their chunks, which have chunk_id only; all or none."""
        gone = papers.select("paper_id").distinct()
        out = {t: self.read(t).join(gone, "paper_id", "left_anti") for t in tables}
        if chunks is not None:
            lost = self.read(chunks).join(gone, "paper_id", "left_semi").select("chunk_id")
            out |= {t: self.read(t).join(lost, "chunk_id", "left_anti") for t in of_chunks}
        self.write(**out)

    def export(self, path: str, leave_out: tuple[str, ...] = ("credentials",)) -> None:
        """All tables but those left out, as plain Parquet folders with a schema version."""
        for table in sorted(set(self.tables()) - set(leave_out)):
            self.read(table).write.parquet(f"{path}/{table}")
        self.spark.createDataFrame([(SCHEMA_VERSION,)], "schema_version int").coalesce(1).write.parquet(f"{path}/{META}")

    def import_(self, path: str) -> list[str]:
        """Replace tables by those of an export; refuses one of another schema version."""
        version = self.spark.read.parquet(f"{path}/{META}").first()["schema_version"]
        if version != SCHEMA_VERSION:
            raise ValueError(f"schema version {version}, expected {SCHEMA_VERSION}")
        found = [t for t in _children(self.spark, path) if t != META]
        self.write(**{t: self.spark.read.parquet(f"{path}/{t}") for t in found})
        return sorted(found)

    def tables(self) -> list[str]:
        return sorted(t for t in _children(self.spark, self.path) if self._generation(t) is not None)


def _children(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def with_provenance(facts: DataFrame, mechanism: str, first_id: int = 1, **told) -> tuple[DataFrame, DataFrame]:
    """(facts with prov_id, provenance rows): a provenance row for each fact; the mechanism is required.

    Ids ascend from first_id. They are dealt by partition: each partition's size is counted first, so no task numbers all rows.
    told: columns or values of the provenance row, such as model, page, raw_text or confidence.
    """
    if not mechanism:
        raise ValueError("a mechanism is required")
    placed = scratch.cut_lineage(facts.withColumn("part_", F.spark_partition_id()).withColumn("in_", F.monotonically_increasing_id()), "provenance")
    sizes = placed.groupBy("part_").agg(F.count("*").alias("n"))
    offset = sizes.select("part_", (F.sum("n").over(Window.orderBy("part_")) - F.col("n")).alias("before"))  # a row for each partition
    nth = F.row_number().over(Window.partitionBy("part_").orderBy("in_"))
    numbered = placed.join(F.broadcast(offset), "part_").withColumn("prov_id", (F.col("before") + nth + (first_id - 1)).cast("long")).drop("part_", "in_", "before")
    columns = [F.col(v).alias(k) if isinstance(v, str) and v in facts.columns else (v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in told.items()]
    return numbered, numbered.select("prov_id", F.lit(mechanism).alias("mechanism"), *columns)


def numbered_ids(rows: DataFrame, used: DataFrame, order: str, width: int = 3) -> DataFrame:
    """rows with ``paper_id``: zero-padded numbers in the order of a column, from 1, leaving out those in used (paper_id).

    The k-th row gets the k-th free number: that is k plus the used numbers at or below it, found from the sorted gaps.
    """
    taken = used.select(F.col("paper_id").try_cast("long").alias("u")).where("u >= 1").distinct()
    gaps = taken.select("u", (F.col("u") - F.row_number().over(Window.orderBy("u"))).alias("free"))  # free numbers below each used one; people label these rows
    starts = gaps.groupBy("free").agg(F.max("u").alias("last")).select(F.col("free"), (F.col("last") - F.col("free")).alias("skip"))
    k = rows.withColumn("k", F.row_number().over(Window.orderBy(order)))
    # a row's skip is that of the last start before it: both in one order, with the largest skip so far
    both = k.select(F.struct(*[F.col(c) for c in rows.columns]).alias("row"), F.col("k").cast("long").alias("at"), F.lit(0).cast("long").alias("skip")).unionByName(
        starts.select(F.lit(None).alias("row"), (F.col("free") + 1).cast("long").alias("at"), F.col("skip").cast("long").alias("skip"))
    )
    skipped = both.withColumn("skip", F.max("skip").over(Window.orderBy("at"))).where("row is not null").select("row.*", F.col("at").alias("k"), "skip")
    number = (F.col("k") + F.col("skip")).cast("string")
    return skipped.select(*rows.columns, F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number).alias("paper_id"))
