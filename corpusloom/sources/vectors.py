"""Vector files: a JSON object a line, with base64 little-endian floats, or with plain arrays."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.scratch import scratch_path
from corpusloom.sources.tables import read_json_lines


def write_vectors(rows: DataFrame, path: str, model: str = "unknown") -> None:
    """rows (id, hash, embedding) as JSON lines, and a stamp beside them: model, type and dimension.

    Spark's committer makes the folder whole or not there; the stamp is written last.
    """

    def run(batches):
        for b in batches:
            lines = []
            for i, h, v in zip(*(b.column(k).to_pylist() for k in range(3))):
                lines.append(json.dumps({"id": i, "hash": h, "vector": base64.b64encode(np.asarray(v, "<f4").tobytes()).decode()}))
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})

    kept = rows.where("embedding is not null").select(F.col("id").cast("string").alias("id"), F.col("hash").cast("string").alias("hash"), "embedding")
    dim = kept.select(F.size("embedding").alias("n")).limit(1).collect()
    kept.mapInArrow(run, "value string").write.text(path)
    stamp = json.dumps({"model": model, "dtype": "float32", "dim": dim[0]["n"] if dim else 0})
    rows.sparkSession.createDataFrame([(stamp,)], "value string").coalesce(1).write.text(f"{path}.stamp")


def read_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(id, hash, embedding) of a vector file; lines that are malformed or of another dimension are left out.

    The dimension is the stamp's, or given.
    """
    if dim is None:
        dim = spark.read.text(f"{path}.stamp").select(F.get_json_object("value", "$.dim").cast("int").alias("dim")).first()["dim"]
    lines = read_json_lines(spark, path, "id string, hash string, vector string").where("id is not null and vector is not null")

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(2).to_pylist():
                try:
                    raw = base64.b64decode(v, validate=True)
                except ValueError:
                    raw = b""
                out.append(np.frombuffer(raw, "<f4") if len(raw) == 4 * dim else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float32()))], ["id", "hash", "embedding"])

    return lines.mapInArrow(run, "id string, hash string, embedding array<float>").where("embedding is not null")


def write_vector_arrays(rows: DataFrame, path: str) -> None:
    """rows (id, embedding, …) as JSON lines with plain arrays."""
    rows.write.json(path)


def read_vector_arrays(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """(id, embedding, …) of plain arrays; the dimension is the most frequent one, and rows of another are left out."""
    rows = read_json_lines(spark, path, "id string, embedding array<float>" + (", " + extra if extra else "")).where("id is not null and size(embedding) > 0")
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(usual), F.size("embedding") == F.col("n")).drop("n")  # one row


def round_trip(rows: DataFrame, model: str) -> DataFrame:
    """Rows as a vector file gives them back."""
    path = scratch_path(rows.sparkSession, "vectors")
    write_vectors(rows, path, model)
    return read_vectors(rows.sparkSession, path)


def stale(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows (kind, id, hash, …) whose content has no vector yet: no stored row has the same kind, id and hash."""
    return rows.join(stored.select("kind", "id", "hash").distinct(), ["kind", "id", "hash"], "left_anti").select(*rows.columns)
