"""CSV tables and JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the header; quoted fields may hold line breaks and doubled quotes.

    Carriage returns go, missing cells are empty, rows without any content are left out.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", nullValue="\0", emptyValue="")
    clean = rows.select(*[F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), "\r", "").alias(c.strip("\r")) for c in rows.columns])
    return clean.where(F.concat(*[F.col(f"`{c}`") for c in clean.columns]) != "") if clean.columns else clean


def csv_field(value: Column) -> Column:
    """A field as it stands in a file: quoted only if it holds a quote, a comma or a line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV files, each with the header."""
    header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n\r') else c for c in rows.columns)
    lines = rows.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in rows.columns]).alias("value"))

    def headed(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            values = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [header, *values] if first else values})
            first = False

    lines.mapInArrow(headed, "value string").write.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a log, a line each; lines that are no JSON object of the schema's types are left out."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", f"{schema}, bad_line string", {"columnNameOfCorruptRecord": "bad_line"}).alias("r"), "value")
    return parsed.where(F.trim("value").startswith("{") & F.col("r").isNotNull() & F.col("r.bad_line").isNull()).select("r.*").drop("bad_line")


def search_totals(log: DataFrame) -> DataFrame:
    """(n_searches, n_found): lines of a search log and the sum of their result_count, a missing one counted as 0."""
    return log.agg(F.count("*").alias("n_searches"), F.coalesce(F.sum(F.coalesce("result_count", F.lit(0))), F.lit(0)).cast("long").alias("n_found"))


def tail(log: DataFrame, at: str, n: int = 100, most: int = 1000) -> DataFrame:
    """The last n records by ``at``, newest first; n stops at ``most``."""
    return log.orderBy(F.desc(at)).limit(max(1, min(n, most)))
