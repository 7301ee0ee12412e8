"""Writing pages as WARC archives, and reading archives back by boundary-chain verification.

Archives are read in byte ranges, cut at every ``WARC/1.`` found, whether a record
starts there or the bytes stand in a payload. Each piece that parses as a header
gives a candidate: its own offset and, from its Content-Length, its successor's.
Only what the chain from the start of the file reaches is a record; pointer
jumping finds it in a logarithmic number of rounds on narrow rows, so magic
inside payloads is rejected without reading files in order. All of it runs in
DataFrame operations, over any file system that Spark reads.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import discard, materialize, shared_dir

MAGIC = "WARC/1."
CRLF = "\r\n"
#: Payloads that several pages have, up to this many (some 50 MB), are broadcast to the writers; beyond, pages are shuffled by digest.
BROADCAST_PAYLOADS = 500_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits are four characters."""
    digest = F.sha1(data)
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def warc_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(record): the text of a WARC record for each page, without the blank lines that end it."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    narrow = p.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = materialize(narrow.where("n > 1 and first_id is not null").drop("n"), "warc-payloads", "zstd")
    p = p.join(F.broadcast(first) if first.count() <= BROADCAST_PAYLOADS else first, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    line = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x], F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\\x00-\\x20\\x7f]+", "%20"), F.lit("WARC/"), F.lit("WARC%2F"))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.col("bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    head = F.concat(
        line(MAGIC + "1"),
        line("WARC-Type: ", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID: ", urn("page_id")),
        line("WARC-Date: 2024-01-01T00:00:00Z"),
        line("WARC-Target-URI: ", uri),
        F.when(again, F.concat(line("WARC-Refers-To: ", urn("first_id")), line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", length.cast("string")),
        F.lit(CRLF),
    )
    return p.select(F.concat(head, http, F.when(again, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """One archive for each partition; a record ends with two line breaks, which Spark's text writer puts after each row."""
    warc_records(pages, min_revisit_bytes).write.option("lineSep", CRLF + CRLF).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, piece) for the bytes between one magic and the next, in one scan; file is a hash of the path, row orders a byte range's pieces."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("piece")
    )


def _blank_line(data: str) -> Column:
    """Byte position of the first blank line of a binary column, 0 if none; the whole is searched only where its start has none."""
    at = lambda part: f"locate('\\r\\n\\r\\n', decode({part}, 'ISO-8859-1'))"
    start = at(f"substring({data}, 1, 65536)")
    return F.expr(f"CASE WHEN {start} > 0 THEN {start} WHEN octet_length({data}) > 65536 THEN {at(data)} WHEN {data} IS NOT NULL THEN 0 END")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, next, size, …) of every place where a record might start; header fields are null where none parses.

    ``whole`` tells that the record lies in its piece, and payload_bytes and
    payload_digest are those of its payload.
    """
    head_end = _blank_line("piece")
    head = F.expr("decode(substring(piece, 1, greatest(0, head_end + 1)), 'ISO-8859-1')")
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1), F.lit(""))
    p = _pieces(spark, path).withColumn("len", F.octet_length("piece")).withColumn("head_end", head_end).withColumn("head", head)
    p = p.withColumn("length", F.when(F.col("head").rlike(r"\A\d\r\n") & (F.col("head_end") > 0), F.try_to_number(field("Content-Length"), F.lit("999999999999999")).cast("long")))
    p = p.withColumn("block_at", F.when(F.col("length").isNotNull(), F.col("head_end") + 3))  # bytes of piece before the block
    p = p.withColumn("record_end", F.col("block_at") + F.col("length"))
    p = p.withColumn("whole", F.col("record_end") <= F.col("len"))
    block = F.expr("substring(piece, cast(block_at + 1 as int), cast(length as int))")
    p = p.withColumn("body", F.when(F.col("whole"), block))
    http = F.when(F.coalesce(field("Content-Type"), F.lit("")).startswith("application/http"), _blank_line("body")).otherwise(F.lit(0))
    p = p.withColumn("http", http).withColumn("payload", F.when(F.col("http") > 0, F.expr("substring(body, http + 4)")).otherwise(F.col("body")))
    narrow = p.select(
        "file", "block", "row", "len", "length", "block_at", "record_end", "whole",
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("refers"), field("WARC-Payload-Digest").alias("declared"),
        field("Content-Type").alias("kind"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    narrow = materialize(narrow, "warc-pieces", "zstd")
    step = F.col("len") + len(MAGIC)
    in_block = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = narrow.groupBy("file", "block").agg(F.sum(step).alias("total")).select("file", "block", F.coalesce(F.sum("total").over(of_file), F.lit(0)).alias("base"))
    placed = narrow.withColumn("inner", F.coalesce(F.sum(step).over(in_block), F.lit(0))).join(starts, ["file", "block"])
    off = F.col("base") + F.col("inner") - len(MAGIC)
    return placed.withColumn("off", off).withColumn("next", F.col("off") + len(MAGIC) + F.col("record_end") + 4).drop("base", "inner")


def reachable(links: DataFrame) -> DataFrame:
    """(file, off) of links (file, off, next) that the chain from each file's offset 0 reaches, by pointer jumping."""
    hop = materialize(links.select("file", "off", "next"), "warc-hop", "zstd")
    found = materialize(hop.where("off = 0").select("file", "off"), "warc-found", "zstd")
    count = found.count()
    while True:
        ahead = found.join(hop, ["file", "off"]).select("file", F.col("next").alias("off"))
        ahead = ahead.join(links.select("file", "off"), ["file", "off"], "left_semi")  # the end of a file is no record
        grown = materialize(found.union(ahead).distinct(), "warc-found", "zstd")
        now = grown.count()
        if now == count:
            return grown
        onward = hop.select("file", F.col("off").alias("next"), F.col("next").alias("beyond"))
        longer = materialize(hop.join(onward, ["file", "next"]).select("file", "off", F.col("beyond").alias("next")), "warc-hop", "zstd")
        discard(found)
        discard(hop)
        found, hop, count = grown, longer, now


@contextmanager
def same_splits(spark: SparkSession):
    """Files are cut alike by all scans inside, whatever executors come or go: Spark's cuts follow a number that defaults to the cores at hand."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, refers, declared, payload_bytes, payload_digest, file, off) of every record in the archives below path.

    Raises an error where a chain of records does not end at the end of its file.
    """
    with same_splits(spark):
        return _read_warc(spark, path)


def _read_warc(spark: SparkSession, path: str) -> DataFrame:
    at = materialize(candidates(spark, path), "warc-candidates", "zstd")
    links = at.where("length is not null and off >= 0").select("file", "off", "next")
    records = at.join(reachable(links), ["file", "off"], "left_semi")
    # the last record's two line breaks may be missing, nothing else
    ends = at.groupBy("file").agg(F.max(F.col("off") + len(MAGIC) + F.col("len")).alias("size")).where("size > 0")
    chains = records.groupBy("file").agg(F.max("next").alias("stop"))
    broken = ends.join(chains, "file", "left").where("stop is null or stop < size or stop > size + 4").count()
    if broken:
        raise ValueError(f"{broken} archives below {path}: the chain of records does not end at the end of the file")
    split = records.where("not whole")
    fields = ["type", "id", "refers", "declared", "payload_bytes", "payload_digest", "file", "off"]
    # records with magic inside: their pieces are read again and joined, in order
    spans = split.select("file", F.col("off").alias("start"), F.col("next").alias("stop"))
    if spans.isEmpty():
        return records.select(*fields)
    spans = materialize(spans, "warc-spans", "zstd")
    bucket = 1 << 20
    tiles = spans.select("*", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(stop - 1) div {bucket}"))).alias("tile"))
    inside = at.select("file", "block", "row", "off", F.expr(f"off div {bucket}").alias("tile")).alias("c").join(
        tiles.alias("s"), (F.col("c.file") == F.col("s.file")) & (F.col("c.tile") == F.col("s.tile")) & (F.col("c.off") >= F.col("s.start")) & (F.col("c.off") < F.col("s.stop"))
    ).select("c.file", "c.block", "c.row", "c.off", "s.start")
    pieces = _pieces(spark, path).join(inside, ["file", "block", "row"])
    listed = pieces.groupBy("file", F.col("start").alias("off")).agg(F.array_sort(F.collect_list(F.struct(F.col("off").alias("at"), F.decode("piece", "ISO-8859-1").alias("piece")))).alias("pieces"))  # one record's
    joined = listed.select("file", "off", F.encode(F.array_join(F.transform("pieces", lambda x: x["piece"]), MAGIC), "ISO-8859-1").alias("bytes"))
    full = split.drop("payload_bytes", "payload_digest").join(joined, ["file", "off"], "left")
    short = F.coalesce(F.octet_length("bytes") < F.col("record_end"), F.lit(True))
    full = full.withColumn("bytes", F.when(short, F.raise_error(F.lit("the archives changed between two scans")).cast("binary")).otherwise(F.col("bytes")))
    full = full.withColumn("body", F.expr("substring(bytes, cast(block_at + 1 as int), cast(length as int))"))
    full = full.withColumn("http", F.when(F.coalesce("kind", F.lit("")).startswith("application/http"), _blank_line("body")).otherwise(0))
    full = full.withColumn("payload", F.when(F.col("http") > 0, F.expr("substring(body, http + 4)")).otherwise(F.col("body")))
    full = full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    return materialize(records.where("whole").select(*fields).union(full.select(*fields)), "warc-read", "zstd")


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as archives and return what reading them gives, a row for each page.

    page_id, payload_bytes, payload_digest, record_type, refers_to; of a revisit
    the payload is that of the record it refers to, and the digest it declares.
    Null html is an empty payload; a null url is about:blank; characters that
    would break a header are escaped. Records that repeat the smallest page_id of
    their payload are all responses, as are those whose payload only pages without an
    id have. Empty tables give an empty result.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_revisit_bytes)
    got = read_warc(spark, path)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)")
    rows = got.select(number("id").alias("page_id"), "type", number("refers").alias("refers_to"), F.regexp_replace("declared", "^sha1:", "").alias("declared"), "payload_bytes", "payload_digest")
    revisits = rows.where("type = 'revisit'").select("page_id", "refers_to", F.col("declared").alias("payload_digest"))
    responses = rows.where("type = 'response'")
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    resolved = revisits.join(sizes, ["refers_to", "payload_digest"], "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(
        resolved.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to")
    )
