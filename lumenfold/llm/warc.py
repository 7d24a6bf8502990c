"""Content-addressed web archive: payload bytes once per verified strong digest, exact record headers apart, records by join.

`write_archive` writes headers and payloads as tables of their own; `read_records` joins them to the original WARC record bytes;
`parse_records` reads those bytes as a WARC reader does. A payload's address is its SHA-256, which is worked out again from the stored
bytes on every read, as the SHA-1 that the record names is; a difference stops the read with an error.

Payloads from `revisit_from` bytes on have one response each. They and those responses are clustered by address into as many buckets as there are
shuffle partitions, so a payload's bytes are shuffled once, when they are stored, and never when they are read. Smaller payloads
may have many responses; they meet those in an ordinary join, whose skewed keys are split at run time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import scratch_dir, table, written

#: Line ends of the WARC format.
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Control characters of a value are percent-encoded."""
    clean = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _clustered(df: DataFrame, path: str, buckets: int) -> None:
    """Writes df below path in buckets of its address. The table's entry in the catalog is dropped again; the files stay."""
    name = f"archive_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "address").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def _read_clustered(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    name = f"archive_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (address) INTO {buckets} BUCKETS LOCATION '{path}'")
    df = spark.table(name)
    df.schema  # resolved: the plan holds the files from here on
    spark.sql(f"DROP TABLE {name}")
    return df


def write_archive(pages: DataFrame, path: str, revisit_from: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per row of pages(page_id, url, html) below path.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least revisit_from bytes, that with the
    largest page_id (nulls smallest, then the last row) is the response, the others are revisits of it; smaller payloads are
    all responses. Either way a payload's bytes are stored once. A null url writes no target line. Other columns don't matter; an empty table
    gives an archive without records. Responses are chosen on slim rows, whose numbers are fixed by writing them first.
    """
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload"))
    slim = full.select("page_id", "url", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    rows = written(slim.withColumn("no", F.monotonically_increasing_id()), "rows")
    first = rows.groupBy("address").agg(F.max(F.struct("page_id", "no")).alias("first"))
    large = F.col("n") >= revisit_from
    chosen = F.col("no") == F.col("first.no")
    name = lambda page, no: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), no.cast("string"), F.lit(">"))
    revisit = large & ~chosen
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("page_id"), F.col("no"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("n").cast("string")),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("first.page_id"), F.col("first.no")))),
        _line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )
    kind = F.when(revisit, "revisit").when(large, "large").otherwise("small")
    headers = written(rows.join(first, "address").select("no", "address", kind.alias("kind"), F.encode(header, "UTF-8").alias("header")), "headers")
    headers.where("kind <> 'large'").write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/headers")
    _clustered(headers.where("kind = 'large'").select("no", "address", "header"), f"{path}/headers-large", buckets)
    # a payload of each address; each task keeps one of a page's copies before they are shuffled
    size = F.octet_length("payload")
    stored = full.where(size >= revisit_from).select(F.sha2("payload", 256).alias("address"), "payload").groupBy("address").agg(F.first("payload").alias("payload"))
    _clustered(stored, f"{path}/payloads-large", buckets)
    small = full.where(size < revisit_from).select(F.sha2("payload", 256).alias("address"), "payload").distinct()
    small.write.option("compression", "zstd").parquet(f"{path}/payloads-small")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(no, record): the original bytes of every record: its header, its payload (none for a revisit), two line ends.

    A header whose payload is missing, or has another SHA-256 than its address, stops the read with an error.
    """
    buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]
    headers = spark.read.schema("no long, address string, header binary, kind string").parquet(f"{path}/headers")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    lost = F.raise_error(F.concat(F.lit("no sound payload of record "), F.col("no").cast("string"))).cast("binary")
    record = F.concat("header", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(lost), end).alias("record")
    large = _read_clustered(spark, f"{path}/headers-large", "no bigint, address string, header binary", buckets)
    whole = large.join(_read_clustered(spark, f"{path}/payloads-large", "address string, payload binary", buckets), "address", "left").select("no", record)
    small = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads-small")
    short = headers.where("kind = 'small'").join(small, "address", "left").select("no", record)
    return whole.unionByName(short).unionByName(headers.where("kind = 'revisit'").select("no", F.concat("header", end).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """Reads record bytes: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit).

    Header lines end with CR LF and nothing else, whatever signs a url has. The payload's SHA-1 and length are checked against the header; a difference stops the read with an error.
    """
    head = F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)  # the same bytes, up to the first empty line
    line = lambda name: F.get(F.filter("lines", lambda x: x.startswith(f"{name}: ")), F.lit(0))
    field = lambda name: F.substring(line(name), len(name) + 3, (1 << 31) - 1)
    page = lambda name: F.expr(f"try_cast(regexp_extract({name}, 'urn:x-page:([^:]*):', 1) as bigint)")
    read = (
        records.select("record", head.alias("head"))
        .select("record", F.octet_length("head").alias("start"), F.split("head", CRLF).alias("lines"))
        .select("record", "start", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("to"), field("WARC-Payload-Digest").alias("digest"), field("Content-Length").cast("int").alias("n"), field("WARC-Payload-Length").cast("long").alias("whole"), field("WARC-Target-URI").alias("url"))
        .withColumn("payload", F.when(F.col("record_type") == "response", F.substring("record", F.col("start") + 5, F.col("n"))))
    )
    found = F.concat(F.lit("sha1:"), F.sha1("payload"))
    sound = (F.col("record_type") == "revisit") | ((found == F.col("digest")) & (F.octet_length("payload") == F.col("whole")))
    checked = F.when(sound, F.col("whole")).otherwise(F.raise_error(F.concat(F.lit("damaged payload in record "), F.col("id"))).cast("long"))
    return read.select(page("id").alias("page_id"), "url", checked.alias("payload_bytes"), F.substring_index("digest", ":", -1).alias("payload_digest"), "record_type", page("to").alias("refers_to"), "payload")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive in the shared folder and read back."""
    path = f"{scratch_dir(spark)}/lumenfold-{uuid.uuid4().hex}/archive"
    write_archive(table(spark, sf_dir, "pages"), path)
    return parse_records(read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n < 1000 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 1000 OR place = 1 THEN NULL ELSE last END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last,
             row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place
      FROM pages)
"""
