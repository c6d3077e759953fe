"""WARC archives by transaction assembly.

``write_archives`` makes a capture of each page: a response record (or a revisit, where
another capture has the same payload), a request record and a metadata record, the
latter two concurrent to the first. The records are column expressions; Spark's text
writer puts them into gzip files of the shared folder, ending each as the format asks.

``read_records`` parses the files by their Content-Length fields, one row for each
record. ``assemble`` joins response, request and metadata records through their
concurrent-to identifiers into one nested row for each capture.

Of the captures with equal payloads of at least ``least`` bytes, that with the largest
page id is the response and the others revisit it; rows that share this id are all
responses, a null id is never the largest, and if all are null all are responses. Every row
is a capture of its own and comes back as one: its record id is a hash of page id, URL and
payload, and where rows repeat all three also of a number of the row. A null page is empty,
a null URL too. An empty table gives no rows. Other columns of the pages, whatever their
names, are not taken. Payloads are moved once, by page id and digest, so that one that very
many pages share is spread; files hold few large pages or many small ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.llm.batches import map_batches, quoted
from flowloom.session import keep, remove_folder, shared_folder

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Bytes of payload, and how many captures up to that size go to one file (None: any larger).
PER_FILE = ((64 << 10, 2_000), (4 << 20, 32), (None, 1))
#: Bytes of payload that a parsing task hands on at once.
AT_ONCE = 8 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = (
    "record_id string, kind string, concurrent_to string, refers_to string, uri string, date string, "
    "payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: five hex digits make four letters."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _uuid(of: Column) -> Column:
    h = F.md5(of.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(h, a + 1, b - a), F.lit("-" if b < 32 else ">")) for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))])


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends that close it."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit("")))
    lines.append(F.concat(F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2)))
    return F.concat(*lines, block)


def plan_captures(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, first, copies): first is the response of equal payloads
    (its page_id, url and how many rows repeat it), copies how many rows repeat this one.

    The largest id of each payload is a pre-aggregated grouping over rows without payloads.
    """
    payload = F.coalesce(F.col(quoted(html)), F.lit("")).alias("payload")
    rows = pages.select(F.col(quoted(key)).alias("page_id"), F.coalesce(F.col(quoted(url)), F.lit("")).alias("url"), payload)
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    same = rows.groupBy("page_id", "url", "digest").agg(F.count("*").alias("copies"), F.max(F.octet_length("payload") >= least).alias("counts"))
    first = same.where("counts").groupBy("digest").agg(F.max(F.struct("page_id", "url", "copies")).alias("first"))
    plan = same.join(first, "digest", "left").select(*[F.col(c).alias(f"of_{c}") for c in ("page_id", "url", "digest")], "first", "copies")
    own = [F.col(c).eqNullSafe(F.col(f"of_{c}")) if c == "page_id" else F.col(c) == F.col(f"of_{c}") for c in ("page_id", "digest", "url")]
    return rows.join(plan, own).select(*rows.columns, "first", "copies")


def _size(size: Column) -> Column:
    """Which of PER_FILE a payload of that many bytes belongs to."""
    out = F.lit(len(PER_FILE) - 1)
    for i in reversed(range(len(PER_FILE) - 1)):
        out = F.when(size <= PER_FILE[i][0], i).otherwise(out)
    return out


def write_archives(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the captures of ``pages`` to gzip files in ``folder``: those of each size of payload
    apart, as equal payloads are of one size."""
    of_size = _size(F.coalesce(F.octet_length(F.col(quoted(html))), F.lit(0)))
    sizes = sorted(r[0] for r in pages.select(of_size).distinct().collect())
    for i in sizes or [0]:
        some = pages if len(sizes) < 2 else pages.where(of_size == i)
        records = _records(plan_captures(some, least, key, url, html))
        records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * PER_FILE[i][1]).text(f"{folder}/size={i}")


def _records(rows: DataFrame) -> DataFrame:
    """The three records of each planned capture, as text."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    name = lambda page, uri, more: _uuid(F.concat_ws("|", F.lit("capture"), text(page), "digest", F.col(uri), more))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    number = F.when(F.col("copies") > 1, F.monotonically_increasing_id().cast("string")).otherwise("")
    again = F.coalesce(F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.lit(False))
    # a response that rows repeat has no one id: its revisits go by the digest
    of = F.when(F.col("first.copies") == 1, name("first.page_id", "first.url", F.lit("")))
    rows = rows.withColumns({"number": number, "again": again, "uri": uri}).withColumns({"id": name("page_id", "url", F.col("number")), "of": of})
    part = lambda what: _uuid(F.concat(F.lit(what), F.col("id")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    common = [("WARC-Record-ID", F.col("id")), ("WARC-Target-URI", F.col("uri")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", common, F.concat(head, "payload"))
    revisit = _record("revisit", [*common, ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", F.col("of"))], head)
    beside = lambda what, kind: [("WARC-Record-ID", part(what)), ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit(kind))]
    request = _record("request", beside("request", "application/http; msgtype=request"), F.concat(F.lit("GET "), "uri", F.lit(f" HTTP/1.1{CRLF * 2}")))
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = _record("metadata", beside("metadata", "application/warc-fields"), fields)
    return rows.select(F.explode(F.array(F.when(F.col("again"), revisit).otherwise(response), request, metadata)).alias("value"))


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an open archive."""
    while True:
        line = archive.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := archive.readline().strip()) != b"":
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = archive.read(size)
        if len(block) < size:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = fields.get("warc-type")
    own = {}
    digest, size, payload = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    elif kind == "metadata":
        own = {n.strip(): v.strip() for n, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)}
    elif kind == "request":
        own = {"line": block.partition(b"\r\n")[0].decode("utf-8", "replace")}
    return (fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), digest, size, payload if payloads else None, list(own.items()))


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in ``folder``; the digest and size of a
    response are of the payload as it was read."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (files,) in batches:
            for content in files:
                rows: list[tuple] = []
                held = 0
                with gzip.open(io.BytesIO(content.as_py()), "rb") as archive:
                    for fields, block in parse(archive):
                        rows.append(_row(fields, block, payloads))
                        held += len(block) if payloads else 500
                        if held > AT_ONCE:
                            yield [list(c) for c in zip(*rows, strict=True)]
                            rows, held = [], 0
                if rows:
                    yield [list(c) for c in zip(*rows, strict=True)]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(folder)
    return map_batches(files, ["content"], RECORD, run)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: record_id, response (or revisit), request, metadata.

    A request or metadata record that is missing is null; a record that repeats counts once.
    """
    one = records.where(F.col("kind").isin("response", "revisit")).dropDuplicates(["record_id"])
    main = one.select("record_id", F.struct("kind", "uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"))
    side = lambda kind: records.where(F.col("kind") == kind).dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), "uri", "date", "fields").alias(kind))
    return main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def capture_digests(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back and tell of each capture's payload:
    page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder, least)
    records = keep(read_records(spark, folder, payloads=False).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "records")
    remove_folder(spark, folder)
    return captured(assemble(records), dict(pages.dtypes)["page_id"])


def captured(captures: DataFrame, kind: str = "long") -> DataFrame:
    """Each assembled capture's page_id, payload_bytes, payload_digest, record_type, refers_to and uri.

    A revisit is resolved as in any archive: by the record that it refers to, or if it names none
    by its payload's digest; that response tells the payload's size and the page. Only a row's own
    page_id comes from its metadata record; it is null in archives that have none.
    """
    own = F.try_element_at("metadata.fields", F.lit("page-id")).cast(kind).alias("page_id")
    rows = captures.select("record_id", own, *[F.col(f"response.{c}").alias(c) for c in ("kind", "uri", "refers_to", "payload_digest", "payload_bytes")])
    rows = keep(rows, "captures")  # without payloads; both sides of the join come from it
    first = rows.where("kind = 'response'")
    known = first.select(F.col("record_id").alias("of"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"))
    if rows.where("kind = 'revisit' and refers_to is null").limit(1).count():
        by_digest = first.groupBy("payload_digest").agg(F.max(F.struct("page_id", "payload_bytes")).alias("r"))
        known = known.unionByName(by_digest.select(F.concat(F.lit("sha1:"), "payload_digest").alias("of"), F.col("r.page_id").alias("of_page"), F.col("r.payload_bytes").alias("of_bytes")))
    again = rows.where("kind = 'revisit'").withColumn("of", F.coalesce("refers_to", F.concat(F.lit("sha1:"), "payload_digest"))).join(known, "of", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type")]
    one = first.select(*columns, F.lit(None).cast(kind).alias("refers_to"), "uri")
    return one.unionByName(again.withColumn("payload_bytes", F.col("of_bytes")).select(*columns, F.col("of_page").alias("refers_to"), "uri"))


#: The same rows from the pages alone.
ORACLE = """
with p as (
  select page_id, url, coalesce(html, '') as payload, upper(sha1(coalesce(html, ''))) as h from pages),
d as (
  select page_id, strlen(payload) as payload_bytes, max(page_id) over (partition by h) as first,
         regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g') as uri,
         translate(
           to_base(('0x' || h[1:5])::bigint, 32, 4) || to_base(('0x' || h[6:10])::bigint, 32, 4) ||
           to_base(('0x' || h[11:15])::bigint, 32, 4) || to_base(('0x' || h[16:20])::bigint, 32, 4) ||
           to_base(('0x' || h[21:25])::bigint, 32, 4) || to_base(('0x' || h[26:30])::bigint, 32, 4) ||
           to_base(('0x' || h[31:35])::bigint, 32, 4) || to_base(('0x' || h[36:40])::bigint, 32, 4),
           '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest
  from p)
select page_id, payload_bytes, payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first then first end as refers_to, coalesce(uri, '') as uri
from d
"""
