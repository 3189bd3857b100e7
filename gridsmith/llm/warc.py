"""WARC archives written from pages and read back, with record boundaries verified as a chain.

The reader cuts files at every place that looks like a record start. Each such candidate names its
successor by its header and length. Only candidates reachable from the start of their file are
records; what looks like a start inside a payload is not reached and belongs to that payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.llm.base import query, table
from gridsmith.operators.ordering import carried
from gridsmith.session import fresh_path, staged

END = "\r\n\r\n"
MAGIC = "WARC/1."
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 20_000


def base32_sha1(body: Column) -> Column:
    """Bare upper-case base32: 40 bits are ten hex digits and eight base32 digits."""
    hex_digits = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(hex_digits, i * 10 + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               body_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per row. Of equal payloads of at least ``min_bytes`` the row with the largest id
    is the response, the others are revisits without payload that refer to it.

    A NULL payload is empty; a NULL id is the smallest; rows that repeat the largest id are all
    responses; line breaks in a URL are percent-encoded. Groups of equal payloads come from
    a map-side combined aggregate, and only those of several rows are joined, so neither unique
    nor very frequent payloads are gathered anywhere.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body")).select(
        "*", F.octet_length("body").cast("long").alias("n"), base32_sha1(F.col("body")).alias("digest"),
        F.xxhash64("body").alias("xx"))
    key = ["digest", "n", "xx"]
    groups = staged(rows.where(F.col("n") >= min_bytes).groupBy(*key).agg(
        F.max("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "payloads")
    rows = rows.join(groups, key, "left")
    revisit = F.col("first").isNotNull() & F.coalesce(F.col("id") < F.col("first"), F.lit(True))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.coalesce(F.col("url"), F.lit(""))
    for char, code in (("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    record = F.concat(
        F.lit(MAGIC + "1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Refers-To: "), urn(F.col("first")),
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END), block)
    (rows.select(record.alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def raw_chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between places that look like record starts, in file order within each split."""
    return (spark.read.option("lineSep", END + MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.col("value").cast("binary").alias("chunk")))


def with_offsets(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` with offsets within their split to offsets in the file.

    ``chunks`` must be read in the same plan: the lengths of all splits are prefix-summed per file,
    one short row per split.
    """
    step = len(END) + len(MAGIC)
    splits = chunks.groupBy("file", "split").agg(F.sum(F.octet_length("chunk") + F.lit(step)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["file", "split"]).withColumn("at", F.col("at") + F.col("start")).drop("start")


HEADERS = pa.map_(pa.string(), pa.string())
CANDIDATE = pa.schema([
    ("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("head", pa.int64()), ("length", pa.int64()),
    ("headers", HEADERS), ("http", pa.int64()), ("digest", pa.string()), ("chunk", pa.binary())])
CANDIDATE_DDL = ("file string, split long, at long, head long, length long, headers map<string,string>, "
                 "http long, digest string, chunk binary")


def header_fields(raw: bytes) -> dict[str, str]:
    fields = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return fields


def payload_facts(block: bytes, fields: dict[str, str]) -> tuple[int, str]:
    """Length of the HTTP header in a block and the payload's digest; the HTTP length joins the fields."""
    end = block.find(b"\r\n\r\n")
    http = end + 4 if block.startswith(b"HTTP/") and end >= 0 else 0
    if http:
        fields["http-content-length"] = header_fields(block[:end]).get("content-length", "")
    return http, base64.b32encode(hashlib.sha1(block[http:]).digest()).decode()


def parse_chunks(keep_chunk: bool):
    """Arrow batches of chunks to candidates; ``at`` counts from the first chunk of the split."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, magic = len(END) + len(MAGIC), MAGIC.encode()
        place, where = None, 0
        for batch in batches:
            rows = []
            for file, split, chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if place != (file, split):
                    place, where = (file, split), 0
                at, where = where, where + len(chunk) + step
                # The reader has cut off the magic, but for the one at the start of the file.
                text = chunk if split == 0 and at == 0 else magic + chunk
                end = text.find(b"\r\n\r\n")
                fields = header_fields(text[:end]) if end >= 0 and text.startswith(magic) else {}
                size = fields.get("content-length", "")
                length = int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None
                head = http = digest = None
                if length is not None:
                    head = end + 4
                    if head + length <= len(text):
                        http, digest = payload_facts(text[head:head + length], fields)
                rows.append((file, split, at, head, length, list(fields.items()), http, digest, chunk if keep_chunk else None))
            columns = list(zip(*rows, strict=True)) or [()] * len(CANDIDATE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, CANDIDATE, strict=True)], schema=CANDIDATE)
    return parse


def candidates(spark: SparkSession, path: str, keep_chunk: bool) -> DataFrame:
    """Every place that looks like a record start, with its offset in the file."""
    chunks = raw_chunks(spark, path)
    parsed = with_offsets(chunks.mapInArrow(parse_chunks(keep_chunk), CANDIDATE_DDL), raw_chunks(spark, path))
    return parsed.withColumn("at", F.when(F.col("at") == 0, 0).otherwise(F.col("at") - len(MAGIC)))


def reachable(found: DataFrame) -> DataFrame:
    """``file, at`` of the candidates that the chain from the start of the file reaches.

    Pointer jumping: each round every reached candidate reaches the one its pointer names, and all
    pointers double. A chain of n records takes log2(n) rounds, each over short rows.
    """
    state = staged(found.where("length is not null").select(
        "file", "at", (F.col("at") + F.col("head") + F.col("length") + len(END)).alias("to"),
        (F.col("at") == 0).alias("hit")), "chain")
    reached = state.where("hit").count()
    while True:
        ahead = state.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        hits = state.where("hit").select("file", F.col("to").alias("at"), F.lit(True).alias("new"))
        state = staged(
            state.join(ahead, ["file", "to"], "left").join(hits, ["file", "at"], "left")
            .select("file", "at", F.col("far").alias("to"), (F.col("hit") | F.col("new").isNotNull()).alias("hit")), "chain")
        now = state.where("hit").count()
        if now == reached:
            return state.where("hit").select("file", "at")
        reached = now


RECORD = ["file", "at", "length", "headers", "http", "digest", "complete"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per true record, staged: place, headers, block length, length of the HTTP header and
    the payload's digest. ``complete`` is false for a record that its file cuts off.

    A payload that holds what looks like a record start lies in several chunks. Only those are put
    together, from the chunks that fall into the record.
    """
    found = staged(candidates(spark, path, False).drop("chunk"), "candidates")
    hits = reachable(found)
    records = staged(found.join(hits, ["file", "at"]), "records")
    whole = records.where("digest is not null").withColumn("complete", F.lit(True)).select(RECORD)
    cut = records.where("digest is null").select("file", F.col("at").alias("owner"), "head", "length", "headers")
    if cut.isEmpty():
        return whole
    marked = found.select("file", "split", "at").join(hits.withColumn("start", F.col("at")), ["file", "at"], "left")
    owned = carried(marked, {"earlier": F.col("start")}, ["file"], ["split"], ["at"])
    pieces = staged(owned.select("file", "at", F.coalesce("start", "earlier").alias("owner"))
                    .join(cut.select("file", "owner"), ["file", "owner"]), "pieces")
    texts = (candidates(spark, path, True).select("file", "at", "chunk").join(pieces, ["file", "at"])
             .groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("parts")))
    rows = texts.join(cut, ["file", "owner"]).select("file", "owner", "head", "length", "headers", "parts.chunk")
    return staged(whole.unionByName(rows.mapInArrow(joined_records, RECORD_DDL)), "records")


RECORD_DDL = ("file string, at long, length long, headers map<string,string>, http long, digest string, "
              "complete boolean")


def joined_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records put together again from their chunks, the bytes that the reader took as a cut included."""
    between = (END + MAGIC).encode()
    for batch in batches:
        out = []
        for file, at, head, length, headers, chunks in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            text = between.join(chunks)
            text = text if at == 0 else MAGIC.encode() + text
            block, fields = text[head:head + length], dict(headers)
            http, digest = payload_facts(block, fields)
            out.append((file, at, length, list(fields.items()), http, digest, len(block) == length))
        types = [pa.string(), pa.int64(), pa.int64(), HEADERS, pa.int64(), pa.string(), pa.bool_()]
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """Per record of ``write_warc``: the page, its full payload's size and digest, type and reference.

    What a response holds is measured; a revisit holds no payload and states its facts in headers.
    """
    header = lambda name: F.element_at("headers", name)
    page = lambda name: F.nullif(F.regexp_extract(header(name), "^<urn:page:(.*)>$", 1), F.lit("null")).try_cast("long")
    revisit = header("warc-type") == "revisit"
    return records.select(
        page("warc-record-id").alias("page_id"),
        F.when(revisit, header("http-content-length").try_cast("long")).otherwise(F.col("length") - F.col("http"))
        .alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(header("warc-payload-digest"), "^sha1:", "")).otherwise(F.col("digest"))
        .alias("payload_digest"),
        header("warc-type").alias("record_type"),
        F.when(revisit, page("warc-refers-to")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body)::BIGINT AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


@query("op9_warc", SQL)
def op9_warc(spark, sf_dir):
    """All pages written as WARC records and read back."""
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(read_records(spark, path))
