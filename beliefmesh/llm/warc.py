"""WARC archives: write captures, read them back, and assemble one nested row per transaction.

Writing. Every page becomes a request, a response or revisit, and a metadata record; request and metadata name the
response in WARC-Concurrent-To. Payloads of at least `least` bytes that occur more than once are stored once, with the
smallest page id; the others are revisit records that name its record in WARC-Refers-To. Records are built by Spark
expressions and written by Spark's own writer (gzip), whose line separator, CR LF CR LF, is a record's end: archives can
lie in any store Spark reaches, and a lost task writes its file anew.

Reading. Spark's text reader, cut at CR LF CR LF, streams a file's pieces in order to a parser that rebuilds the byte
stream and cuts records by Content-Length, so that payloads may hold any bytes and a task holds one record at a time.
gzip files aren't split, so each file is parsed from its start. `round_trip` parses the archives once: the records go to
a table, which the branches of the assembly read.

Assembly. Responses and revisits are joined with their request and metadata through the concurrent-to identifiers
(also where the response names them), and revisits with the response they refer to.

Defined cases: null html is an empty payload; a null url leaves the target out; null page ids are written, never
referred to before others with an id, and come back null; rows with the same page_id and payload share a record id and
come back as often as written; a very long payload is one record; of several requests or metadata records of a capture
the smallest (by id, then fields) is taken; an empty table gives an empty result; other columns, also ones such as
`digest`, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefmesh.llm.common import lean, materialise, pick, scratch

LEAST = 100
BREAK = "\r\n\r\n"
RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, page_id long, uri string, digest string, payload_bytes long, payload_digest string, payload binary, fields map<string,string>"


def record_id(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(kind: Column, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its final CR LF CR LF. Headers with a null value are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(BREAK), block)


def deduplicated(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, digest, first: the smallest page id with the payload, null where it is stored by itself."""
    base = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    # equal payloads meet as digests only; those that occur once are left out before the join. As a table its size is known
    # before the join, so that payloads are dealt by digest, to as many archives as partitions, only where it is large
    firsts = base.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts = materialise(firsts.select(F.col("digest").alias("d"), "first"))
    return base.join(firsts, F.col("digest") == F.col("d"), "left").drop("d")


def records_of(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """value: the text of every record, three a page."""
    p = deduplicated(pages, least)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page, digest = F.col("page_id"), F.col("digest")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    target = [("WARC-Target-URI", uri), ("WARC-X-Page-ID", page.cast("string"))]
    rid = record_id("response", page, digest)
    rest = F.regexp_replace(F.regexp_replace(uri, r"^.*?://[^/?#]*", ""), r"#.*$", "")
    path = F.when(F.coalesce(F.length(rest), F.lit(0)) == 0, F.lit("/")).otherwise(rest)
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^.*?://([^/?#]*)", 1)
    request = record(F.lit("request"), record_id("request", page, digest), [*target, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BREAK)))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(BREAK))
    response = record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")), rid,
        [*target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), ("WARC-Refers-To", F.when(again, record_id("response", F.col("first"), digest))),
         ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(head, F.when(again, F.lit("")).otherwise(F.col("html"))),
    )
    metadata = record(F.lit("metadata"), record_id("metadata", page, digest), [*target, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("fetchTimeMs: 0\r\npayloadBytes: "), F.col("size").cast("string"), F.lit("\r\n")))
    return p.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    records_of(pages, least).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


HEAD_END = BREAK.encode()


def parse(head: bytes, block: bytes, keep: bool) -> tuple:
    fields: dict[str, str] = {}
    linked: list[str] = []
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        k, v = k.strip().lower(), v.strip()
        fields[k] = v
        if k == "warc-concurrent-to":
            linked.append(v)
    kind = fields.get("warc-type", "")
    payload = block
    if "application/http" in fields.get("content-type", ""):
        payload = block.partition(HEAD_END)[2]
    page = fields.get("warc-x-page-id")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
    own = hashlib.sha256(payload).hexdigest() if kind == "response" else None
    page_id = int(page) if page and re.fullmatch(r"-?\d+", page) else None
    return (kind, fields.get("warc-record-id"), linked, fields.get("warc-refers-to"), page_id, fields.get("warc-target-uri"), digest, len(payload), own, payload if keep else None, fields)


def parse_stream(pieces: Iterator[bytes], keep: bool) -> Iterator[tuple]:
    """Records of the byte stream that the pieces, each followed by CR LF CR LF, make up."""
    held: list[bytes] = []
    size = need = 0
    for piece in pieces:
        held += [piece, HEAD_END]
        size += len(piece) + 4
        if size < need:
            continue
        data, at = b"".join(held), 0
        while True:
            while data.startswith(b"\r\n", at):
                at += 2
            end = data.find(HEAD_END, at)
            if end < 0:
                need = 0
                break
            found = re.search(rb"(?im)^content-length:\s*(\d+)", data[at:end])
            stop = end + 4 + (int(found[1]) if found else 0)
            if len(data) < stop + 4:
                need = stop + 4 - at
                break
            yield parse(data[at:end], data[end + 4 : stop], keep)
            at = stop + 4
        held, size = ([data[at:]], len(data) - at) if at < len(data) else ([], 0)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under path (gzip)."""
    names = [x.split(" ")[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for r in parse_stream((bytes(x) for b in batches for x in b["value"]), payloads):
            rows.append(r)
            size += r[7]
            if len(rows) >= 2000 or size > 1 << 24:
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.assign(page_id=out["page_id"].astype("Int64"))

    lines = spark.read.option("lineSep", BREAK).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInPandas(lean(run), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: page_id, uri, response, request, metadata (structs), payload_bytes, payload_digest,
    record_type, refers_to. A capture is a response or revisit record."""
    main = records.where("type in ('response', 'revisit')")
    side = records.where("type in ('request', 'metadata')").select("type", "record_id", "concurrent_to", "fields")
    # a side record belongs to the response it names, or to the one that names it
    named = side.select(F.explode("concurrent_to").alias("of"), "type", F.struct("record_id", "fields").alias("x"))
    back = main.select(F.col("record_id").alias("of"), F.explode("concurrent_to").alias("record_id")).join(side, "record_id").select("of", "type", F.struct("record_id", "fields").alias("x"))
    parts = named.union(back).groupBy("of").agg(F.min(F.when(F.col("type") == "request", F.struct("x.record_id", F.map_entries("x.fields").alias("fields")))).alias("request"), F.min(F.when(F.col("type") == "metadata", F.struct("x.record_id", F.map_entries("x.fields").alias("fields")))).alias("metadata"))
    stored = main.where("type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("to_page"), F.max("payload_bytes").alias("to_bytes"), F.max("payload_digest").alias("to_digest")).withColumnRenamed("record_id", "to_id")
    # only revisits look for the response they refer to
    first = main.where("type = 'response'").select("*", F.lit(None).cast("long").alias("to_page"), F.lit(None).cast("long").alias("to_bytes"), F.lit(None).cast("string").alias("to_digest"))
    later = main.where("type = 'revisit'").join(stored, F.col("refers_to") == F.col("to_id"), "left").drop("to_id")
    rows = first.unionByName(later).join(parts, F.col("record_id") == F.col("of"), "left")
    again = F.col("type") == "revisit"
    return rows.select(
        "page_id", "uri", F.struct("record_id", "fields", "payload").alias("response"), "request", "metadata",
        F.when(again, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.coalesce("to_digest", "digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(again, F.col("to_page")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least: int = LEAST, payloads: bool = False) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, least)
    return assemble(materialise(read(spark, path, payloads)))


def header(part: str, name: str) -> Column:
    """A header of the nested request or metadata record of an assembled row."""
    return F.expr(f"get(filter({part}.fields, f -> f.key = '{name}'), 0).value")
