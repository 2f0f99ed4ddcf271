"""WARC archives: written by Spark's text writer, read back with segment reassembly.

Writing is JVM work: a record is a row, and the blank lines that end a WARC
record are the writer's line separator, so files are committed whole by Spark's
protocol in any store. Large payloads are cut into continuation records.
Reading parses whole files of bounded size by Content-Length, groups
continuation records by origin identifier (within a file first), orders them by segment number,
verifies the total length and decodes chunked transfer framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.sources.scratch import drop, materialise, scratch_path

#: Bytes of a record's block before it is continued, and of a file (about).
SEGMENT_BYTES, FILE_BYTES = 32_768, 8 << 20
CHUNK_BYTES = 8192
_CRLF = "\r\n"


def _record_id(name: Column) -> Column:
    digest = F.md5(name)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _base32(hex_sha1: Column) -> Column:
    """Base32 of a SHA-1 in hex: each five hex digits are four base32 digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_sha1, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)])
    return F.translate(F.upper(bits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", alphabet)


def _clean(text: Column) -> Column:
    """A header value: no line breaks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write a response or revisit record per row to gzipped WARC files in the folder ``out``.

    Of rows with equal payloads of at least ``least_revisit`` bytes that with the
    largest id is the response; the others revisit it. A null payload is empty.
    A row with a null id is always a response. Rows repeated under one id with
    one payload are responses each if theirs is the largest id. An empty table
    gives a folder without records; other columns are not read.

    Equal payloads are found on digests alone. Those that occur more than once
    are then joined to the rows: broadcast where Spark knows them to be small,
    else each payload is shuffled once. The rows of a task go to files of about
    ``file_bytes`` without a further shuffle. A payload may have up to 1 GB: its
    hex digits pass through one string.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    sha = F.unhex(F.sha1(F.coalesce(F.col(body_col), F.lit(""))))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"), sha.alias("sha"), F.octet_length(F.coalesce(F.col(body_col), F.lit(""))).cast("long").alias("n"))
    digests, digests_path = materialise(rows.select("id", "sha", "n"), "digests")
    shared = digests.where(f"id is not null and n >= {least_revisit}").groupBy("sha", "n").agg(F.max("id").alias("leader"), F.min("id").alias("other"))
    leaders, leaders_path = materialise(shared.where("other < leader").select("sha", "n", "leader"), "leaders")
    named = rows.join(leaders, ["sha", "n"], "left").withColumn("refers", F.expr("if(id < leader, leader, null)"))
    hex_sha = F.hex("sha")
    rid = _record_id(F.concat(F.lit("page:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.coalesce("url", F.lit("")))), F.lit(":"), hex_sha))
    revisit = F.col("refers").isNotNull()
    nothing = F.lit("")
    page_headers = F.concat(
        F.lit("WARC-Target-URI: "), _clean(F.col("url")), F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), _base32(hex_sha), F.lit(_CRLF),
        F.when(F.col("id").isNotNull(), F.concat(F.lit("X-Page-Id: "), F.col("id").cast("string"), F.lit(_CRLF))).otherwise(nothing),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}WARC-Refers-To: "), _record_id(F.concat(F.lit("page:"), F.col("refers").cast("string"), F.lit(":"), hex_sha)),
            F.lit(f"{_CRLF}X-Refers-To-Page-Id: "), F.col("refers").cast("string"), F.lit(_CRLF),
        )).otherwise(nothing),
    )
    # A revisit's block is the header of the response, with the length of the payload that it stands for.
    http = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"
    revisit_block = F.encode(F.concat(F.lit(f"{http}Content-Length: "), F.col("n").cast("string"), F.lit(_CRLF * 2)), "UTF-8")
    n_chunks = F.ceil(F.col("n") / F.lit(CHUNK_BYTES)).cast("int")
    chunk = lambda k: F.substring(F.col("body"), k * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES))
    framed = F.transform(F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.encode(F.concat(F.lower(F.hex(F.octet_length(chunk(k)).cast("long"))), F.lit(_CRLF)), "UTF-8"), chunk(k), F.lit(_CRLF.encode())))
    # Joined through hex digits: one pass over the payload, however many chunks it has.
    joined = F.unhex(F.array_join(F.transform(framed, lambda b: F.hex(b)), ""))
    block = F.concat(F.lit(f"{http}Transfer-Encoding: chunked{_CRLF * 2}".encode()), joined, F.lit(f"0{_CRLF * 2}".encode()))
    whole = named.select("url", "refers", rid.alias("rid"), F.encode(page_headers, "UTF-8").alias("headers"), F.when(revisit, revisit_block).otherwise(block).alias("block")).withColumn("total", F.octet_length("block"))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / F.lit(segment_bytes)).cast("int") - 1))
    pieces = whole.select("refers", "rid", "headers", "total", F.posexplode(F.transform(cuts, lambda k: F.substring(F.col("block"), k * segment_bytes + 1, F.lit(segment_bytes)))).alias("at", "piece"))
    several, first, last = F.col("total") > segment_bytes, F.col("at") == 0, (F.col("at") + 1) * segment_bytes >= F.col("total")
    number = (F.col("at") + 1).cast("string")
    own = F.when(first, F.col("rid")).otherwise(_record_id(F.concat(F.col("rid"), F.lit("#"), number)))
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    records = pieces.select(
        F.concat(
            F.encode(F.concat(F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind, F.lit(f"{_CRLF}WARC-Record-ID: "), own, F.lit(f"{_CRLF}WARC-Date: 2000-01-01T00:00:00Z{_CRLF}")), "UTF-8"),
            "headers",
            F.encode(F.concat(
                F.when(several, F.concat(F.lit("WARC-Segment-Number: "), number, F.lit(_CRLF))).otherwise(nothing),
                F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: "), F.col("rid"), F.lit(_CRLF))).otherwise(nothing),
                F.when(several & last, F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"), F.lit(_CRLF))).otherwise(nothing),
                F.lit("Content-Type: application/http; msgtype=response" + _CRLF + "Content-Length: "), F.octet_length("piece").cast("string"), F.lit(_CRLF * 2),
            ), "UTF-8"),
            "piece",
        ).alias("record")
    )
    sizes = digests.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.floor(F.col("n") / segment_bytes))).first()
    n_records = max(1, (sizes[0] or 0) + (sizes[2] or 0))
    mean = 700 + (sizes[1] or 0) / n_records
    # A record has a segment at most, so a file of long records only stays below 2,048 segments.
    per_file = int(min(2048, max(64, file_bytes // mean)))
    # The text writer puts out a string's bytes as they are.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(out)
    drop(pages.sparkSession, digests_path, leaders_path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, at, n = memoryview(data), 0, len(data)
    while at < n:
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {k.decode().strip().lower(): v.decode() for k, v in _HEADER.findall(data[data.index(b"\r\n", at) + 2 : end + 2])}
        size = int(headers["content-length"])
        if end + 4 + size > n:
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, bytes(view[end + 4 : end + 4 + size])
        at = end + 4 + size


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an HTTP response, chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.decode().strip().lower(): v.decode() for k, v in _HEADER.findall(head.partition(b"\r\n")[2] + b"\r\n")}
    if headers.get("transfer-encoding", "").lower() != "chunked":
        return headers, body
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return headers, b"".join(parts)
        parts.append(body[at : at + size])
        if len(parts[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk framing")
        at += size + 2


_FIELDS = ["record_type", "record_id", "origin_id", "segment", "total_length", "url", "payload_digest", "refers_to_id", "page_id", "refers_to", "block"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
_RECORD_DDL = "record_type string, record_id string, origin_id string, segment long, total_length long, url string, payload_digest string, refers_to_id string, page_id long, refers_to long, block binary"


def _row_of(h: dict[str, str], block: bytes) -> tuple:
    number = lambda x: int(x) if x is not None else None
    rid = h["warc-record-id"]
    return (h["warc-type"], rid, h.get("warc-segment-origin-id", rid), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), number(h.get("x-page-id")), number(h.get("x-refers-to-page-id")), block)


def _assembled(segments: list[tuple]) -> tuple | None:
    """The whole record of a file's segments of one origin, or None if some stand elsewhere or are here twice."""
    ordered = sorted(segments, key=lambda r: r[3])
    block = b"".join(r[-1] for r in ordered)
    if [r[3] for r in ordered] != list(range(1, len(ordered) + 1)) or ordered[-1][4] != len(block):
        return None
    return (*ordered[0][:3], None, None, *ordered[0][5:10], block)


def _parse(whole: bool):
    """Records of files: the whole ones and those whose segments stand in one file, or the other segments."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, segments = [], {}
                for h, block in parse_records(batch.column(0)[k].as_py()):
                    row = _row_of(h, block) if whole or "warc-segment-number" in h else None
                    if "warc-segment-number" in h:
                        segments.setdefault(row[2], []).append(row)
                    elif whole:
                        rows.append(row)
                for held in segments.values():
                    one = _assembled(held)
                    if whole and one is not None:
                        rows.append(one)
                    elif not whole and one is None:
                        rows.extend(held)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_FIELDS)

    return parse


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bodies = [], [], []
        for kind, stated, block in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
            headers, body = http_payload(block)
            if kind == "revisit":
                sizes.append(int(headers["content-length"]))
                digests.append((stated or "").removeprefix("sha1:"))
                bodies.append(None)
                continue
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if stated is not None and stated != f"sha1:{digest}":
                raise ValueError("payload doesn't have its digest")
            sizes.append(len(body))
            digests.append(digest)
            bodies.append(body)
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column(4), pa.array(bodies, pa.binary())], names=["record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"])


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """(record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload) of the responses and revisits below ``out``.

    Raises an error for cut-off records, missing segments, a wrong total length,
    broken chunk framing and payloads that don't have their digest. A revisit
    has no payload of its own; its length and digest are those it stands for.
    Records without a page id have null there; repeated records come out as often
    as they were written. A folder without records gives an empty result. A task
    holds one file at a time, and a record's segments.
    """
    files = spark.read.format("binaryFile").load(out).select("content")
    whole = files.mapInArrow(_parse(True), _RECORD_DDL).where("record_type in ('response', 'revisit')")
    # Segments of one origin in several files. Equal ones of repeated records are held once and counted.
    parts = files.mapInArrow(_parse(False), _RECORD_DDL)
    segment = F.struct("segment", "record_type", "url", "payload_digest", "page_id", "total_length", "block")
    joined = (
        parts.groupBy("origin_id").agg(F.sort_array(F.collect_set(segment)).alias("segs"), F.count(F.lit(1)).alias("n"))
        .withColumn("block", F.unhex(F.array_join(F.transform("segs", lambda s: F.hex(s["block"])), ""))).withColumn("first", F.expr("filter(segs, s -> s.segment = 1)[0]"))
    )
    fault = F.expr("transform(segs, s -> s.segment) <> sequence(1L, cast(size(segs) as bigint)) or n % size(segs) <> 0 or element_at(segs, -1).total_length is null or element_at(segs, -1).total_length <> octet_length(block)")
    sound = F.when(fault, F.raise_error(F.concat(F.lit("segments missing or of a wrong total length: "), "origin_id"))).otherwise(F.col("block"))
    reassembled = joined.select(
        F.col("first.record_type").alias("record_type"), F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), F.col("first.payload_digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), sound.alias("block"),
        F.explode(F.expr("sequence(1L, greatest(1L, n div size(segs)))")).alias("copy"),
    ).drop("copy")
    records = whole.select("record_type", "page_id", "url", "payload_digest", "refers_to", "block").unionByName(reassembled)
    return records.mapInArrow(_payloads, "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, out: str | None = None, **options) -> DataFrame:
    """Write the archives, read them back: the rows of :func:`read_archives`, one for each row of ``pages``.

    Nulls, repeated rows, ties and empty tables as in :func:`write_archives`.
    """
    out = out or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, out, **options)
    return read_archives(pages.sparkSession, out)
