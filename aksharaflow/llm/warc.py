"""WARC archives: a writer of request, response, revisit and metadata records, and transaction assembly on reading."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Fixed values of the format: line ends, and the profile of a revisit with the same payload.
CRLF = "\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b"
#: (Bytes of a payload at most, captures in a file of the writer): a file has about 64 MB at most, or one capture.
FILE_CAPTURES = ((1 << 17, 500), (1 << 21, 32), (1 << 62, 1))
#: Bytes of a file that are uncompressed at once, and bytes of records that a task hands on at once.
SLICE, FLUSH = 1 << 18, 1 << 24
#: Salts of a response that revisits refer to.
SALTS = 16


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """The text of a record up to its block's end; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in fields]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(CRLF * 2), block)


def write_warc(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 1000) -> None:
    """Writes captures (capture_id, url, payload string) as gzipped WARC/1.1 files below path, with Spark's text writer.

    Each capture gives a request, a response or revisit, and a metadata record that names its capture_id; request and
    metadata carry the concurrent-to identifier of the response. Of captures with equal payloads of at least
    least_bytes, that with the largest capture_id is a response and the others are revisits that refer to it.
    A file is read by one task, so captures are written by the size of their payload, large ones fewer to a file. Other
    columns are ignored. Null payloads are empty, null urls are written as about:blank, null ids come before all others. Rows that repeat
    id, url and payload give records with the same identifiers. An empty table gives an archive without records."""
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20]", "%20")
    rows = captures.select("capture_id", url.alias("url"), F.coalesce("payload", F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    same = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.count("*").alias("copies"), F.max(F.struct("capture_id", "url")).alias("main"))
    rows = rows.join(same.where("copies > 1").drop("copies"), ["digest", "bytes"], "left")
    revisit = F.coalesce(~F.col("capture_id").eqNullSafe(F.col("main.capture_id")), F.lit(False)) & F.col("main").isNotNull()

    here = _urn("response", F.col("capture_id"), F.col("url"), F.col("digest"))
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    payload = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    none = F.lit(None).cast("string")
    asked = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", F.col("capture_id"), F.col("url"), F.col("digest"))), *common, ("WARC-Concurrent-To", here), ("Content-Type", F.lit("application/http; msgtype=request"))],
                    F.concat(F.lit("GET "), F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", ""), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    got = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", here), *common, payload, ("WARC-Profile", F.when(revisit, F.lit(SAME_PAYLOAD))),
         ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("main.capture_id"), F.col("main.url"), F.col("digest"))).otherwise(none)), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    told = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", F.col("capture_id"), F.col("url"), F.col("digest"))), *common, ("WARC-Concurrent-To", here), ("Content-Type", F.lit("application/warc-fields"))],
                   F.concat(F.lit("capture-id: "), F.coalesce(F.col("capture_id").cast("string"), F.lit("")), F.lit(CRLF)))
    text = F.concat_ws(CRLF * 2, asked, got, told)
    longest, least = captures.agg(F.max(F.octet_length("payload"))).head()[0] or 0, -1
    for most, n in FILE_CAPTURES:
        some = rows.where(F.col("bytes") > least) if longest > most or least >= 0 else rows
        some = some.where(F.col("bytes") <= most) if longest > most else some
        some.select(text.alias("value")).write.mode("append" if least >= 0 else "error").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", n).text(path)
        least = most
        if longest <= most:
            break


def _pieces(data: bytes) -> Iterator[bytes]:
    """Uncompressed bytes of a file in pieces, whether plain, one gzip member or one member a record; ends where the
    compressed data is damaged or cut off."""
    at, z = 0, None
    while at < len(data):
        part = data[at : at + SLICE]
        if z is None and data[:2] == GZIP:
            if part[:2] != GZIP:
                return
            z = zlib.decompressobj(31)
        if z is None:
            at += len(part)
            yield part
            continue
        try:
            yield z.decompress(part)
        except zlib.error:
            return
        at += len(part) - len(z.unused_data)
        if z.eof:
            z = None


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in lower case, block) of each record of a WARC file; stops at a record that is cut off. One
    record at a time is held uncompressed."""
    held, more = bytearray(), _pieces(data)

    def find(what: bytes, start: int = 0) -> int:
        """Where `what` begins in what is held, which grows until it is there; -1 if it never is."""
        while (at := held.find(what, start)) < 0:
            start = max(start, len(held) - len(what) + 1)
            piece = next(more, None)
            if piece is None:
                return -1
            held.extend(piece)
        return at

    while (at := find(b"WARC/")) >= 0:
        del held[:at]
        end = find(b"\r\n\r\n")
        if end < 0:
            return
        lines = held[:end].decode("utf-8", "replace").split(CRLF)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = head.get("content-length", "")
        stop = end + 4 + (int(size) if size.isdecimal() else 0)
        while len(held) < stop:
            piece = next(more, None)
            if piece is None:
                return
            held.extend(piece)
        yield head, bytes(held[end + 4 : stop])
        del held[:stop]


RECORD = "type string, record_id string, concurrent_to string, refers_to string, url string, date string, digest string, http_head string, payload_bytes long, payload_digest string, capture_id long, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all files below path, a row each, whatever the files are called, plain or gzipped; payload_digest is
    the SHA-1 of the payload as read. Files whose names begin with _ or . are Spark's own and left out."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"capture_id": "Int64"})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                for head, block in parse_records(data):
                    kind, http, body, capture = head.get("warc-type"), "", block, None
                    if kind in ("request", "response", "revisit"):
                        top, _, body = block.partition(b"\r\n\r\n")
                        http = top.decode("utf-8", "replace")
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(CRLF) if ": " in x)
                        capture = int(fields["capture-id"]) if fields.get("capture-id", "").lstrip("-").isdigit() else None
                    rows.append((kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest", "").partition(":")[2] or None, http, len(body), hashlib.sha1(body).hexdigest(), capture, body if with_payload else None))
                    held += len(body) * with_payload + 1000
                    if held >= FLUSH:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, joined with the request and metadata concurrent to it.

    Columns: record_id, capture_id, type, copies (how often the archive holds the same record), response, request,
    metadata, and refers_to, payload_bytes, payload_digest, which a revisit takes from the response it refers to. A
    request or metadata without a response gives no row; a capture without them has nulls there. A revisit whose
    response isn't in the archive keeps the digest of its header, with null payload_bytes. Records without an id are no
    captures. Other columns of records are ignored, whatever their names; payloads may be of any length. An archive
    without records gives no rows. Records are staged once, so that the archive is parsed once."""
    records = staged(records.select(*[x.split()[0] for x in RECORD.split(", ")]), "warc-records")
    part = F.struct("record_id", "url", "date", "http_head", "payload_bytes", "payload")
    main = records.where(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull())
    main = main.groupBy("record_id").agg(F.count("*").alias("copies"), F.first(F.struct("type", "refers_to", "digest", "payload_digest", part.alias("response"))).alias("r")).select("record_id", "copies", "r.*")
    side = {k: records.where((F.col("type") == k) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first(F.struct("capture_id", part.alias("part"))).alias(k)) for k in ("request", "metadata")}
    both = staged(main.join(side["request"], "record_id", "left").join(side["metadata"], "record_id", "left"), "warc-captures")

    # Only revisits look for a response; one that many refer to is dealt out by a salt.
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")
    revisits = both.where(F.col("type") == "revisit").withColumn("salt", salt)
    wanted = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    target = both.where(F.col("type") == "response").join(wanted, "record_id", "left_semi")
    target = target.select(F.col("record_id").alias("refers_to"), F.col("metadata.capture_id").alias("target"), F.col("response.payload_bytes").alias("target_bytes"), F.col("payload_digest").alias("target_digest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = revisits.join(target, ["refers_to", "salt"], "left")

    def nested(rows: DataFrame, refers_to: Column, size: Column, digest: Column) -> DataFrame:
        return rows.select("record_id", F.col("metadata.capture_id").alias("capture_id"), "type", "copies", "response", F.col("request.part").alias("request"), F.col("metadata.part").alias("metadata"), refers_to.alias("refers_to"), size.alias("payload_bytes"), digest.alias("payload_digest"))

    own = nested(both.where(F.col("type") == "response"), F.lit(None).cast("long"), F.col("response.payload_bytes"), F.col("payload_digest"))
    return own.unionByName(nested(found, F.col("target"), F.col("target_bytes"), F.coalesce("target_digest", "digest")))
