"""Legacy ARC archives to WARC archives.

An archive is one row of bytes (name, content).  An ARC archive begins with a version block whose third line names the
fields of every header line (five in version 1, ten in version 2); each record is such a line and as many bytes as it
declares.  Archives may be plain or gzipped record by record.  Converted records get an identifier derived from (URL, date, archive,
offset), an ISO timestamp from the 14 digits, a type (response for HTTP, resource otherwise) and SHA-256 digests of block and payload.

``revisits`` decides duplicates over all archives with one pre-aggregated group per digest; ``warc_archives``
packs records into gzipped WARC members of bounded size; ``write_archives`` puts each archive into a
file of its own through Spark's writer, so any storage works, and ``read_archives`` reads them back.

Defined results: a null payload is empty; a null URL is written as ``about:blank`` and blanks in URLs as percent codes; a date that is not
14 digits takes the archive's own date; a header line that cannot be read, or a length beyond the archive's end, ends that archive with
one row that carries only ``error``; records with equal ids and payloads are told apart by archive and offset; empty
tables give no archives.  Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION_1 = "URL IP-address Archive-date Content-type Archive-length"
VERSION_2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
ARCHIVE_BYTES = 8 << 20
RECORD = ("archive string, offset long, url string, ip string, date string, mime string, record_id string, type string, "
          "http binary, payload binary, payload_bytes long, payload_digest string, error string")
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in RECORD.split(", ")])


def _quoted(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def arc_block(name: str, date: str, version: int) -> bytes:
    """The version block that opens an archive."""
    body = (f"{version} 0 converted\n{VERSION_1 if version == 1 else VERSION_2}\n\n").encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(body)}\n".encode() + body


def arc_record(name: str, offset: int, url: str, date: str, mime: str, content: bytes, version: int) -> bytes:
    middle = "" if version == 1 else f"200 - - {offset} {name} "
    return f"\n{url} 0.0.0.0 {date} {mime} {middle}{len(content)}\n".encode() + content


def parsed_arc(name: str, content: bytes) -> Iterator[dict]:
    """The records of one archive, with the payload apart from its HTTP header."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at, fields, own_date = 0, None, "19700101000000"
    while at < len(data):
        while data[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r") if end >= 0 else ""
        parts = line.split(" ")
        if fields is None:
            length = int(parts[-1]) if line.startswith("filedesc://") and parts[-1].isdigit() else None
            block = data[end + 1:end + 1 + length].decode("utf-8", "replace").split("\n") if length else []
            if len(block) < 2 or block[0].split(" ")[0] not in ("1", "2") or not block[1].endswith("Archive-length"):
                yield {"archive": name, "offset": at, "error": "no readable version block"}
                return
            fields, own_date, at = block[1].split(" "), parts[2] if len(parts) > 2 else own_date, end + 1 + length
            continue
        extra = len(parts) - len(fields)  # a content type may hold blanks
        if extra > 0:
            k = fields.index("Content-type")
            parts[k:k + extra + 1] = [" ".join(parts[k:k + extra + 1])]
        if end < 0 or extra < 0 or not parts[-1].isdigit() or end + 1 + int(parts[-1]) > len(data):
            yield {"archive": name, "offset": at, "error": "unreadable header line or length"}
            return
        head = dict(zip(fields, parts))
        body = data[end + 1:end + 1 + int(parts[-1])]
        cut = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") else 0
        cut = max(cut, 0) if cut != 3 else len(body)
        digits = head["Archive-date"] if re.fullmatch(r"\d{14}", head["Archive-date"]) else own_date
        date = f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"
        key = f"{head['URL']} {date} {name} {at}"
        yield {"archive": name, "offset": at, "url": head["URL"], "ip": head["IP-address"], "date": date, "mime": head["Content-type"],
               "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}", "type": "response" if cut else "resource",
               "http": body[:cut], "payload": body[cut:], "payload_bytes": len(body) - cut,
               "payload_digest": hashlib.sha256(memoryview(body)[cut:]).hexdigest()}
        at = end + 1 + len(body)


def _rows(parse):
    """mapInArrow over (name, content) rows, an archive at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = list(parse(name.as_py() or "", content.as_py() or b""))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=_ARROW)
    return run


def converted(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ARC archives (name, content); without payloads only their sizes and digests leave the task."""
    def parse(name: str, content: bytes) -> Iterator[dict]:
        for r in parsed_arc(name, content):
            yield r if payloads else r | {"payload": None}

    return archives.select("name", "content").mapInArrow(_rows(parse), RECORD)


def revisits(records: DataFrame, rank: str, least_bytes: int = 100) -> DataFrame:
    """record_id, refers_to: records whose payload an earlier one (by rank, then archive and offset) already holds.
    One pre-aggregated row per digest finds the first; the digests that occur once never join."""
    known = records.filter(F.col("payload_bytes") >= least_bytes).select(
        "payload_digest", "record_id", F.struct(F.expr(rank).alias("rank"), "archive", "offset", "record_id").alias("key"))
    first = known.groupBy("payload_digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return (known.join(first, "payload_digest").filter("record_id <> first.record_id")
            .select("record_id", F.col("first.record_id").alias("refers_to")))


def _warc_record(r: dict) -> bytes:
    revisit = r["refers_to"] is not None
    block = (r["http"] or b"") + (b"" if revisit else r["payload"] or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['type']}", f"WARC-Record-ID: <{r['record_id']}>",
            f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
            f"WARC-Payload-Digest: sha256:{r['payload_digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            f"Content-Type: {'application/http; msgtype=response' if r['http'] else r['mime']}"]
    if revisit:
        head += [f"WARC-Refers-To: <{r['refers_to']}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Payload-Length: {r['payload_bytes']}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(batches: Iterator[pa.RecordBatch], member, start, prefix: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of (name, content): the members of consecutive rows, up to ``most`` bytes or one row."""
    from pyspark import TaskContext

    part, held, size, n = TaskContext.get().partitionId(), [], 0, 0

    def flush():
        return pa.record_batch([pa.array([f"{prefix}-{part:05d}-{n:05d}"]), pa.array([b"".join(held)], pa.binary())], names=["name", "content"])

    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {c: batch.column(j)[i].as_py() for j, c in enumerate(names)}
            if not held:
                held, size = [start(f"{prefix}-{part:05d}-{n:05d}", n)], 0
            held.append(member(row, f"{prefix}-{part:05d}-{n:05d}", size, n))
            size += len(held[-1])
            if size >= most:
                yield flush()
                held, n = [], n + 1
    if held:
        yield flush()


def arc_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Packs pages into ARC archives (name, content), versions 1 and 2 in turn; the id travels as an HTTP header.
    Pages have no dates: the date is the epoch plus as many seconds as the id says."""
    def member(row: dict, name: str, offset: int, n: int) -> bytes:
        payload = row["payload"] or b""
        mark = "" if row["id"] is None else f"X-Page-Id: {row['id']}\r\n"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode()
        return arc_record(name, offset, _quoted(row["url"]), row["date"], "text/html", http + payload, 1 + n % 2)

    rows = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{url_col}`").alias("url"),
                        F.col(f"`{payload_col}`").cast("binary").alias("payload"),
                        F.date_format(F.timestamp_seconds(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)) % 4102444800),
                                      "yyyyMMddHHmmss").alias("date"))
    return rows.mapInArrow(lambda b: _packed(b, member, lambda name, n: arc_block(name, "19700101000000", 1 + n % 2), "pages", most),
                           "name string, content binary")


def warc_archives(records: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Packs records (with refers_to) into WARC archives, each record a gzip member of its own."""
    def member(row: dict, name: str, offset: int, n: int) -> bytes:
        return gzip.compress(_warc_record(row), 1, mtime=0)

    def start(name: str, n: int) -> bytes:
        body = f"software: archive converter\r\nformat: WARC File Format 1.1\r\nfilename: {name}.warc.gz\r\n".encode()
        head = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\n"
                f"WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n")
        return gzip.compress(head.encode() + body + b"\r\n\r\n", 1, mtime=0)

    return records.mapInArrow(lambda b: _packed(b, member, start, "converted", most), "name string, content binary")


def write_archives(archives: DataFrame, folder: str) -> None:
    """One file for each archive.  Spark's text writer ends a file with its line separator: here the zero byte that ends a
    gzip member of under 16 MiB, which is taken off the content first (an empty member is added if the last byte is another)."""
    empty = gzip.compress(b"", 1, mtime=0)
    whole = F.when(F.expr("right(content, 1) = x'00'"), F.col("content")).otherwise(F.concat("content", F.lit(empty)))
    archives.select(whole.alias("c")).select(
        F.expr("substring(c, 1, length(c) - 1)").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", "\0").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """name, content of every file."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("name"), "content")


def parsed_warc(name: str, content: bytes) -> Iterator[dict]:
    """The response, resource and revisit records of one archive, with sizes and digests of what was read."""
    at, whole = 0, memoryview(content)
    while at < len(content):
        # a member is fed in slices, as what follows it is copied when it ends
        member, where, parts = zlib.decompressobj(31), at, []
        while not member.eof and at < len(content):
            parts.append(member.decompress(whole[at:at + 16384]))
            at += 16384
        at = min(at, len(content)) - len(member.unused_data)
        data = b"".join(parts)
        if not data:
            continue
        cut = data.index(b"\r\n\r\n")
        head = dict(x.split(": ", 1) for x in data[:cut].decode().split("\r\n")[1:])
        block = data[cut + 4:cut + 4 + int(head["Content-Length"])]
        if head["WARC-Type"] not in ("response", "resource", "revisit"):
            continue
        edge = block.find(b"\r\n\r\n") + 4 if head["Content-Type"].startswith("application/http") else 0
        row = {"archive": name, "offset": where, "url": head["WARC-Target-URI"], "ip": head["WARC-IP-Address"], "date": head["WARC-Date"],
               "mime": head["Content-Type"], "record_id": head["WARC-Record-ID"][1:-1], "type": head["WARC-Type"], "http": block[:edge]}
        if head["WARC-Type"] == "revisit":
            yield row | {"payload_bytes": int(head["X-Payload-Length"]), "payload_digest": head["WARC-Payload-Digest"][7:],
                         "refers_to": head["WARC-Refers-To"][1:-1]}
        else:
            yield row | {"payload": block[edge:], "payload_bytes": len(block) - edge, "payload_digest": hashlib.sha256(block[edge:]).hexdigest()}


def warc_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of WARC archives (name, content), and refers_to."""
    schema = _ARROW.append(pa.field("refers_to", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = [r if payloads else r | {"payload": None} for r in parsed_warc(name.as_py(), content.as_py())]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return archives.select("name", "content").mapInArrow(run, RECORD + ", refers_to string")


def converted_archives(arc: DataFrame, folder: str, rank: str = "archive") -> None:
    """ARC archives to WARC archives in ``folder``; ``rank`` orders the records that share a payload."""
    again = revisits(converted(arc, payloads=False), rank)
    records = converted(arc).filter("error is null").join(again, "record_id", "left")
    write_archives(warc_archives(records), folder)
