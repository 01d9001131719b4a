"""Web archives: ARC records written, converted to WARC with revisits, and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm._spark import cut, shared_dir, small_batches

#: Names of the fields of an ARC header line by version of the archive.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: Records at most after one ARC version block or in one row of a WARC file; bytes beyond which a row ends; rows of a file.
#: A file so holds FILE_ROWS * BATCH_BYTES bytes and one record more at most.
ARC_RECORDS, FILE_ROWS = 500, 8
BATCH_BYTES = 4 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a shorter form of it, as a WARC-Date."""
    d = (arc_date + "00000101000000"[len(arc_date) :]) if arc_date.isdigit() and 4 <= len(arc_date) <= 14 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _plain(url: str | None) -> str:
    """A URL without the blanks and control characters that would break a header line."""
    out = re.sub(r"[\x00-\x20\x7f\x85\xa0  -     　]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    return out or "urn:unknown"


def _arc_records(date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total = 0, [], 0

        def archive() -> pa.RecordBatch:
            """One row: a version block and the records held, whole, so that files can be split between rows."""
            version = 1 + number % 2
            about = f"{version} 0 fieldlens\n{ARC_FIELDS[version]}\n"
            out = [f"filedesc://pages.arc 0.0.0.0 {date} text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}{len(about)}\n{about}".encode()]
            for url, head, body in held:
                more = f"200 {base32_sha1(body)} - 0 pages.arc " if version == 2 else ""
                out.append(f"{url} 0.0.0.0 {date} text/html {more}{len(head) + len(body)}\n".encode() + head + body)
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], pa.binary())], ["value"])

        for b in batches:
            for page, url, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                body = body or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                held.append((_plain(url), head, body))
                total += len(body)
                if total > BATCH_BYTES or len(held) == ARC_RECORDS:
                    yield archive()
                    number, held, total = number + 1, [], 0
        if held:
            yield archive()

    return run


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """Rows of bytes as gzipped files: a string column carries any bytes into a text file unchanged."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def write_arc(pages: DataFrame, path: str, date: str = "20250101000000") -> None:
    """Gzipped ARC files under ``path``: a version block of version 1 or 2, then a record for every page. html is a string or bytes."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    _write(rows.mapInArrow(_arc_records(date), "value binary"), path, "\n")


def parse_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str] | None, bytes, int]]:
    """(header fields, block, offset) of each record. Every version block says which fields its successors have;
    the declared length alone says where a block ends. Blanks that are too many belong to the URL. A line that is no header gives
    (None, the line, its offset); reading goes on with the next line."""
    fields, offset = ARC_FIELDS[1].split(), 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        about = parts[0].startswith("filedesc:")
        if not parts[-1].isascii() or not parts[-1].isdigit() or (len(parts) < len(fields) and not about):
            yield None, line, start
            continue
        block = stream.read(int(parts[-1]))
        offset += len(block)
        if len(block) < int(parts[-1]):  # the file ends before the record does
            yield None, line, start
        elif about:
            lines = block.split(b"\n")
            named = lines[1].decode("utf-8", "replace").split() if len(lines) > 1 else []
            if {"URL", "IP-address", "Archive-date"} <= set(named):
                fields = named
            else:
                yield None, line, start
        else:
            url = "%20".join(parts[: len(parts) - len(fields) + 1])
            yield dict(zip(fields, [url, *parts[len(parts) - len(fields) + 1 :]], strict=True)), block, start


def _http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, gap, payload = block.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return head + gap, named, payload


def _open(content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > BATCH_BYTES or len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_PARSED = pa.schema(
    [(n, pa.string()) for n in ("record_id", "uri", "ip", "date")] + [("http", pa.binary()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    + [("path", pa.string()), ("at", pa.int64()), ("problem", pa.string())]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for fields, block, offset in parse_arc(_open(content.as_py())):
                    if fields is None:
                        yield (*[None] * 9, path, offset, f"no ARC header line: {block[:200].decode('utf-8', 'replace').rstrip()}")
                        continue
                    head, named, payload = _http(block)
                    page = named.get("X-Page-Id", "")
                    seed = "\n".join([fields["URL"], fields["Archive-date"], page, path.rsplit("/", 1)[-1], str(offset)])
                    yield (
                        str(uuid.UUID(bytes=hashlib.sha1(seed.encode()).digest()[:16], version=5)), fields["URL"], fields["IP-address"], warc_date(fields["Archive-date"]),
                        head, int(page) if page.isascii() and page.isdigit() or page[1:].isdigit() and page[0] == "-" else None, base32_sha1(payload), len(payload), payload, path, offset, None,
                    )

    yield from _batched(rows(), _PARSED, lambda r: r[7] or 0)


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    info = b"software: fieldlens\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {warc_date('2025')}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
    out, total = [head.encode() + info], 0
    written = False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(out)], pa.binary())], ["value"])

    for b in batches:
        for r in b.to_pylist():
            revisit = r["refers"] is not None
            length = len(r["http"]) + (0 if revisit else r["payload_bytes"])
            header = (
                f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: <urn:uuid:{r['record_id']}>\r\nWARC-Date: {r['date']}\r\n"
                f"WARC-Target-URI: {r['uri']}\r\nWARC-IP-Address: {r['ip']}\r\nWARC-Payload-Digest: sha1:{r['digest']}\r\n"
                + (f"WARC-Refers-To: <urn:uuid:{r['refers']}>\r\nWARC-Profile: {REVISIT_PROFILE}\r\n" if revisit else "")
                + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {length}\r\n\r\n"
            )
            out.append(header.encode() + r["http"] + (b"" if revisit else r["payload"]))
            total += len(out[-1])
            written = True
            if total > BATCH_BYTES:
                yield row()
                out, total = [], 0
    if out and written:
        yield row()


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> DataFrame:
    """Turn the ARC files under ``arc_path`` into gzipped WARC files under ``warc_path``; returns what couldn't be read as
    ``path, at, problem`` (a line that is no header, a record that its file cuts off).

    Blocks are bytes from end to end: whatever a page's encoding, its payload and digest stay as they are.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest X-Page-Id stays a
    response, the others become revisits of it without payload. The payload digest is computed from the block.
    Records with one payload are found by a minimum and a join on its digest, so however many they are, none
    is gathered in one place.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").load(arc_path).select("path", "content")
    read = cut(files.mapInArrow(_converted, _ddl(_PARSED)), "arc")
    parsed = read.where("problem is null").drop("path", "at", "problem")
    last = F.max(F.struct("page_id", "record_id")).alias("last")
    kept = parsed.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), last).where("n > 1")
    kept = kept.select(F.col("digest").alias("k_digest"), F.col("payload_bytes").alias("k_bytes"), F.col("last.record_id").alias("k_id"))
    # Only which record refers to which is joined; of payloads just those that stay go on.
    links = parsed.select("record_id", "digest", "payload_bytes").join(kept, (F.col("digest") == F.col("k_digest")) & (F.col("payload_bytes") == F.col("k_bytes")))
    links = cut(links.where("record_id <> k_id").select(F.col("record_id").alias("r_id"), F.col("k_id").alias("refers")), "revisits")
    out = parsed.join(links, F.col("record_id") == F.col("r_id"), "left").drop("r_id")
    lines = out.withColumn("payload", F.when(F.col("refers").isNull(), F.col("payload"))).mapInArrow(_warc_records, "value binary")
    _write(lines, warc_path, RECORD_END)
    return read.where("problem is not null").select("path", "at", "problem")


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("a WARC record doesn't start where the one before it ends")
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            fields[name] = value
        yield fields, stream.read(int(fields["Content-Length"]))


_READ = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for content in b.column(0):
                for fields, block in parse_warc(_open(content.as_py())):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    _, named, payload = _http(block)
                    digest, page = fields["WARC-Payload-Digest"].removeprefix("sha1:"), named.get("X-Page-Id", "")
                    response = fields["WARC-Type"] == "response"
                    if response and base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    yield (
                        int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Type"], fields["WARC-Record-ID"].strip("<>"),
                        fields["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in fields else None, len(payload) if response else int(named["Content-Length"]), digest,
                    )

    yield from _batched(rows(), _READ, lambda r: 200)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, uri, date, record_type, record_id, refers, payload_bytes, payload_digest`` of the response and
    revisit records under ``path``; the digest of every response is checked against its payload. A revisit's
    payload_bytes is the length that its HTTP header declares."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, _ddl(_READ))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as ARC, convert the archives to WARC and read those back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, record_id``; refers_to is the page_id of a revisit's response.

    The payload is html in UTF-8; null is empty. Null urls become ``urn:unknown``, blanks in urls are escaped.
    A null page_id is kept as null and is a response only where no other record has its payload. Of repeated
    rows one is the response (the one with the largest record id), the others revisit it. An empty table gives an
    empty result. Archives stay in the shared folder; other columns are not read.
    """
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/fieldlens-archive-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc")
    if spark.read.format("binaryFile").load(f"{base}/arc").select("path").isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")
    convert_arc(spark, f"{base}/arc", f"{base}/warc", least_bytes)
    back = cut(read_warc(spark, f"{base}/warc"), "warc")
    target = back.where("record_type = 'response'").select(F.col("record_id").alias("t_id"), F.col("page_id").alias("refers_to"))
    out = back.join(target, F.col("refers") == F.col("t_id"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
