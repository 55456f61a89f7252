"""WARC archives in Zstandard: a dictionary frame, then one frame for each record.

``write`` turns pages into archives of bounded size, as rows (path, content) like those of
Spark's ``binaryFile`` source; ``export`` puts them into a folder and ``load`` reads such a
folder. ``read`` takes the dictionary from the leading skippable frame, walks the block
headers of each following frame to find where it ends, decodes one frame per record and
checks version line, header fields, lengths, the closing blank lines and payload digests.

Records with equal payloads: the one with the smallest page_id is the response, the others
are revisits that refer to it. That is decided on narrow rows (place, digest, page_id), with
digests that occur once left out, and only the revisits' flags are joined back to the pages,
by the place of the row: payloads never follow the digest, so a payload that a third of all
pages share is in no task of its own. The table of repeated digests is written before it is
joined, which lets the skew join split the narrow rows of a hot digest.

Defined results: a null html is an empty payload; a null url becomes ``urn:page:`` and the id;
rows that repeat the response's page_id are responses too; a group whose ids are all null
has only responses. A record's id is made from the place of its row besides its page_id, so
no two records share one. Records that fail a check come back with ``error`` set, or stop the
reading with ``strict``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, numbered
from .words import bounded_batches

SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Bytes by which a payload must be as long as to be stored once only.
LEAST_REVISIT = 0


def train_dictionary(pages: DataFrame, sample_pages: int = 400, size: int = 1 << 15) -> bytes:
    """A Zstandard dictionary of the first ``sample_pages`` payloads that the scan yields (only compression depends on it)."""
    import zstandard

    rows = pages.where("html is not null and octet_length(html) between 1 and 65536").select("html").limit(sample_pages).collect()
    samples = [r["html"].encode("utf-8", "surrogatepass") for r in rows]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]  # too few to train: plain content


def record_id(page_id: int | None, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page_id}:{place}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, place: str = "", refers_place: str = "") -> bytes:
    """A response, or a revisit without payload if it refers to another page; places tell equal pages apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, place)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url) if url is not None else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_place)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with digest, length and, for revisits, the page they refer to and its place."""
    every, place = numbered(pages), ["_file", "_at"]
    html = F.coalesce("_row.html", F.lit(""))
    rows = every.select(*place, F.col("_row.page_id").cast("long").alias("page_id"), F.col("_row.url").cast("string").alias("url"), html.alias("html"))
    slim = materialize(rows.select(*place, "page_id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").cast("long").alias("length")))
    least_id = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", *place))
    first = slim.where(F.col("length") >= least).groupBy("digest").agg(least_id.alias("first"), F.count("*").alias("n")).where("n > 1 and not first.unnamed")
    first = materialize(first.select("digest", F.col("first.page_id").alias("refers_to"), F.concat_ws(":", "first._file", "first._at").alias("refers_place")))
    again = slim.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(*place, "refers_to", "refers_place")
    out = rows.join(materialize(again), place, "left").withColumn("digest", F.unhex(F.sha1("html"))).withColumn("length", F.octet_length("html").cast("long"))
    return out.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "length", "digest", "refers_to", F.concat_ws(":", *place).alias("place"), "refers_place")


def write(pages: DataFrame, archive_bytes: int = 4 << 20, level: int = 3, least: int = LEAST_REVISIT) -> DataFrame:
    """``path, length, content``: archives of about ``archive_bytes`` each."""
    bounded_batches(pages.sparkSession)
    trained = train_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        head, known = b"", None
        if trained:
            packed = zstandard.ZstdCompressor(level=19).compress(trained)
            head, known = struct.pack("<II", SKIPPABLE, len(packed)) + packed, zstandard.ZstdCompressionDict(trained)
            known.precompute_compress(level=level)
        pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        held, size, number = [], 0, 0

        def archive() -> pa.RecordBatch:
            content = head + b"".join(held)
            name = f"pages-{TaskContext.get().partitionId():06d}-{number:06d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"])

        for batch in batches:
            for page_id, url, html, length, digest, refers, place, refers_place in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode("utf-8", "surrogatepass")
                frame = pack.compress(record(page_id, url, payload, length, base64.b32encode(digest).decode(), refers, place, refers_place))
                held.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield archive()
                    held, size, number = [], 0, number + 1
        if held:
            yield archive()

    return plan_records(pages, least).mapInArrow(run, "path string, length long, content binary")


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of ``folder``, a URI of storage that all executors share.

    Executors write; a file appears under its name when it is complete, so a task that runs
    twice leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = f"{root.rstrip('/')}/.{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, f"{root.rstrip('/')}/{path}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    archives.select("path", "content").mapInArrow(run, "path string").count()


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of a folder, ready for :func:`read`."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "length", "content")


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its block headers."""
    import zstandard

    checksum = bool(data[at + 4] & 4)
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        if at + 3 > len(data):
            raise ValueError("truncated frame")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            at += 4 * checksum
            if at > len(data):
                raise ValueError("truncated frame")
            return at


def records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an archive."""
    import zstandard

    data, at = memoryview(content), 0
    unpack = zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        trained = bytes(data[8 : 8 + size])
        if len(trained) < size:
            raise ValueError("truncated dictionary")
        if size >= 4 and struct.unpack_from("<I", trained)[0] == FRAME:
            trained = zstandard.ZstdDecompressor().decompressobj().decompress(trained)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        at = 8 + size
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("truncated frame")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # a later skippable frame holds no record
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME:
            raise ValueError("not a Zstandard frame")
        end = frame_end(data, at)
        yield at, unpack.decompressobj().decompress(data[at:end])
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of a record, after checking its form and length."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        fields.setdefault(name.lower(), value.strip())
    if missing := [x for x in REQUIRED if x not in fields]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        raise ValueError("bad Content-Length")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} doesn't fit a record of {len(rest)} bytes after its header")
    return fields, rest[:length]


def unpack_http(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int | None]:
    """Payload (null for a revisit) and the full payload's length, after checking the digest."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    stated = [x.partition(b":")[2].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    length = int(stated[0]) if stated and stated[0].isdigit() else None
    if fields["warc-type"] == "revisit":
        return None, length
    if length is not None and length != len(payload):
        raise ValueError(f"HTTP Content-Length {length}, payload of {len(payload)} bytes")
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("payload digest differs")
    return payload, len(payload)


_READ = [("archive", pa.string(), "string"), ("offset", pa.int64(), "long"), ("record_type", pa.string(), "string"), ("record_id", pa.string(), "string"), ("target_uri", pa.string(), "string"), ("date", pa.string(), "string"), ("payload_digest", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("page_id", pa.int64(), "long"), ("refers_to", pa.int64(), "long"), ("payload", pa.binary(), "binary"), ("error", pa.string(), "string")]


def read(archives: DataFrame, payloads: bool = True, strict: bool = False) -> DataFrame:
    """One row for each record of the archives (path, content)."""
    kinds = [k for k in _READ if payloads or k[0] != "payload"]

    def rows(path: str, content: bytes) -> Iterator[dict]:
        at = 0
        try:
            for at, raw in records(content):
                row = {"archive": path, "offset": at}
                try:
                    fields, block = parse(raw)
                    payload, length = unpack_http(fields, block)
                    number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    row |= {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": length, "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "payload": payload}
                except ValueError as e:
                    if strict:
                        raise
                    row["error"] = str(e)
                yield row
        except Exception as e:  # the rest of a damaged archive can't be told apart
            if strict:
                raise
            yield {"archive": path, "offset": at, "error": f"unreadable after this: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in rows(path.as_py(), content.as_py()):
                    held.append(row)
                    size += len(row.get("payload") or b"") if payloads else 0
                    if len(held) == 1000 or size > 8 << 20:
                        yield table(held)
                        held, size = [], 0
                yield table(held)

    def table(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], k) for n, k, _ in kinds], names=[n for n, _, _ in kinds])

    return archives.select("path", "content").mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in kinds))


#: Digests and roles for DuckDB.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, strlen(t) AS n, CASE WHEN strlen(t) >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY h) END AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id OR page_id IS NULL THEN first_id END AS refers_to
FROM f
"""
