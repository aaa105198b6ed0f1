"""WARC archives in Zstandard: a leading dictionary frame, one frame per record, written and read by Spark."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: Follows each frame as Spark's line end: an empty skippable frame, which readers pass over.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads that train the dictionary, bytes of each, bytes of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32 << 10
#: A payload of fewer bytes is always written whole.
LEAST_REVISIT = 100
#: Compressed bytes from which an archive is closed.
ARCHIVE_BYTES = 16 << 20
_PIECE = 16 << 10
_RECORDS = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long,"
    " payload binary, refers_to string, error string"
)


class DamagedArchive(ValueError):
    pass


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample of page heads, chosen by hash; empty if there are too few."""
    head = F.substring(F.col(html), 1, SAMPLE_BYTES)
    rows = pages.where(F.length(html) > 0).select(F.xxhash64(html).alias("h"), head.alias("t"))
    least = rows.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]  # hashes alone are ranked
    few = rows.where(F.col("h") <= least).groupBy("h").agg(F.first("t").alias("t"))
    samples = [r.t.encode() for r in sorted(few.collect(), key=lambda r: r.h)] if least is not None else []
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # the samples are too small or too alike
        return b""


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(kind: str, record_id: str, uri: str | None, payload: bytes, date: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit has its HTTP head only."""
    digest = sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _header(uri))] if uri else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{sha256(block).hexdigest()}")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise DamagedArchive(f"bad header line {line[:60]!r}")
        out[name.lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> dict:
    """The record's fields and payload; raises ``DamagedArchive`` where a header, length or digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise DamagedArchive("no WARC header")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise DamagedArchive(f"{name} is missing")
    if not fields["content-length"].isdecimal():
        raise DamagedArchive("content-length is no number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise DamagedArchive(f"content-length is {n}, the block has {len(rest) - 4} bytes")
    block = rest[:n]
    if fields.get("warc-block-digest", "").startswith("sha256:"):
        if fields["warc-block-digest"][7:] != sha256(block).hexdigest():
            raise DamagedArchive("block digest differs")
    payload, length = block, n
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise DamagedArchive("HTTP head does not end")
        said = _fields(http.partition(b"\r\n")[2]).get("content-length")
        length = int(said) if said and said.isdecimal() else len(payload)
        if fields["warc-type"] != "revisit" and length != len(payload):
            raise DamagedArchive(f"HTTP content-length is {length}, the payload has {len(payload)} bytes")
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] != "revisit":
        own = sha256(payload).hexdigest()
        if digest.startswith("sha256:") and digest[7:] != own:
            raise DamagedArchive("payload digest differs")
        digest = "sha256:" + own
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": digest.removeprefix("sha256:"),
        "payload_bytes": length,
        "payload": None if fields["warc-type"] == "revisit" else payload,
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "error": None,
    }


def _frame(data: bytes, at: int, open_: zstandard.ZstdDecompressor) -> tuple[int, bytes | None, zstandard.ZstdDecompressor]:
    """Where the frame at ``at`` ends, its record (none in a skippable frame) and the decompressor for what follows."""
    if len(data) - at < 8:
        raise DamagedArchive(f"{len(data) - at} bytes after the last frame")
    magic, size = struct.unpack_from("<II", data, at)
    if magic in SKIPPABLE:
        if at + 8 + size > len(data):
            raise DamagedArchive("a skippable frame is cut off")
        if magic == DICTIONARY_MAGIC and at == 0:
            raw = data[8 : 8 + size]
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                raw = zstandard.ZstdDecompressor().decompress(raw)
            open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        return at + 8 + size, None, open_
    if magic != FRAME_MAGIC:
        raise DamagedArchive(f"no frame at byte {at}")
    frame, parts = open_.decompressobj(), []
    try:
        while not frame.eof:
            piece = data[at : at + _PIECE]
            if not piece:
                raise DamagedArchive("a frame is cut off")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
    except zstandard.ZstdError as e:
        raise DamagedArchive(str(e)) from e
    return at, b"".join(parts), open_


def frames(data: bytes, damage: list[str] | None = None) -> Iterator[bytes]:
    """The records of an archive, one per Zstandard frame; a dictionary stands in the leading skippable frame.

    Damage is raised, or noted in ``damage`` if given; reading then goes on behind the next empty frame."""
    open_, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        try:
            at, raw, open_ = _frame(data, at, open_)
        except DamagedArchive as e:
            if damage is None:
                raise
            damage.append(str(e))
            gap = data.find(EMPTY_FRAME.encode(), at + 1)
            if gap < 0:
                return
            at = gap + len(EMPTY_FRAME)
            continue
        if raw is not None:
            yield raw


def write_archives(
    records: DataFrame, path: str, dictionary: bytes = b"", date: str = "2024-01-01T00:00:00Z", level: int = 3,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write ``records(record_id, uri, payload, refers_to)`` as archives in the folder ``path``.

    An archive is closed once it holds ``archive_bytes``, so only a single larger record makes a larger one. A record
    with ``refers_to`` is a revisit. Spark's text writer puts each archive into a file, so a lost task leaves no half
    file; each file is ``dictionary frame, frame, empty frame, frame, ...``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True, write_content_size=True)
        lead = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary] if dictionary else []
        held, size = list(lead), 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([EMPTY_FRAME.encode().join(held)], pa.binary())], ["archive"])

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                kind = "response" if r["refers_to"] is None else "revisit"
                raw = record_bytes(kind, r["record_id"], r["uri"], r["payload"] or b"", date, r["refers_to"])
                held.append(press.compress(raw))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()
                    held, size = list(lead), 0
        if size:
            yield closed()

    rows = records.select("record_id", "uri", "payload", "refers_to")
    made = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Every record below ``path``: its id, type, target, payload with length and digest, and what a revisit refers to.

    Headers, lengths and digests are checked. Damage ends the job, or with ``strict=False`` gives a row whose
    ``error`` says what is wrong; reading goes on behind the next empty frame, so only damaged records are lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORDS.split(", ")]
        shape = pa.schema(
            [(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names]
        )
        for b in batches:
            for where, data in zip(b.column("path").to_pylist(), b.column("content")):
                rows, size = [], 0
                damage = None if strict else []
                try:
                    for raw in frames(data.as_py(), damage):
                        try:
                            rows.append(parse_record(raw))
                        except DamagedArchive as e:
                            if strict:
                                raise
                            damage.append(str(e))
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows, size = [], 0
                except DamagedArchive as e:
                    raise DamagedArchive(f"{where}: {e}") from e
                rows += [dict.fromkeys(names) | {"error": f"{where}: {e}"} for e in damage or ()]
                yield pa.RecordBatch.from_pylist(rows, shape)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _RECORDS)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record per page into archives below ``path``.

    Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest id is written whole
    and the others as revisits to it. A null html is an empty payload, a null url gives no target. Repeated rows
    of the smallest id are all written whole; a page without an id is a revisit if an equal page has one. Equal pages
    are found on digests alone; page bodies are shuffled once, by (id, digest)."""
    body = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.select(
        F.col(id_col).alias("id"), F.col(url).alias("uri"), F.sha2(body.cast("binary"), 256).alias("digest"), body.alias("body")
    )
    small = keyed.where(F.octet_length("body") >= LEAST_REVISIT).select("id", "digest")
    first = small.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = small.distinct().join(first.select("digest", "first"), "digest").where("first is not null and not first <=> id")
    again = again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    records = keyed.join(again, same, "left").select(
        name("id").alias("record_id"),
        "uri",
        F.col("body").cast("binary").alias("payload"),
        F.when(F.col("first").isNotNull(), name("first")).alias("refers_to"),
    )
    write_archives(records, path, train_dictionary(pages, html))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared checkpoint folder and read the archives back; ``release`` deletes them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/plumbline-warc-{uuid.uuid4().hex}"
    archive_pages(pages, path)
    out = read_archives(spark, path)
    out._plumbline_path = path
    return out
