"""Zstandard web archives: one record per frame, with the dictionary in a leading skippable frame.

Pages with equal payloads become one response record (the largest page id) and revisit records that refer to
it. Archives are files of about ARCHIVE_BYTES, written beside each other in a folder that all executors share;
a file gets its final name only when it is whole, and names and contents depend on the partition alone, so a
task that runs again replaces what it wrote.

The reader takes any folder of .warc.zst files. It loads the dictionary from the leading skippable frame, be it plain
or compressed, passes over other skippable frames, reads a file in pieces and decodes one frame at a time. Every frame
must hold one record with the headers that are asked of it, of the length it tells, and with payload and block of the
SHA-1 it tells; anything else is a ValueError that names the file. Record types, identifiers and header names (in any
case) are free.

Defined results: null html is an empty payload; very long payloads are one record and one frame; pages without an id
are revisits of an equal page that has one, else responses; ties: rows that repeat an id and a payload are each a
record of one type; an empty table has no archives, and a folder without archives no records; columns beside
page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, scratch_path

#: Payloads under this many bytes are always responses.
LEAST_REVISIT_BYTES = 0
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on at most this many pages, those with the smallest hashed ids.
SAMPLE_PAGES, DICT_BYTES, LEVEL = 400, 32 << 10, 3
#: Magic numbers: of the dictionary's skippable frame, of any skippable frame (the first of 16), of a frame.
SKIPPABLE, ANY_SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, b"\x28\xb5\x2f\xfd"
PIECE = 1 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def roles(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest (hex) and refers_to (null for responses).

    Only payloads that occur more than once are joined back; Spark splits the join of a payload that many
    pages share, as one side has a single row for it.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    many = (
        base.where(F.octet_length("html") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "keeper")
    )
    joined = base.join(many, "digest", "left")
    return joined.select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to")
    )


def train(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty if there are too few to train on."""
    ids = pages.select(F.col("page_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PAGES)
    rows = pages.select("page_id", "html").join(F.broadcast(ids), F.col("page_id") == F.col("_id"), "left_semi").where("html is not null")
    samples = [r["html"].encode("utf-8", "replace") for r in sorted(rows.limit(SAMPLE_PAGES).collect())]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b""


def _identity(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record: header lines, the HTTP head, the payload (not for a revisit) and the two closing line breaks."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = (url or _identity(page_id)[1:-1]).replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_identity(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_identity(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space continues the one before."""
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            found[name] += " " + line.strip()
            continue
        name, mark, value = line.partition(":")
        name = name.strip().lower()
        if not mark or not name:
            raise ValueError(f"not a header: {line[:80]!r}")
        found.setdefault(name, value.strip())
    return found


def _agrees(told: str | None, data: bytes) -> bool:
    """Whether a told SHA-1, in base32 or in hex, is that of the data; other algorithms aren't checked."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() != "sha1":
        return True
    own = hashlib.sha1(data)
    return value.upper() == base64.b32encode(own.digest()).decode() or value.lower() == own.hexdigest()


def parse(raw: bytes) -> dict:
    """A record of any type; ValueError if its headers, lengths or digests are wrong.

    payload_bytes is what the HTTP head tells for a revisit, and the payload's length else.
    """
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(lines[1:])
    if missing := [k for k in REQUIRED if not fields.get(k)]:
        raise ValueError(f"missing headers: {missing}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block has {len(rest) - 4} bytes")
    block = rest[:size]
    if not _agrees(fields.get("warc-block-digest"), block):
        raise ValueError("the block differs from its digest")
    kind, payload, told = fields["warc-type"].lower(), block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("no HTTP head")
        inner = _fields(http.decode("utf-8", "replace").split("\r\n")[1:])
        if inner.get("content-length", "").isdigit() and "transfer-encoding" not in inner:
            told = int(inner["content-length"])
    if kind == "revisit":
        if payload or "warc-profile" not in fields:
            raise ValueError("bad revisit record")
    elif told is not None and told != len(payload):
        raise ValueError(f"the payload has {len(payload)} bytes, its head tells {told}")
    elif not _agrees(fields.get("warc-payload-digest"), payload):
        raise ValueError("the payload differs from its digest")
    return {
        "record_type": kind,
        "record_id": fields["warc-record-id"],
        "record_date": fields["warc-date"],
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "content_type": fields.get("content-type"),
        "payload_bytes": told if kind == "revisit" else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "payload": None if kind == "revisit" else payload,
    }


class _Source:
    """A stream read in pieces, of which the front can be looked at."""

    def __init__(self, stream):
        self.stream, self.held, self.at = stream, b"", 0

    def has(self, n: int) -> bool:
        """Whether n bytes are left, now held together."""
        while len(self.held) - self.at < n:
            more = self.stream.read(max(PIECE, n))
            if not more:
                return False
            self.held, self.at = self.held[self.at :] + more, 0
        return True

    def take(self, n: int) -> bytes:
        data = self.held[self.at : self.at + n]
        self.at += len(data)
        return data


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    """A dictionary, which may be a frame itself."""
    if data[:4] == FRAME:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def frames(source):
    """Decoded frames of an archive (bytes or a stream), in order; the dictionary comes from the leading skippable frame."""
    source = _Source(io.BytesIO(source) if isinstance(source, bytes) else source)
    context, leading = zstandard.ZstdDecompressor(), True
    while source.has(1):
        if source.has(8) and (magic := struct.unpack_from("<I", source.held, source.at)[0]) & ~0xF == ANY_SKIPPABLE:
            size = struct.unpack("<II", source.take(8))[1]
            if leading and magic == SKIPPABLE:
                if not source.has(size):
                    raise ValueError("the dictionary frame is cut off")
                context = zstandard.ZstdDecompressor(dict_data=_dictionary(source.take(size)))
            else:
                while size:
                    if not source.has(1):
                        raise ValueError("a skippable frame is cut off")
                    size -= len(source.take(min(size, PIECE)))
            leading = False
            continue
        leading = False
        decoder, parts = context.decompressobj(), []
        while not decoder.eof:
            if not source.has(1):
                raise ValueError("the last frame is cut off")
            parts.append(decoder.decompress(source.take(32768)))
        source.at -= len(decoder.unused_data)
        yield b"".join(parts)


def _place(uri: str):
    from pyarrow import fs

    # Spark names local files with one slash.
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _write_rows(folder: str, dictionary: bytes):
    def run(batches):
        from pyspark import TaskContext

        store, root = _place(folder)
        part = TaskContext.get().partitionId()
        lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
        packer = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True
        )
        done, held, records, size = 0, [lead], 0, len(lead)

        def close():
            nonlocal done, held, records, size
            name = posixpath.join(root, f"part-{part:05d}-{done:05d}.warc.zst")
            rough = f"{name}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(rough, compression=None) as out:
                out.write(b"".join(held))
            store.move(rough, name)
            row = pa.RecordBatch.from_pydict({"file": [posixpath.basename(name)], "records": [records], "bytes": [size]})
            done, held, records, size = done + 1, [lead], 0, len(lead)
            return row

        for batch in batches:
            # A few rows of a batch at a time are Python objects.
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    data = packer.compress(record(row["page_id"], row["url"], row["html"].encode("utf-8", "replace"), row["refers_to"]))
                    held.append(data)
                    records += 1
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        yield close()
        if records:
            yield close()
        release()

    return run


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None = None) -> DataFrame:
    """Write the pages to archives in the folder; (file, records, bytes) of each. Runs at once."""
    spark = pages.sparkSession
    dictionary = train(pages) if dictionary is None else dictionary
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    rows = roles(pages).select("page_id", "url", "html", "refers_to").sortWithinPartitions("page_id", "url", F.xxhash64("html"))
    return materialise(rows.mapInArrow(_write_rows(folder, dictionary), "file string, records long, bytes long"), "manifest")


RECORDS = "file string, record_type string, record_id string, record_date string, target_uri string, refers_to string, content_type string, payload_bytes long, payload_digest string"


def _read_rows(with_payload: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload
    types = [pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string() for c in names]

    def run(batches):
        for batch in batches:
            for path, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _place(path)
                seen, rows, size = 0, [], 0
                with store.open_input_stream(name, compression=None) as source:
                    try:
                        for raw in frames(source):
                            row = parse(raw) | {"file": posixpath.basename(name)}
                            if not with_payload:
                                del row["payload"]
                            rows.append(row)
                            seen, size = seen + 1, size + len(raw)
                            if len(rows) >= 512 or (with_payload and size >= 16 << 20):
                                yield _batch(rows)
                                rows, size = [], 0
                    except (ValueError, zstandard.ZstdError) as e:
                        raise ValueError(f"{path}, record {seen}: {e}") from e
                if told is not None and seen != told:
                    raise ValueError(f"{path} has {seen} records, not {told}")
                if rows:
                    yield _batch(rows)
        release()

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, with_payload: bool = False) -> DataFrame:
    """Records of all .warc.zst files under a folder; of those a manifest(file, records) lists, if one is given, which
    must then have that many records each."""
    if manifest is None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.zst").load(folder)
        files = listed.select("path", F.lit(None).cast("long").alias("records"))
    else:
        files = manifest.select(F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("path"), "records")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(_read_rows(with_payload), RECORDS + ", payload binary" * with_payload)


def of_pages(records: DataFrame) -> DataFrame:
    """Response and revisit records with page_id, and refers_to as one: identifiers that `record` gave back as ids."""
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    rows = records.where(F.col("record_type").isin("response", "revisit")).withColumns({"page_id": page("record_id"), "refers_to": page("refers_to")})
    return rows.withColumnRenamed("target_uri", "url")


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: (page_id, url, payload_bytes,
    payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder)
    found = of_pages(read_archives(spark, folder, manifest, with_payload))
    return found.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload)
