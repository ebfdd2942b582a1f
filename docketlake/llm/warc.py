"""WARC archives in Zstandard, one frame per record, with a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; after it comes one frame per record. Archives are written by the
tasks into a shared folder under names fixed by partition and sequence, by way
of a temporary name, so a repeated task replaces its own files. They are read
with Spark's binary reader, record by record, and every header block, length
and digest is checked.

Of payloads that agree and have at least 100 bytes, the record of the smallest
page id is the response and the others are revisits of it; rows that repeat
that page id are responses too. Null html is an empty payload; a null url or
page id leaves its header out, and where all ids of a payload are null there is
nothing to refer to, so all are responses. An empty table gives no archive and
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.storage import new_path, staged

MAGIC = 0x184D2A5D
MIN_REVISIT_BYTES = 100
#: Archives roll over at this many compressed bytes.
ARCHIVE_BYTES = 4 << 20
#: The dictionary is fitted to the starts of at most so many pages.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4096, 64 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# ---- one record -------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no block and says what its payload was."""
    block = payload if kind == "response" else b""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    headers += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, or ValueError if it isn't well formed."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC header block")
    headers: dict[str, str] = {}
    for line in head.decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise ValueError(f"headers missing: {sorted(missing)}")
    if not headers["content-length"].isdigit():
        raise ValueError("bad Content-Length")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} does not fit the record")
    block = rest[:length]
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers:
        if headers["warc-payload-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError("payload digest differs")
        if int(headers.get("x-payload-length", length)) != length:
            raise ValueError("payload length differs")
    return headers, block


# ---- one archive ------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def load_dictionary(archive: bytes) -> tuple[bytes, int]:
    """(dictionary, where the records start); the dictionary may itself be a Zstandard frame."""
    import zstandard

    if len(archive) < 8 or struct.unpack_from("<I", archive)[0] != MAGIC:
        return b"", 0
    size = struct.unpack_from("<I", archive, 4)[0]
    if 8 + size > len(archive):
        raise ValueError("the dictionary frame is cut short")
    raw = archive[8 : 8 + size]
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw, 8 + size


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record of an archive; one frame is decoded at a time."""
    import zstandard

    dictionary, at = load_dictionary(archive)
    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    decompressor = zstandard.ZstdDecompressor(**known)
    view = memoryview(archive)
    while at < len(archive):
        if archive[at + 1 : at + 4] == b"\x2a\x4d\x18" and 0x50 <= archive[at] <= 0x5F:  # any other skippable frame
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            continue
        frame = decompressor.decompressobj()
        out, step = [], 1 << 16
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("the last frame is cut short")
            chunk = view[at : at + step]
            out.append(frame.decompress(chunk))
            at += len(chunk)
        at -= len(frame.unused_data)
        yield parse_record(b"".join(out))


class _Archives:
    """Writes records of one task into archives that roll over by size."""

    def __init__(self, folder: str, part: int, dictionary: bytes):
        import zstandard

        self.folder, self.part, self.seq, self.dictionary = folder, part, 0, dictionary
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compressor, self.out = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **known), None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.out = io.BytesIO()
            self.out.write(dictionary_frame(self.dictionary) if self.dictionary else b"")
        self.out.write(self.compressor.compress(record))
        if self.out.tell() >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        name = f"part-{self.part:05d}-{self.seq:05d}.warc.zst"
        _put(self.folder, name, self.out.getvalue())
        self.out, self.seq = None, self.seq + 1


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder in one step; a repeated task writes the same bytes again."""
    parsed = urllib.parse.urlparse(folder)
    temporary = f".{name}.{uuid.uuid4().hex}"
    if parsed.scheme in ("", "file"):
        path = urllib.parse.unquote(parsed.path)
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{temporary}", "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}/{temporary}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{temporary}") as f:
        f.write(data)
    store.move(f"{path}/{temporary}", f"{path}/{name}")


# ---- over Spark -------------------------------------------------------------


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary fitted to the starts of a bounded, seeded sample of pages; empty if there are too few."""
    import zstandard

    picked = pages.select(F.xxhash64(F.col("page_id")).alias("h"), F.substring(F.col(html), 1, SAMPLE_CHARS).alias("t")).filter(F.length("t") > 64)
    # First which pages, by eight bytes each, so that tasks don't send the driver a sample apiece.
    chosen = [r["h"] for r in picked.select("h").orderBy("h").limit(SAMPLE_PAGES).collect()]
    texts = picked.filter(F.col("h") <= chosen[-1]).limit(2 * SAMPLE_PAGES).collect() if chosen else []
    samples = [t.encode() for t in sorted(r["t"] for r in texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # samples too alike or too short for a dictionary
        return b""


def with_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, record_type and refers_to of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    large = F.octet_length("html") >= MIN_REVISIT_BYTES
    first = rows.filter(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(staged(first, "payloads"), "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, dictionary: bytes = b"") -> int:
    """Write a record per row of ``with_records`` into archives in ``folder``; returns their number."""

    def write(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = _Archives(folder, TaskContext.get().partitionId(), dictionary)
        for part in parts:
            for row in part.itertuples(index=False):
                page_id = None if pd.isna(row.page_id) else int(row.page_id)
                refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                archives.add(build_record(page_id, row.url, row.html.encode(), row.payload_digest, row.record_type, refers))
        archives.close()
        yield pd.DataFrame({"n": [archives.seq]})

    # Ids as text: a long column with nulls would pass through double.
    as_text = pages.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    ordered = as_text.sortWithinPartitions("page_id", "payload_digest", "url")  # a repeated task must fill the same archives
    return ordered.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives in ``folder``."""

    def read(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                rows = []
                for headers, block in read_records(bytes(content)):
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
                    row = (page, int(headers.get("x-payload-length", len(block))), headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"], refers)
                    rows.append((*row, headers.get("warc-target-uri"), block.decode()) if with_payload else row)
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if with_payload else [])])

    schema = RECORD.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string") + ", url string, payload string" * with_payload
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content").mapInPandas(read, schema)
    return rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages into archives in the shared folder, then read them back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    written = write_archives(with_records(pages), folder, train_dictionary(pages))
    if not written:
        return spark.createDataFrame([], RECORD)
    return read_archives(spark, folder)
