"""WARC archives with individually compressed records and a Zstandard dictionary.

Writer. A volume (one task's file) starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from
the volume's own records; each record follows as one frame that uses it. Rows reach volumes by a hash, so the records first seen,
up to ``sample_bytes``, are a random sample to build from; the rest streams through. Too few records to train on leave their raw
bytes as dictionary. Files are written by Spark's text sink: its line separator is an empty skippable frame (eight ASCII bytes),
which every decoder passes over, so volumes land wherever Spark can write and failed tasks leave nothing.

Identity. Payloads are identified by SHA-1. The largest id of a digest comes from an aggregate with partial results; ids return to
the rows by equi-joins on (id, digest), so a payload that a third of all pages share is no hot key for the pages themselves.

Reader. Volumes are read as binary files; each is decoded frame by frame, responses are checked against their digests.

Defined cases: a null payload or URL is empty; payloads under ``min_bytes`` are always responses; rows that repeat the largest id with
the same payload are all responses; a null id counts as smaller than any other and is kept; an empty table writes no records and reads
back none. Only id, url and payload are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import keep, same
from tabforge.plans.scale import shared_folder

# Fixed values of the formats.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, volume string"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32: four times 40 bits as eight digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def record_types(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``record_type`` and ``refers_to`` to rows of ``page_id, payload_digest, payload_bytes, ...``."""
    narrow = df.filter(F.col("payload_bytes") >= min_bytes).groupBy("page_id", "payload_digest").agg(F.lit(1).alias("_one"))
    narrow = keep(narrow.drop("_one"))
    first = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("_first"))
    links = narrow.join(first, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("_first")))
    out = same(df, links, ["page_id", "payload_digest"])
    return out.withColumn("refers_to", F.col("_first")).withColumn(
        "record_type", F.when(F.col("_first").isNotNull(), "revisit").otherwise("response")).drop("_first")


def _record(row) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, with the full length, and leaves the payload out."""
    response = row.record_type == "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    block = http + row.payload if response else http
    uri = (row.url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: {_record_id(row.page_id)}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{row.payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if not response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(row.refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(page_id) -> str:
    return "<urn:page:null>" if page_id is None or pd.isna(page_id) else f"<urn:page:{int(page_id)}>"


def _page_id(text: str) -> int | None:
    inner = text.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "null" else int(inner)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples: their bytes are the dictionary
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def _volume(sample_bytes: int, dict_bytes: int, level: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[bytes] = []
        held, packer = 0, None

        def start() -> bytes:
            nonlocal packer
            data = _dictionary(waiting, dict_bytes)
            packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True)
            return DICTIONARY_MAGIC + len(data).to_bytes(4, "little") + data

        for batch in batches:
            frames: list[bytes] = []
            for row in batch.itertuples(index=False):
                record = _record(row)
                if packer is None:
                    waiting.append(record)
                    held += len(record)
                    if held >= sample_bytes:
                        frames.append(start())
                        frames += map(packer.compress, waiting)
                        waiting = []
                else:
                    frames.append(packer.compress(record))
            if frames:
                yield pd.DataFrame({"frame": frames})
        if waiting:
            yield pd.DataFrame({"frame": [start(), *map(packer.compress, waiting)]})

    return write


def write_archives(
    df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = 0, sample_bytes: int = 1 << 20, dict_bytes: int = 1 << 15, level: int = 3,
) -> None:
    """Write one record per row below ``path``. ``sample_bytes`` bounds what a volume's dictionary is built from."""
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")) if dict(df.dtypes)[html] == "string" else F.coalesce(F.col(html), F.lit(b""))
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": sha1_base32(F.col("payload")), "payload_bytes": F.length("payload").cast("long")})
    typed = record_types(rows, min_bytes)
    typed = typed.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    frames = typed.mapInPandas(_volume(sample_bytes, dict_bytes, level), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def _frames(data: bytes) -> Iterator[bytes]:
    """The records of a volume."""
    at, unpacker = 0, zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        magic = bytes(view[at:at + 4])
        if magic[1:] == b"*M\x18" and 0x50 <= magic[0] <= 0x5F:  # a skippable frame
            size = int.from_bytes(view[at + 4:at + 8], "little")
            if magic == DICTIONARY_MAGIC:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size])))
            at += 8 + size
            continue
        one = unpacker.decompressobj()
        # a frame is at most as long as the rest; feed growing pieces so that the rest is not copied for each record
        record, fed = [], at
        while not one.eof:
            if fed >= len(data):
                raise ValueError("a volume ends inside a record")
            piece = view[fed:fed + (1 << 16)]
            record.append(one.decompress(piece))
            fed += len(piece)
        at = fed - len(one.unused_data)
        yield b"".join(record)


def _parse(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return (_page_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload if kind == "response" else None, size, digest, kind,
            _page_id(refers) if refers else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch: int = 256) -> DataFrame:
    """One row per record: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, volume``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

        def pack(rows, volume):
            out = pd.DataFrame(rows, columns=names)
            if not payloads:
                out["payload"] = None
            return out.astype({"page_id": "Int64", "refers_to": "Int64"}).assign(volume=volume)

        for files in batches:
            for volume, content in zip(files["path"], files["content"]):
                rows = []
                for record in _frames(content):
                    rows.append(_parse(record))
                    if len(rows) == batch:
                        yield pack(rows, volume)
                        rows = []
                if rows:
                    yield pack(rows, volume)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInPandas(read, READ_SCHEMA)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex,
    array_to_string([array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(sha1(html), 1 + 5 * g::INT, 5))::BIGINT
      // (32 ** (3 - i))::BIGINT) % 32)::INT + 1] for i in range(0, 4)], '') for g in range(0, 8)], '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER (PARTITION BY hex) THEN max(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM h
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
