"""Operator 1: Zstandard WARC archives, one frame per record, dictionary in a leading skippable frame.

Null payloads are written as empty ones; null urls and null keys are left out of the headers and come back null. Rows
whose key is null are always responses. Rows that repeat a key and a payload are all responses when that key is the
smallest of its group. Carriage returns and line feeds in urls are percent-encoded in headers and restored. Extra
columns of the input are ignored. Very long payloads are one record and one frame each, up to 1 GiB, beyond which reading
fails. An empty table makes no archive and gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_keys, shared_dir, sheltered, written

SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
MANIFEST_SCHEMA = "archive string, archive_bytes long, records long"


class WarcError(ValueError):
    """An archive that breaks the format: bad frame, bad header, wrong length or wrong digest."""


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _quote(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unquote(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record(row, number: str) -> bytes:
    """One WARC/1.1 record: header lines, blank line, block, two line ends. number: its place among all records written."""
    payload = row.payload.encode("utf-8", "surrogatepass") if row.payload is not None else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row.payload_bytes
    if row.record_type == "response":
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row.record_type}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number}/{row.key}/{row.url}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{row.payload_digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {row.payload_bytes}",
        f"Content-Length: {len(block)}",
    ]
    if row.url is not None:
        head.append(f"WARC-Target-URI: {_quote(row.url)}")
    if row.key is not None:
        head.append(f"X-Record-Key: {row.key}")
    if row.record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Key: {row.refers_to}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF + CRLF + block + CRLF + CRLF


def _dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary trained on the first records of an archive; none where there is too little to learn from."""
    samples = [r[:8192] for r in records if len(r) >= 64]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes], level: int = 3, dict_size: int = 16384, dict_records: int = 200) -> bytes:
    """An archive of records: a skippable frame with the dictionary, if there is one, then a frame for each record."""
    learned = _dictionary(records[:dict_records], dict_size)
    out = []
    if learned:
        plain = zstandard.ZstdCompressor(level=9).compress(learned)
        out.append(struct.pack("<II", SKIPPABLE_DICTIONARY, len(plain)) + plain)
    made = zstandard.ZstdCompressionDict(learned) if learned else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=True, write_checksum=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"bad version line {lines[0]!r}")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line!r}")
        found[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in found:
            raise WarcError(f"no {need} header")
    if not found["content-length"].isdigit():
        raise WarcError("bad content-length")
    return found


def _parsed(record: bytes) -> dict:
    """The row of one decoded record, after its headers, lengths and digests have been checked."""
    head, blank, rest = record.partition(CRLF + CRLF)
    if not blank:
        raise WarcError("no end of headers")
    h = _headers(head)
    length = int(h["content-length"])
    if len(rest) != length + 4 or rest[length:] != CRLF + CRLF:
        raise WarcError(f"content-length {length} but {len(rest) - 4} bytes of block")
    block = rest[:length]
    if "warc-block-digest" in h and h["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise WarcError("wrong block digest")
    _, _, payload = block.partition(CRLF + CRLF)
    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(h.get("x-payload-length", len(payload)))
    if kind == "response":
        if len(payload) != size:
            raise WarcError(f"payload length {size} but {len(payload)} bytes")
        actual = hashlib.sha256(payload).hexdigest()
        if digest and digest != actual:
            raise WarcError("wrong payload digest")
        digest = actual
    elif payload:
        raise WarcError("revisit with a payload")
    key, refers, url = h.get("x-record-key"), h.get("x-refers-to-key"), h.get("warc-target-uri")
    return {
        "page_id": None if key is None else int(key), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": None if refers is None else int(refers), "url": None if url is None else _unquote(url),
        "payload": payload.decode("utf-8", "surrogatepass") if kind == "response" else None,
    }


def iter_records(stream, chunk: int = 1 << 16, most: int = 1 << 30) -> Iterator[bytes]:
    """Decoded records of an archive, read in chunks: memory holds a chunk and the record at hand, not the archive.

    What follows a frame in its chunk is copied once for each frame, so chunks are small. A record beyond `most` bytes fails.
    """
    data = b""
    dictionary = None
    first = True
    more = True
    unpack = None
    parts: list[bytes] = []
    held = 0
    while True:
        if len(data) < 8 and more:
            got = stream.read(chunk)
            more = bool(got)
            data += got
            continue
        if not data and unpack is None:
            return
        if unpack is None:
            (magic,) = struct.unpack("<I", data[:4]) if len(data) >= 8 else (0,)
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                (size,) = struct.unpack("<I", data[4:8])
                while len(data) < 8 + size and more:
                    got = stream.read(chunk)
                    more = bool(got)
                    data += got
                body = data[8 : 8 + size]
                if len(body) < size:
                    raise WarcError("cut skippable frame")
                if first and magic == SKIPPABLE_DICTIONARY:
                    raw = zstandard.ZstdDecompressor().decompress(body) if body[:4] == ZSTD_FRAME else body
                    dictionary = zstandard.ZstdCompressionDict(raw)
                data = data[8 + size :]
                first = False
                continue
            if data[:4] != ZSTD_FRAME:
                raise WarcError("not a frame")
            first = False
            unpack = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            parts, held = [], 0
        try:
            parts.append(unpack.decompress(data))
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        held += len(parts[-1])
        if held > most:
            raise WarcError(f"a record of more than {most} bytes")
        if unpack.eof:
            data = unpack.unused_data
            unpack = None
            yield b"".join(parts)
        else:
            data = stream.read(chunk)
            more = bool(data)
            if not more:
                raise WarcError("cut frame")


def _frame(out: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=names, dtype=object).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 100) -> DataFrame:
    """Rows to archive: each with its digest, and whether it is a response or revisits the smallest key of its payload.

    The resolution moves only digests and keys. Digests that hold over 1/400 of the rows are resolved by a broadcast of
    their (bounded number of) smallest keys, all others by a join on the digest.
    """
    sheltered(pages, key, url, payload)
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload")).select(
        "key", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    able = rows.where((F.col("payload_bytes") >= min_revisit) & F.col("key").isNotNull()).select("key", F.col("payload_digest").alias("digest"))
    groups = able.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    heavy = groups.join(F.broadcast(heavy_keys(able, "digest").select("digest")), "digest", "left_semi").select(F.col("digest").alias("heavy_digest"), F.col("least").alias("heavy_least"))
    marked = rows.join(F.broadcast(heavy), rows.payload_digest == F.col("heavy_digest"), "left")
    # heavy rows get a key of their own each, so that the join below does not gather them
    eligible = (F.col("payload_bytes") >= min_revisit) & F.col("key").isNotNull() & F.col("heavy_digest").isNull()
    keyed = marked.withColumn("on_digest", F.when(eligible, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("key"), F.xxhash64("url", "payload_digest")).cast("string"))))
    light = groups.select(F.col("digest").alias("light_digest"), F.col("least").alias("light_least"))
    least = F.when(F.col("heavy_digest").isNotNull(), F.when((F.col("payload_bytes") >= min_revisit) & F.col("key").isNotNull(), F.col("heavy_least"))).otherwise(F.col("light_least"))
    joined = keyed.join(light, F.col("on_digest") == F.col("light_digest"), "left").withColumn("least", least)
    revisit = F.coalesce(F.col("least") < F.col("key"), F.lit(False))
    return joined.select(
        "key", "url", F.when(revisit, F.lit(None).cast("string")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("least")).alias("refers_to"),
    )


def write_archives(rows: DataFrame, folder: str, roll_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """Writes the planned rows as archives of about roll_bytes of raw records; returns the manifest as a written table.

    Every partition and attempt writes files of its own name, and the manifest names those of the attempts that succeeded,
    so lost executors and speculative copies leave at most unlisted files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        # a task may run this for several partitions, in one process: only a name of its own keeps their files apart
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        held: list[bytes] = []
        size, made = 0, []

        def roll() -> None:
            nonlocal held, size
            path = f"{base}/{name}-{len(made):04d}.warc.zst"
            data = archive_bytes(held, level)
            with fs.open_output_stream(path, compression=None) as out:
                out.write(data)
            made.append((path, len(data), len(held)))
            held, size = [], 0

        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            for row in batch.itertuples(index=False):
                held.append(_record(row, f"{name}/{len(made)}/{len(held)}"))
                size += len(held[-1])
                if size >= roll_bytes:
                    roll()
        if held:
            roll()
        yield pd.DataFrame(made, columns=["archive", "archive_bytes", "records"])

    # keys travel as text: pandas would make long columns with nulls inexact
    texts = rows.withColumns({c: F.col(c).cast("string") for c in ("key", "refers_to")})
    return written(texts.mapInPandas(write, MANIFEST_SCHEMA), "manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives of the manifest, validated; the number of records must be the manifest's."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _file_system(folder)
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                out, size, seen = [], 0, 0
                with fs.open_input_stream(row.archive, compression=None) as stream:
                    for record in iter_records(stream):
                        one = _parsed(record)
                        seen += 1
                        if not with_payload:
                            one["payload"] = None
                        out.append(one)
                        size += len(record)
                        if size > 4 << 20 or len(out) >= 5000:
                            yield _frame(out, names)
                            out, size = [], 0
                if out:
                    yield _frame(out, names)
                if seen != row.records:
                    raise WarcError(f"{row.archive}: {seen} records, {row.records} expected")

    return manifest.repartition(max(1, min(manifest.count(), 100_000)), "archive").mapInPandas(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", with_payload: bool = True, roll_bytes: int = 16 << 20) -> DataFrame:
    """Archives the table in the shared folder and returns what reading the archives gives."""
    folder = f"{shared_dir(pages.sparkSession)}/warc"
    manifest = write_archives(planned(pages, key, url, payload), folder, roll_bytes)
    return read_archives(manifest, folder, with_payload)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), with_payload=False, roll_bytes=4 << 20)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS least FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.least < d.page_id AND d.payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.least < d.page_id AND d.payload_bytes >= 100 THEN g.least END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""
}
