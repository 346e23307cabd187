"""Chunking of long texts, archives, and files as fragments."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FRAGMENT

CHUNK, LOOKAHEAD = 100_000, 25_000
_SPACE = b"\n \t\r\f\v"
_BLANK = re.compile(rb"\n[ \t\r\f\v]*\n")


def chunks(data: bytes):
    """(start line, piece): CHUNK bytes and, if they don't end with a blank line, up to LOOKAHEAD more, to the next one."""
    at, line = 0, 1
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            head = data[at:end]
            if head[len(head.rstrip(_SPACE)) :].count(b"\n") < 2:  # it doesn't end with a blank line yet
                tail = _BLANK.search(data, max(at, end - 1), min(len(data), end + LOOKAHEAD))
                end = tail.end() if tail else min(len(data), end + LOOKAHEAD)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1  # don't cut a character
        piece = data[at:end]
        yield line, piece
        line += piece.count(b"\n")
        at = end


def members(name: str, data: bytes, depth: int):
    """(path, bytes) of a file; archives and compressed files open up to `depth` levels, joined by `!`."""
    if depth > 0:
        inner = _open(name, data)
        if inner is not None:
            try:
                for path, content in inner:
                    yield from members(f"{name}!{path}", content, depth - 1)
                return
            except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, ValueError):
                return  # a broken archive is skipped
    yield name, data


def _open(name: str, data: bytes):
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        z = zipfile.ZipFile(io.BytesIO(data))
        return ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    if data[257:262] == b"ustar":
        t = tarfile.open(fileobj=io.BytesIO(data))
        return ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
    base = name.rpartition("/")[2].rpartition("!")[2]
    stem = re.sub(r"\.(?:gz|bz2|xz|lzma|zst)$", "", re.sub(r"\.tgz$", ".tar", base)) or "content"
    for magic, unpack in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ\x00", lzma.decompress)):
        if data.startswith(magic):
            return ((stem, unpack(data)) for _ in (0,))
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return ((stem, zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()) for _ in (0,))
    return None


def _rows(name: str, data: bytes, attributes: dict, depth: int):
    for path, content in members(name, data, depth):
        first = True
        pieces = list(chunks(content)) or [(1, b"")]
        for line, piece in pieces:
            yield {"fragment_id": f"{path}:{line}", "raw": piece.decode("utf-8", "replace"), "start_line": line, "attributes": list((attributes | {"path": path, "fs.first_fragment": str(first).lower()}).items())}
            first = False


_ARROW = pa.schema([("fragment_id", pa.string()), ("raw", pa.string()), ("start_line", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string()))])


def contents_to_fragments(files: DataFrame, archive_depth: int = 0, resource: str = "fs.file") -> DataFrame:
    """(path, content) rows as fragments: chunked, archives opened."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(_rows(path, content or b"", {"resource": resource}, archive_depth))
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 64], schema=_ARROW)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, FRAGMENT)


def text_to_fragments(df: DataFrame, key: str, text: str, table_name: str) -> DataFrame:
    """Rows with long texts as chunks; the path is table/key."""
    path = F.concat(F.lit(f"{table_name}/"), F.col(key).cast("string"))
    return contents_to_fragments(df.select(path.alias("path"), F.col(text).alias("content")), resource="table.row")


def read_files(spark: SparkSession, root: str, archive_depth: int = 0, most_bytes: int | None = None, glob: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder of any store Spark reads; size and path filters reach the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    if most_bytes is not None:
        files = files.where((F.col("length") <= most_bytes) & (F.col("length") > 0))
    clean = F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/")
    files = files.withColumn("path", clean)
    if excluded:
        files = files.where(~F.col("path").isin(*excluded))
    return contents_to_fragments(files, archive_depth)


def read_objects(spark: SparkSession, url: str, archive_depth: int = 0, most_bytes: int = 250 << 20) -> DataFrame:
    """Objects of an S3-like store (s3a://...): no empty ones, no folders, none over the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    files = files.where((F.col("length") > 0) & (F.col("length") <= most_bytes) & ~F.col("path").endswith("/"))
    return contents_to_fragments(files, archive_depth, "s3.object")


def stdin_fragments(spark: SparkSession, data: bytes, attributes: dict[str, str] | None = None) -> DataFrame:
    """What was read from standard input, with attributes the caller sets."""
    rows = [(f"stdin:{line}", piece.decode("utf-8", "replace"), line, {"resource": "stdin"} | (attributes or {})) for line, piece in chunks(data)]
    return spark.createDataFrame(rows, FRAGMENT)
