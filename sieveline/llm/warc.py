"""WARC archives with a two-level capture index (operator 1).

Writing: records are gzip members, one after another; an archive is the records of one task. Archives are kept
as rows (archive, offset, content) of about SEGMENT bytes that begin and end with a record, in Parquet files
that Spark commits, so any store works; the contents of an archive's rows in order are a .warc.gz file.
Index: one line per record - reversed-host URL key, capture id, archive, row of the archive, offset, length - sorted
by key over the whole corpus by range partitioning, cut into blocks of LINES lines, each block compressed. The sparse
directory has the first key of each block.
Reading (`lookup`): a table of URL keys is searched by bisection in the directory, which comes to the tasks in slices of
at most SLICE entries; then in the blocks, each opened once for all of its keys; and the ranges so found are cut out of
the archives, each row of which is read once for all of its ranges. The query reads every record back this way.
Of records with equal payloads, the one with the smallest id is the response, and the others are revisits that
refer to it and hold no payload. Payloads are grouped by SHA-256; pages themselves are not shuffled unless the
table of repeated payloads is too large to be sent to every task.

Results for edge cases: a null html is an empty payload, an empty payload counts as any other; a null url has
the empty key; a null page_id comes after all others; rows that repeat a page_id with equal payloads are all
the response if theirs is the smallest id; columns besides page_id, url and html are ignored; an empty table
gives no records and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, new_path, stage, table

SEGMENT = 1 << 20
LINES = 1024
SLICE = 200_000  # entries of the directory that are sent to tasks at a time; one stands for LINES captures
CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """http://www.Example.com:80/a?b -> com,example)/a?b; captures of a site sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "://" in url else f"http://{url}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_response: bool) -> bytes:
    """The gzip member of one record."""
    kind = "response" if is_response else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if not is_response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2) + z.flush()


def parse_record(data: bytes) -> dict:
    """One uncompressed record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    The digest of a response is computed from its payload and must agree with its header.
    """
    head, _, rest = data.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(CRLF * 2)
    size = int(next(x for x in http.split(CRLF) if x.lower().startswith(b"content-length:")).partition(b":")[2])
    kind = fields[b"warc-type"].decode()
    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields[b'warc-record-id'].decode()} does not match its header")

    def urn(name):
        text = fields.get(name, b"").decode().removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {"page_id": urn(b"warc-record-id"), "url": json.loads(f'"{fields[b"warc-target-uri"].decode()}"'), "record_type": kind, "refers_to": urn(b"warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


def members(content: bytes, piece: int = 1 << 14):
    """(offset, length, data) of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts, to = zlib.decompressobj(31), [], at
        while not z.eof:
            if to >= len(view):
                raise ValueError(f"the gzip member at byte {at} is cut off")
            fed = view[to : to + piece]
            parts.append(z.decompress(fed))
            to += len(fed)
        end = to - len(z.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


ARCHIVE = "archive string, offset bigint, content binary"
CAPTURES = "captures array<struct<url:string,page_id:bigint,offset:bigint,length:bigint>>"


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, first_id: first_id is the smallest page_id with that payload, null if no other page has it."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(stage(same, "payloads"), "digest", "left").drop("digest")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write path/archives: a record for each row of (page_id, url, html); beside each row of an archive, where its records stand."""
    kind = pa.list_(pa.struct([("url", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        name = f"capture-{TaskContext.get().partitionId():06d}.warc.gz"
        held, listed, size, offset = [], [], 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([offset], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([listed], kind)], names=["archive", "offset", "content", "captures"])

        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(page_id, url, payload, first, first is None or first == page_id)
                held.append(data)
                listed.append({"url": url, "page_id": page_id, "offset": size, "length": len(data)})
                size += len(data)
                if size >= SEGMENT:
                    yield flush()
                    held, listed, size, offset = [], [], 0, offset + size
        if held:
            yield flush()

    marked(pages).select("page_id", "url", "payload", "first_id").mapInArrow(run, f"{ARCHIVE}, {CAPTURES}").write.parquet(f"{path}/archives")


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
_KINDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "archive": pa.string(), "segment": pa.int64(), "offset": pa.int64(), "length": pa.int64()}


def records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives, with where it stands (archive, row, offset in the row); with payload if asked for."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads, "archive", "segment", "offset", "length"]

    def kernel(batch):
        for archive, start, content in zip(*(c.to_pylist() for c in batch.columns)):
            rows = [parse_record(data) | {"archive": archive, "segment": start, "offset": at, "length": length} for at, length, data in members(content)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[n]) for n in names], names=names)

    schema = RECORD + (", payload binary" if payloads else "") + ", archive string, segment bigint, offset bigint, length bigint"
    return spark.read.schema(ARCHIVE).parquet(f"{path}/archives").mapInArrow(arrow_map(kernel), schema)


INDEX = "block string, first_key string, n int, lines binary"
ENTRY = "page_id bigint, archive string, segment bigint, offset bigint, length bigint"


def keyed(rows: DataFrame, *others: str) -> DataFrame:
    """`rows` of (url, others) with `key` in place of `url`."""

    def keys(batch):
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), *batch.columns[1:]], names=["key", *batch.schema.names[1:]])

    fields = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in others)
    return rows.select("url", *others).mapInArrow(arrow_map(keys), f"key string{fields}")


def write_index(spark: SparkSession, path: str) -> None:
    """Write path/index from what the archives list of their records; their contents are not read."""

    def blocks(batches):
        from pyspark import TaskContext

        part, count, held = TaskContext.get().partitionId(), 0, []

        def flush():
            lines = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{count:06d}"]), pa.array([held[0][0]]), pa.array([len(held)], pa.int32()), pa.array([lines], pa.binary())], names=["block", "first_key", "n", "lines"])

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(line)
                if len(held) == LINES:
                    yield flush()
                    held, count = [], count + 1
        if held:
            yield flush()

    names = ["page_id", "archive", "segment", "offset", "length"]
    order = [F.col(c) for c in ("key", *names)]
    listed = spark.read.schema(f"archive string, offset bigint, {CAPTURES}").parquet(f"{path}/archives")
    listed = listed.select("archive", F.col("offset").alias("segment"), F.explode("captures").alias("c")).select("c.url", "c.page_id", "archive", "segment", "c.offset", "c.length")
    lines = keyed(listed, *names)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, INDEX).write.parquet(f"{path}/index")


def _slices(directory: DataFrame, size: int):
    """The sorted directory as lists of (first_key, block) of at most `size` + 1, and whether more follow; the next list starts with the last entry."""
    held: list[tuple[str, str]] = []
    for row in directory.orderBy("first_key", "block").toLocalIterator():
        held.append((row["first_key"], row["block"]))
        if len(held) > size:
            yield held, True
            held = held[-1:]
    if held:
        yield held, False


def blocks_of(spark: SparkSession, path: str, keys: DataFrame, size: int = SLICE) -> DataFrame:
    """(block, key): the blocks that may hold each key, by bisection; captures of one key can go on over several."""
    directory = spark.read.schema(INDEX).parquet(f"{path}/index").select("first_key", "block")
    found = spark.createDataFrame([], "block string, key string")
    for entries, more in _slices(directory, size):
        firsts, names = [x for x, _ in entries], [x for _, x in entries]

        def kernel(batch, firsts=firsts, names=names, last=len(entries) - more):
            blocks, of = [], []
            for key in batch.column(0).to_pylist():
                low, high = max(0, bisect_left(firsts, key) - 1), min(last, bisect_right(firsts, key))
                blocks += names[low:high]
                of += [key] * max(0, high - low)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(of, pa.string())], names=["block", "key"])

        found = found.unionByName(keys.select("key").mapInArrow(arrow_map(kernel), "block string, key string"))
    return found.distinct()


def captures(spark: SparkSession, path: str, keys: DataFrame, size: int = SLICE) -> DataFrame:
    """key, page_id, archive, segment, offset, length of each capture of the keys (distinct), from the index."""

    def kernel(batch):
        for lines, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = [json.loads(x) for x in zlib.decompress(lines).decode().split("\n")]
            found = [x for key in wanted for x in lines[bisect_left(lines, key, key=_first) : bisect_right(lines, key, key=_first)]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found) if found else [()] * 6, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "page_id", "archive", "segment", "offset", "length"])

    found = blocks_of(spark, path, keys, size)
    # keys that no block holds may gather at one: it is then opened for some 4 * LINES keys at a time
    parts = found.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (4 * LINES)).alias("parts"))
    dealt = found.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    wanted = dealt.groupBy("block", "part").agg(F.collect_list("key").alias("wanted"))
    index = spark.read.schema(INDEX).parquet(f"{path}/index").select("block", "lines")
    return index.join(wanted, "block").select("lines", "wanted").mapInArrow(arrow_map(kernel), f"key string, {ENTRY}")


def _first(line: list) -> str:
    return line[0]


def lookup(spark: SparkSession, path: str, urls: DataFrame, payloads: bool = False, size: int = SLICE) -> DataFrame:
    """The records of the `url`s, each read from its range of an archive. Every capture comes once."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads, "archive", "segment", "offset", "length"]

    def kernel(batch):
        for archive, segment, content, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            rows = [parse_record(zlib.decompress(content[r["offset"] : r["offset"] + r["length"]], 31)) | {"archive": archive, "segment": segment, **r} for r in ranges]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[n]) for n in names], names=names)

    found = stage(captures(spark, path, keyed(urls.select("url").distinct()).distinct(), size), "captures")
    ranges = found.groupBy("archive", F.col("segment").alias("at")).agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # those of one row, of about SEGMENT bytes
    archives = spark.read.schema(ARCHIVE).parquet(f"{path}/archives")
    held = archives.join(ranges, (archives["archive"] == ranges["archive"]) & (archives["offset"] == ranges["at"])).select(archives["archive"], "at", "content", "ranges")
    schema = RECORD + (", payload binary" if payloads else "") + ", archive string, segment bigint, offset bigint, length bigint"
    return held.mapInArrow(arrow_map(kernel), schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all of `pages`: archives and index are written, and every record is read back through the index."""
    path = new_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    write_index(spark, path)
    return lookup(spark, path, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "segment", "offset", "length")
