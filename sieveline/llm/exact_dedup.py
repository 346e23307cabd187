"""Exact dedup by content-defined chunk recipes (operator 8).

One pass over the texts makes a recipe for each document: the text, lower-cased in A-Z only, is cut where
a rolling hash of the last 32 bytes meets a mask, and each chunk gets a 64-bit name (BLAKE2b) with its
length, and a SHA-256 digest. Recipes alone are staged; no text is moved after that.
Names are verified over the whole corpus: every (name, length) must stand for one digest. If one stands
for more (a collision), recipes are compared by digest instead, for all rows. Then equal texts have equal
ordered identifier lists, and the other way round. Groups are aggregated before the shuffle, and the join
back has one row per list on its other side; that side is staged first, so that no aggregate stands between
the exchanges and the join and adaptive execution can split a hot group.

Results for edge cases: null counts as the empty text; empty texts are equal (empty recipe); rows that
repeat a doc_id are one document, each row is returned and shares its flag; a null doc_id is less than
any other; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, binary_rows, spans, stage, table

WINDOW = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(body: np.ndarray, average: int) -> np.ndarray:
    """Positions after which the rolling hash of the 32 bytes up to there meets the mask. average: a power of two."""
    rolled = _GEAR[body]
    for shift in (1, 2, 4, 8, 16):
        rolled[shift:] += rolled[:-shift] << np.uint32(shift)  # the right side is made before it is added
    return np.flatnonzero(rolled >> np.uint32(32 - (average.bit_length() - 1)) == 0) + 1


def chunk_ends(cuts: np.ndarray, start: int, stop: int, least: int, most: int) -> list[int]:
    """Where the chunks of the document in [start, stop) end. Only windows inside the document count."""
    out, at = [], start
    for cut in cuts[np.searchsorted(cuts, start + WINDOW) : np.searchsorted(cuts, stop)].tolist():
        while cut - at > most:
            at += most
            out.append(at)
        if cut - at >= least:
            out.append(cut)
            at = cut
    while stop - at > most:
        at += most
        out.append(at)
    if stop > at:
        out.append(stop)
    return out


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", average: int = 4096) -> DataFrame:
    """(key, n_bytes, text_sha256, names, sizes, digests) of each row: its recipe, without its text."""

    def kernel(batch):
        body, offsets = binary_rows(batch.column(1))
        for a, b in spans(np.diff(offsets)):
            low = body[offsets[a] : offsets[b]].tobytes().translate(_LOWER)
            data = np.frombuffer(low, np.uint8)
            cuts = cut_points(data, average) if len(data) else np.zeros(0, np.int64)
            at = (offsets[a : b + 1] - offsets[a]).tolist()
            whole, names, sizes, digests, n = [], [], [], [], [0]
            for start, stop in zip(at, at[1:]):
                whole.append(hashlib.sha256(low[start:stop]).hexdigest())
                for end in chunk_ends(cuts, start, stop, average // 4, average * 8):
                    chunk = low[start:end]
                    names.append(int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True))
                    sizes.append(end - start)
                    digests.append(hashlib.sha256(chunk).digest())
                    start = end
                n.append(len(names))
            ends = pa.array(n, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((names, pa.int64()), (sizes, pa.int32()), (digests, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(at), pa.int64()), pa.array(whole), *lists], names=["key", "n_bytes", "text_sha256", "names", "sizes", "digests"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("binary").alias("text"))
    return rows.mapInArrow(arrow_map(kernel), f"key {kind}, n_bytes bigint, text_sha256 string, names array<bigint>, sizes array<int>, digests array<binary>").withColumnRenamed("key", key)


def colliding(staged: DataFrame) -> bool:
    """Whether a (name, length) stands for more than one digest anywhere."""
    chunks = staged.select(F.explode(F.arrays_zip("names", "sizes", "digests")).alias("c")).select("c.*")
    met = chunks.groupBy("names", "sizes").agg(F.min("digests").alias("lo"), F.max("digests").alias("hi")).where("lo <> hi")
    return bool(met.take(1))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", average: int = 4096) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of each row of `docs`."""
    staged = stage(recipes(docs, key, text, average), "recipes")
    identifiers = F.col("digests") if colliding(staged) else F.arrays_zip("names", "sizes")
    rows = staged.select(key, "text_sha256", identifiers.alias("recipe"))
    same = rows.groupBy("recipe").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = rows.join(stage(same, "recipe-groups"), "recipe")
    return joined.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all of `documents`."""
    return groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
