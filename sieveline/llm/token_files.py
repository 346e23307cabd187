"""Token-id files with canonical length-limited Huffman codes (operator 10).

Writing: documents are dealt out by ranges of doc_id and sorted, tokenized once and staged as 16- or 32-bit
ids; ids are counted over the whole corpus (at most one count per id of the vocabulary reaches the driver);
package-merge gives code lengths of at most MAX_BITS, and canonical codes follow from the lengths alone.
The file is a table of independent blocks, in ascending doc_id order over shards: the documents of a block
(doc_id, first token, number of tokens), the payload, and the bit offset of every CHECKPOINT-th token. The
blocks are rows of Parquet files that Spark commits, so any store works and a lost executor costs its task;
the code lengths are a second, small table beside them.
Reading: all segments between checkpoints are decoded in step, one table lookup per id and segment.

Results for edge cases: null and empty texts have the end id alone; rows that repeat a doc_id are documents
of their own, ordered by a hash of the text; a null doc_id comes first; an empty table gives no rows; columns besides
doc_id and text are ignored. A document is never split: a very long one is a block of its own.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_automaton import byte_signs, default_tokenizer
from .common import arrow_map, binary_rows, discard, new_path, spans, stage, table, text_steps
from .words import BatchEncoder

MAX_BITS = 20
CHECKPOINT = 512
BLOCK_TOKENS = 1 << 18
END_ID = 0


@cache
def library_encoder(path: str) -> BatchEncoder:
    """Ids as the tokenizers library gives them: its BPE model is asked for each pre-split word that is new."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    signs = str.maketrans({chr(b): s for s, b in byte_signs().items()})
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(signs))] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    return BatchEncoder(encode_words, special)


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most `most` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    own = counts[order].astype(np.int64)
    level, singles = own, [np.ones(len(own), bool)]
    for _ in range(most - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((own, packages))
        by = np.argsort(both, kind="stable")
        level = both[by]
        singles.append(by < len(own))
    take = 2 * len(own) - 2
    for single in reversed(singles):
        n = int(single[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        steps = np.int64(1) << (int(lengths.max()) - lengths[order])
        codes[order] = np.concatenate(([0], np.cumsum(steps)[:-1])) >> (int(lengths.max()) - lengths[order])
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical_codes(lengths)
        self.bits = int(lengths.max()) if len(lengths) and lengths.max() else 1
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        entries = np.repeat(order << 6 | lengths[order], np.int64(1) << (self.bits - lengths[order]))
        self.table = np.ones(1 << self.bits, np.int64)  # unused codes step on by a bit
        self.table[: len(entries)] = entries

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(payload, bit offset of every CHECKPOINT-th id)."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        starts = ends - size
        total = int(ends[-1]) if len(ends) else 0
        words = np.zeros((total >> 5) + 3)
        value = self.codes[ids].astype(np.uint64) << (64 - (starts & 31) - size).astype(np.uint64)
        at = starts >> 5
        words += np.bincount(at, (value >> np.uint64(32)).astype(np.float64), len(words))
        words += np.bincount(at + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
        return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT]

    def decode(self, payloads: list[np.ndarray], checkpoints: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The ids of several blocks; all segments of all blocks go in step."""
        lanes = [len(c) for c in checkpoints]
        if not sum(lanes):
            return [np.zeros(0, np.int32) for _ in counts]
        room = np.concatenate(([0], np.cumsum([len(p) + 16 for p in payloads])))
        data = np.zeros(int(room[-1]) + 64 + CHECKPOINT * self.bits // 8, np.uint8)
        for at, p in zip(room, payloads):
            data[at : at + len(p)] = p
        view = data.astype(np.uint32)
        window = np.zeros(len(data), np.uint32)
        window[:-3] = view[:-3] << 24 | view[1:-2] << 16 | view[2:-1] << 8 | view[3:]
        at = np.concatenate([np.asarray(c, np.int64) + 8 * r for c, r in zip(checkpoints, room)])
        out = np.empty((CHECKPOINT, len(at)), np.int32)
        limit = (len(data) - 8) * 8
        shift, mask = np.uint32(32 - self.bits), np.uint32((1 << self.bits) - 1)
        for k in range(CHECKPOINT):
            entry = self.table[(window[at >> 3] >> (shift - (at & 7).astype(np.uint32))) & mask]
            out[k] = entry >> 6
            at += entry & 63
            if k % 64 == 63:
                np.minimum(at, limit, out=at)
        flat, result, lane = out.T, [], 0
        for n, count in zip(lanes, counts):
            result.append(flat[lane : lane + n].reshape(-1)[:count])
            lane += n
        return result


def tokenized(docs: DataFrame, tokenizer: str, wide: bool) -> DataFrame:
    """Staged rows in the order of the file: doc_id, shard, local (tokens of the shard before it), n, ids."""

    def run(batches):
        from pyspark import TaskContext

        shard, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, texts in text_steps(batch.column(1)):
                ids, n = library_encoder(tokenizer).encode(texts)
                stops = np.cumsum(n)
                ids = np.insert(ids, stops, END_ID).astype("<u4" if wide else "<u2")
                n = n + 1
                stops = np.cumsum(n)
                blobs = [ids[e - c : e].tobytes() for e, c in zip(stops.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([shard] * (b - a), pa.int32()), pa.array(local + stops - n, pa.int64()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "shard", "local", "n", "ids"])
                local += int(stops[-1])

    # by text too, by a hash of it first: rows that share one doc_id, or have none, need not go to one task
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    return ordered.mapInArrow(run, "doc_id bigint, shard int, local bigint, n bigint, ids binary")


def id_counts(staged: DataFrame, vocabulary: int, wide: bool) -> np.ndarray:
    """How often each id occurs in the corpus."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            body, _ = binary_rows(batch.column(0))
            total += np.bincount(np.frombuffer(body.tobytes(), "<u4" if wide else "<u2"), minlength=vocabulary)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["id", "n"])

    rows = staged.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in rows.collect():  # one row per id of the vocabulary at most
        counts[r["id"]] = r["n"]
    return counts


BLOCK = "shard int, first_start bigint, doc_ids array<bigint>, starts array<bigint>, sizes array<bigint>, n_tokens bigint, checkpoints array<bigint>, payload binary"


def write(docs: DataFrame, tokenizer: str, path: str, vocabulary: int) -> None:
    """Write the file of all of `docs`: path/codes and path/blocks."""
    spark = docs.sparkSession
    wide = vocabulary > 1 << 16
    staged = stage(tokenized(docs, tokenizer, wide), "ids")
    lengths = code_lengths(id_counts(staged, vocabulary, wide))
    spark.createDataFrame([(bytes(lengths.astype(np.uint8)),)], "lengths binary").write.parquet(f"{path}/codes")
    per_shard = sorted(map(tuple, staged.groupBy("shard").agg(F.sum("n")).collect()))  # one row per partition
    bases = dict(zip((s for s, _ in per_shard), np.concatenate(([0], np.cumsum([n for _, n in per_shard])))[:-1].tolist() if per_shard else []))

    def kernel(batch):
        coder = _coder(lengths.tobytes())
        shards, sizes = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        starts = np.array([bases[s] for s in shards.tolist()], np.int64) + batch.column(2).to_numpy()
        body, offsets = binary_rows(batch.column(4))
        for a, b in spans(sizes, BLOCK_TOKENS):
            for c, d in _runs(shards, a, b):
                ids = np.frombuffer(body[offsets[c] : offsets[d]].tobytes(), "<u4" if wide else "<u2").astype(np.int64)
                payload, checkpoints = coder.encode(ids)
                listed = [pa.array([x], pa.list_(pa.int64())) for x in (batch.column(0)[c:d].to_pylist(), starts[c:d], sizes[c:d])]
                yield pa.RecordBatch.from_arrays([pa.array([shards[c]], pa.int32()), pa.array([starts[c]], pa.int64()), *listed, pa.array([len(ids)], pa.int64()), pa.array([checkpoints], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["shard", "first_start", "doc_ids", "starts", "sizes", "n_tokens", "checkpoints", "payload"])

    staged.select("doc_id", "shard", "local", "n", "ids").mapInArrow(arrow_map(kernel), BLOCK).write.parquet(f"{path}/blocks")
    discard(staged)


def _runs(shards: np.ndarray, a: int, b: int):
    """Sub-ranges of [a, b) that stay in one shard."""
    cuts = [a, *(a + 1 + np.flatnonzero(np.diff(shards[a:b]))).tolist(), b]
    return zip(cuts, cuts[1:])


@cache
def _coder(lengths: bytes) -> Coder:
    return Coder(np.frombuffer(lengths, np.int64))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian uint32) of every document of the file."""
    return _read(spark, path, "ids binary", lambda raw: raw.tobytes(), pa.binary())


def _read(spark: SparkSession, path: str, column: str, digest, kind) -> DataFrame:
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codes").first()["lengths"], np.uint8).astype(np.int64).tobytes()

    def kernel(batch):
        coder = _coder(lengths)
        counts = batch.column("n_tokens").to_numpy()
        for a, b in spans(counts, 2 * BLOCK_TOKENS):
            rows = batch.slice(a, b - a)
            payloads = [np.frombuffer(x, np.uint8) for x in rows.column("payload").to_pylist()]
            decoded = coder.decode(payloads, rows.column("checkpoints").to_pylist(), counts[a:b].tolist())
            for k, ids in enumerate(decoded):
                sizes = np.array(rows.column("sizes")[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                values = [digest(raw[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_ids")[k].values, rows.column("starts")[k].values, pa.array(sizes), pa.array(values, kind)], names=["doc_id", "start", "n_tokens", "value"])

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("doc_ids", "starts", "sizes", "n_tokens", "checkpoints", "payload")
    name, _, sql = column.partition(" ")
    return blocks.mapInArrow(arrow_map(kernel), f"doc_id bigint, start bigint, n_tokens bigint, value {sql}").withColumnRenamed("value", name)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all of `documents`: written, then read back from the file alone."""
    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), default_tokenizer(), path, 50_257)
    return _read(spark, path, "ids_crc32 bigint", lambda raw: zlib.crc32(raw), pa.int64())
