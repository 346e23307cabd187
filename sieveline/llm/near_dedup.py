"""Near-duplicate groups by improved consistent weighted sampling (operator 4).

Shingles are five words (ASCII letters and digits, lower-cased, and all bytes beyond ASCII; a shorter text is
one shingle). A shingle's weight is its count times its inverse document frequency log((1 + N) / (1 + df)) + 1.
df is the exact number of documents that have the shingle: texts are packed into chunks of CHUNK bytes, each chunk
sends its distinct shingles with their counts to buckets by hash, and gets back those that two documents or more
have; all others have df 1. (by="words" takes the mean over the shingle's words instead, counted in 2**18 hashed
words; no query uses it.)

1. One pass signs each document: BANDS * ROWS samples of improved consistent weighted sampling (r and c from
   Gamma(2, 1), b uniform; the shingle with the least c / (y e^r) and its step t), hashed to one key a band,
   and a digest of the weighted set. Documents with equal sets form a class at once, with one representative.
2. Representatives that share a band key are compared with the smallest of them by exact weighted Jaccard
   similarity of their whole sets. In buckets where all are alike to it, that settles the bucket. In others, all
   members go on: prefix filtering finds every pair of 0.8 or more that would join two components, in blocks of
   BLOCK members (each pair of blocks is a task, so no bucket is too large for one), without cap. At similarity
   s a pair shares a key with probability 1 - (1 - s^ROWS)^BANDS: 0.9997 at 0.8.
3. Pairs of 0.8 or more are links; groups are the connected components of links and classes.

Sets are packed only for documents that share a key: a bitmap of 2**FILTER_BITS bits, a fixed size, keeps most other
texts out, and an exact semi join drops the rest. Sets are joined to the pairs by doc_id,
first the member (at most one pair for each of its bands), then the representative; the join splits hot ones.

Results for edge cases: null texts and texts without a word are alone, each row a group; rows that repeat a
doc_id are one document (equal texts then, or the one with the larger digest counts for comparison); a null
doc_id is alone; ties go to the smallest doc_id; columns besides doc_id and text are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, binary_rows, discard, release, spans, stage, table
from .words import powers

WORDS, BANDS, ROWS, SIMILAR = 5, 8, 2, 0.8
DF_BITS = 18
FILTER_BITS = 26  # of the bitmap of doc_ids whose sets are needed: 8 MB, whatever the corpus is
BLOCK = 1000  # members of a bucket that are compared in one task, with those of one other block
CHUNK = 2_000_000  # bytes of text in one row of packed documents; a longer text is a row of its own
_STEP = 1_000_000  # bytes a kernel step takes
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CHAR = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CHAR[65:91] = _CHAR[97:123]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the end) of documents back to back."""
    n = len(body)
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = _LETTER[body]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(letter[1:] & (~letter[:-1] | first))
    ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | first[1:])) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CHAR[body] * power[:n], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted by document and shingle, each once. Without idf of words, weights are counts."""
    count = np.diff(bounds)
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    stop = np.repeat(bounds[1:], n)
    of_word = None if idf is None else idf[(hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)]
    key, weight, words = np.zeros(len(at), np.uint64), np.zeros(len(at), np.float32), np.zeros(len(at), np.float32)
    for k in range(WORDS):
        here = np.minimum(at + k, stop - 1)
        real = at + k < stop
        key = key * _PRIME + np.where(real, hashes[here], np.uint64(k))
        if of_word is not None:
            weight += np.where(real, of_word[here], 0)
            words += real
    key = mixed(key)
    weight = np.ones(len(at), np.float32) if of_word is None else weight / np.maximum(words, 1)
    order = np.lexsort((key, doc))
    doc, key, weight = doc[order], key[order], weight[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    where = np.flatnonzero(new)
    tf = np.diff(np.append(where, len(doc)))
    return doc[where], key[where], weight[where] * tf.astype(np.float32)


@cache
def _gamma(bits: int) -> np.ndarray:
    """Gamma(2, 1) at 2**bits even steps of its distribution, by bisection."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros(len(u)), np.full(len(u), 64.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - np.exp(-middle) * (1 + middle) < u
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return high.astype(np.float32)


@cache
def _log_gamma(bits: int) -> np.ndarray:
    return np.log(_gamma(bits)).astype(np.float32)


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """[document, BANDS] keys of improved consistent weighted samples; documents without shingles have none."""
    out = np.zeros((n_docs, BANDS), np.uint64)
    if not len(doc):
        return out
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(first, len(doc)))
    which = doc[first]
    log_weight = np.log(weight)
    gamma, log_gamma = _gamma(16), _log_gamma(20)
    for k in range(BANDS * ROWS):
        h = mixed(key + np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        r = gamma[(h & np.uint64(0xFFFF)).astype(np.int64)]
        b = ((h >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_weight / r + b)
        score = log_gamma[(h >> np.uint64(44)).astype(np.int64)] - r * (t - b + 1)
        least = np.minimum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(least, size))
        hit = hit[np.concatenate(([True], doc[hit[1:]] != doc[hit[:-1]]))]  # ties: the smallest shingle
        sample = mixed(key[hit] * _PRIME + t[hit].astype(np.int64).astype(np.uint64))
        band = k // ROWS
        out[which, band] = mixed(out[which, band] + sample + np.uint64(k))
    return out


def _steps(batch, column: int):
    body, offsets = binary_rows(batch.column(column))
    for a, b in spans(np.diff(offsets), _STEP):
        yield a, b, body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(documents, how many of them have each hashed word)."""
    n = 1 << DF_BITS

    def run(batches):
        total, rows = np.zeros(n, np.int64), 0
        for batch in batches:
            for a, b, body, offsets in _steps(batch, 0):
                hashes, bounds = word_hashes(body, offsets)
                doc = np.repeat(np.arange(b - a), np.diff(bounds))
                pairs = np.unique(doc << DF_BITS | (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64))
                total += np.bincount(pairs & (n - 1), minlength=n)
                rows += b - a
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, n), pa.int32()), pa.array(np.append(total[some], rows), pa.int64())], names=["word", "n"])

    counts = docs.select(docs[text].cast("binary").alias("text")).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # 2**DF_BITS + 1 rows at most
    out = np.zeros(n + 1, np.int64)
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    return int(out[n]), out[:n]


def chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk, n, bytes, ids, texts): all documents, packed; staged, so that a chunk's number is told once."""

    def run(batches):
        part, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, texts = batch.columns
            size = np.diff(binary_rows(texts)[1])
            for a, b in spans(size, CHUNK):
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c[a:b]) for c in (ids, texts)]
                yield pa.RecordBatch.from_arrays([pa.array([part + k]), pa.array([b - a]), pa.array([int(size[a:b].sum())]), *lists], names=["chunk", "n", "bytes", "ids", "texts"])
                k += 1
        release()

    rows = docs.select(docs[key].cast("bigint").alias("id"), docs[text].cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, "chunk bigint, n bigint, bytes bigint, ids array<bigint>, texts array<binary>"), "chunks")


def distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, how many of the texts have it), sorted, by steps of _STEP bytes: a worker's memory follows the step, not the chunk."""
    body, offsets = binary_rows(texts)
    steps = (word_hashes(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in spans(np.diff(offsets), _STEP))
    return np.unique(np.concatenate([shingles(*step)[1] for step in steps]), return_counts=True)


def shared_shingles(chunks: DataFrame, n_bytes: int) -> DataFrame:
    """(chunk, known): the shingles of each chunk that two documents of all or more have, with their number."""
    bits = max(min(1024, n_bytes >> 16), n_bytes // 24_000_000).bit_length()  # of the number of buckets

    def ask(batch):
        for chunk, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
            found, n = distinct(texts.values)
            bucket, first = np.unique((found >> np.uint64(1)) >> np.uint64(63 - bits), return_index=True)
            cuts = list(zip(first, [*first[1:], len(found)]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array([chunk] * len(cuts), pa.int64()), *(pa.array([x[c:d].tobytes() for c, d in cuts], pa.binary()) for x in (found, n.astype("<i8")))], names=["bucket", "chunk", "shingles", "n"])

    def count(group: pa.Table) -> pa.Table:
        found, n = (np.concatenate([np.frombuffer(x, kind) for x in group[c].to_pylist()]) for c, kind in (("shingles", "<u8"), ("n", "<i8")))
        size = np.array([len(x) // 8 for x in group["shingles"].to_pylist()])
        order = np.argsort(found, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(found[order]) > 0)))
        df = np.empty(len(found), np.int64)
        df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(found))))
        often = df > 1
        cut = np.concatenate(([0], np.cumsum(often)))[np.concatenate(([0], np.cumsum(size)))].tolist()
        some = [k for k in range(len(size)) if cut[k] < cut[k + 1]]
        return pa.table({"chunk": group["chunk"].take(pa.array(some, pa.int64())), **{c: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()) for c, x in (("shingles", found[often]), ("df", df[often].astype("<i8")))}})

    asked = chunks.select("chunk", "texts").mapInArrow(arrow_map(ask), "bucket bigint, chunk bigint, shingles binary, n binary")
    told = stage(asked.groupBy("bucket").applyInArrow(count, "chunk bigint, shingles binary, df binary"), "frequencies")
    return told.groupBy("chunk").agg(F.collect_list(F.struct("shingles", "df")).alias("known"))


class Weights:
    """What shingles weigh in a table of documents."""

    def __init__(self, docs: DataFrame, chunks: DataFrame, text: str, by: str):
        if by not in ("words", "shingles"):
            raise ValueError(f"unknown weights: {by}")
        self.known = self.idf = None
        if by == "words":
            self.n, df = document_frequencies(docs, text)
            self.idf = docs.sparkSession.sparkContext.broadcast((np.log((1 + self.n) / (1 + df)) + 1).astype(np.float32))
        else:
            self.n, n_bytes = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
            self.known = shared_shingles(chunks, n_bytes)

    def sets(self, chunks: DataFrame, kernel, schema: str) -> DataFrame:
        """`kernel` over (ids, first row, last row, document, shingle, weight) of each step of the chunks."""
        n, idf = self.n, self.idf
        rows = chunks.select("ids", "texts") if self.known is None else chunks.join(self.known, "chunk", "left").select("ids", "texts", "known")

        def run(batch):
            for k, (ids, texts) in enumerate(zip(batch.column(0), batch.column(1))):
                known, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if idf is None and batch.column(2)[k].is_valid:
                    told = batch.column(2)[k].values
                    known, df = (np.frombuffer(b"".join(told.field(c).to_pylist()), kind) for c, kind in (("shingles", "<u8"), ("df", "<i8")))
                    order = np.argsort(known)
                    known, df = known[order], df[order]
                known, weighs = np.append(known, np.uint64(0)), (np.log((1 + n) / (1 + np.append(df, 1))) + 1).astype(np.float32)
                body, offsets = binary_rows(texts.values)
                for a, b in spans(np.diff(offsets), _STEP):
                    doc, shingle, weight = shingles(*word_hashes(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), None if idf is None else idf.value)
                    if idf is None:
                        at = np.searchsorted(known[:-1], shingle)
                        weight *= np.where(known[at] == shingle, weighs[at], weighs[-1])  # of one document alone: df 1
                    yield from kernel(ids.values, a, b, doc, shingle, weight)

        return rows.mapInArrow(arrow_map(run), schema)


def signed(chunks: DataFrame, weights: Weights) -> DataFrame:
    """(id, n_shingles, whole, bands): `whole` is a digest of the weighted set."""

    def kernel(ids, a, b, doc, shingle, weight):
        n = np.bincount(doc, minlength=b - a)
        whole = np.zeros(b - a, np.uint64)
        if len(doc):
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            whole[doc[first]] = np.add.reduceat(mixed(shingle ^ weight.view(np.uint32).astype(np.uint64) * _PRIME), first)
        whole = mixed(whole + n.astype(np.uint64)).view(np.int64)
        bands = signatures(doc, shingle, weight, b - a).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(n, pa.int64()), pa.array(whole), lists], names=["id", "n_shingles", "whole", "bands"])

    return weights.sets(chunks, kernel, "id bigint, n_shingles bigint, whole bigint, bands array<bigint>")


def maybe_in(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks with the documents whose id is in `ids`, and some more: those whose hash meets a set bit of the bitmap."""
    shift = 64 - (FILTER_BITS - 6)
    hashed = ids.select(F.xxhash64("id").alias("h"))
    found = hashed.groupBy(F.expr(f"cast(shiftrightunsigned(h, {shift}) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    sent = ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def kernel(batch):
        for chunk, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            h = row[2].values.to_numpy().view(np.uint64)
            hit = pa.array((sent.value[(h >> np.uint64(shift)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool))
            kept = [x.values.filter(hit) for x in row[:2]]
            if len(kept[0]):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in kept)], names=["chunk", "ids", "texts"])

    rows = chunks.select("chunk", "ids", "texts", F.transform("ids", lambda x: F.xxhash64(x)).alias("h"))
    return rows.mapInArrow(arrow_map(kernel), "chunk bigint, ids array<bigint>, texts array<binary>")


def packed(chunks: DataFrame, ids: DataFrame, weights: Weights) -> DataFrame:
    """(id, shingles, weights) of the documents of `ids`: 32 bits of each shingle, sorted, and float weights."""

    def kernel(of, a, b, doc, shingle, weight):
        cut = np.searchsorted(doc, np.arange(b - a + 1))
        short = (shingle >> np.uint64(32)).astype("<u4")  # sorted as the shingles are
        yield pa.RecordBatch.from_arrays([of[a:b], *(pa.array([x[c:d].tobytes() for c, d in zip(cut, cut[1:])], pa.binary()) for x in (short, weight.astype("<f4")))], names=["id", "shingles", "weights"])

    rows = weights.sets(maybe_in(chunks, ids), kernel, "id bigint, shingles binary, weights binary").join(ids, "id", "left_semi")
    return rows.groupBy("id").agg(F.max(F.struct("shingles", "weights")).alias("s")).select("id", "s.shingles", "s.weights")


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of least weights over sum of largest weights; shingles are sorted."""
    _, x, y = np.intersect1d(a, b, return_indices=True)
    both = float(np.minimum(wa[x], wb[y]).sum(dtype=np.float64))
    return both / max(float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both, 1e-12)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of each pair."""

    def kernel(batch):
        values = []
        for a, wa, b, wb in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
            values.append(weighted_jaccard(np.frombuffer(a, "<u4"), np.frombuffer(wa, "<f4"), np.frombuffer(b, "<u4"), np.frombuffer(wb, "<f4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    of_b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    of_a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    joined = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "sa", "wa", "sb", "wb")
    return joined.mapInArrow(arrow_map(kernel), "a bigint, b bigint, similarity double")


def bucket_links(matched: np.ndarray, sets: list[np.ndarray], weights: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of members, by position, that link what `matched` (one component already) doesn't, by prefix filtering.

    Shingles are ordered by how few members have them. If two sets are alike enough, the first shingle they share
    stands in the prefix of both, where what follows still weighs `threshold` of the whole; only such pairs are
    compared, so members that share a common passage and no more are not. Pairs inside one component are skipped.
    """
    n = len(sets)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    same = np.flatnonzero(matched).tolist()
    for x in same:
        root[x] = same[0]
    size = np.fromiter(map(len, sets), np.int64, n)
    total = np.array([w.sum(dtype=np.float64) for w in weights])
    owner = np.repeat(np.arange(n), size)
    flat, weight = np.concatenate(sets), np.concatenate(weights).astype(np.float64)
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((name, count[name], owner))
    owner, name, weight = owner[order], name[order], weight[order]
    before = np.cumsum(weight) - weight
    rest = total[owner] - (before - before[np.repeat(np.cumsum(size) - size, size)])
    use = np.flatnonzero((rest >= threshold * total[owner] * (1 - 1e-6)) & (count[name] > 1))
    use = use[np.argsort(name[use], kind="stable")]
    name, owner = name[use], owner[use].tolist()
    cuts = [0, *(np.flatnonzero(np.diff(name)) + 1).tolist(), len(owner)]
    out, tried = [], set()
    for c, d in zip(cuts, cuts[1:]):
        members = owner[c:d]
        if d - c < 2 or len({find(x) for x in members}) < 2:
            continue
        for i, x in enumerate(members):
            for y in members[:i]:
                if (y, x) in tried or find(x) == find(y):
                    continue
                tried.add((y, x))
                if min(total[x], total[y]) < threshold * max(total[x], total[y]):
                    continue
                if weighted_jaccard(sets[y], weights[y], sets[x], weights[x]) >= threshold:
                    out.append((y, x))
                    root[find(x)] = find(y)
    return out


def links(chunks: DataFrame, signatures_of: DataFrame, weights_of: Weights, threshold: float) -> DataFrame | None:
    """(a, b): pairs of representatives whose similarity is `threshold` or more. None if no key is shared."""
    heads = signatures_of.where("id is not null and n_shingles > 0").groupBy("whole").agg(F.min(F.struct("id", "bands")).alias("h")).select("h.*").groupBy("id").agg(F.max("bands").alias("bands"))
    keyed = stage(heads.select("id", F.posexplode("bands").alias("band", "key")), "bands")
    met = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).where("n > 1")
    # the same members often meet in several bands: once is enough
    once = met.groupBy("n", "a", "members").agg(F.min(F.struct("band", "key")).alias("k")).select("k.*", "n", "a")
    live = stage(keyed.join(stage(once, "buckets"), ["band", "key"]), "shared")
    discard(keyed)
    if not live.take(1):
        return None
    sets = stage(packed(chunks, live.select("id").distinct(), weights_of), "sets")
    pairs = live.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    checked = stage(similarities(pairs, sets), "pairs")
    found = checked.where(F.col("similarity") >= threshold).select("a", "b")
    apart = stage(checked.where(F.col("similarity") < threshold).select("a", F.col("b").alias("id"), F.lit(True).alias("apart")), "apart")
    if not apart.take(1):
        return found
    marked = live.join(apart, ["a", "id"], "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    marked = stage(marked, "marked")
    mixed_buckets = stage(marked.where("apart").groupBy("band", "key").agg(F.count(F.lit(1)).alias("n_apart")), "mixed")
    rows = marked.join(mixed_buckets, ["band", "key"]).select("band", "key", "n", "id", "apart")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "apart")
    # a pair of blocks that hold nothing but members alike to the head says nothing new
    worth = dealt.where("apart").select("band", "key", "i", "j").distinct()
    dealt = dealt.join(stage(worth, "blocks"), ["band", "key", "i", "j"]).join(sets, "id")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group["id"].to_pylist()
        shingle = [np.frombuffer(x, "<u4") for x in group["shingles"].to_pylist()]
        weight = [np.frombuffer(x, "<f4") for x in group["weights"].to_pylist()]
        new = bucket_links(~np.array(group["apart"].to_pylist()), shingle, weight, threshold)
        return pa.table({"a": pa.array([ids[x] for x, _ in new], pa.int64()), "b": pa.array([ids[y] for _, y in new], pa.int64())})

    more = dealt.groupBy("band", "key", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return found.unionByName(stage(more.distinct(), "links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component of edges (a, b), by large-star and small-star steps."""

    def total(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = total(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))  # b < a in each edge
        down = stage(down, "least")
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        small = stage(small.where("a <> b").distinct(), "edges")
        after = total(small)
        discard(now)
        now = small
        if after == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = after


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILAR, by: str = "words") -> DataFrame:
    """(key, group_id, group_size, kept) of each row: group_id is the smallest id of the group, whose document stays.

    by: whose document frequencies weigh, those of "shingles" (as the queries do) or of "words".
    """
    chunks = chunked(docs, key, text)
    weights = Weights(docs, chunks, text, by)
    sign = stage(signed(chunks, weights), "signatures")
    found = links(chunks, sign, weights, threshold)
    discard(chunks)
    real = sign.where("id is not null and n_shingles > 0")
    classes = stage(real.groupBy("whole").agg(F.min("id").alias("head")), "classes")
    rows = real.select("id", "whole").join(classes, "whole").select("id", "head")
    alone = sign.where("id is null or n_shingles = 0").select("id", F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"))
    # rows that repeat a doc_id with other texts tie their classes together
    ties = rows.where("id <> head").groupBy("id").agg(F.min("head").alias("m"), F.max("head").alias("x")).where("m <> x")
    edges = ties.select(F.col("m").alias("a"), F.col("x").alias("b"))
    edges = edges if found is None else edges.unionByName(found)
    if edges.take(1):
        roots = components(edges).withColumnRenamed("id", "head")
        rows = rows.join(roots, "head", "left").select("id", F.coalesce("root", "head").alias("group_id"))
    else:
        rows = rows.select("id", F.col("head").alias("group_id"))
    rows = stage(rows, "members")
    sizes = stage(rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")), "sizes")
    out = rows.join(sizes, "group_id").select("id", "group_id", "group_size").unionByName(alone)
    return out.select(F.col("id").alias(key), "group_id", "group_size", F.col("id").eqNullSafe(F.col("group_id")).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all of `documents`: five words, similarity 0.8 or more."""
    return groups(table(spark, sf_dir, "documents"), by="shingles")
