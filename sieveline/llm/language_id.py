"""Language ID by nearest centroids (operator 2).

A text is lower-cased, signs and digits of ASCII become spaces, and its byte trigrams are hashed into DIMS
counts, over the whole text. Weights are (1 + log tf) * idf, vectors have length 1. Each language has several
centroids: spherical k-means over a bounded sample of labelled rows. A text gets the language of the centroid
with the largest cosine. Rejection goes by distance (1 - cosine): each centroid has a limit for each class of lengths
(powers of two of bytes), the mean and DEVIATIONS deviations of the distances that the sample's texts and their
beginnings of that length have from it, as short texts lie farther out. In cosines, the limit stays between FLOOR and
CEILING times the mean cosine, so monotonous texts of a known language stay and other scripts go at any length. Where
few of a centroid's texts reach a class, all of its language count; if those are few, the next shorter class does.

The sample: of each language the `per_language` rows with the smallest hash of doc_id (a documented bound;
rows of a language beyond it do not take part in the fit). What reaches the driver is its count vectors, and sums
of distances by centroid and class.

Results for edge cases: null texts and texts without a letter are `und`, with score 0, and count as rejected;
so are all rows if nothing could be learned; ties between centroids go to the first by language and number;
rows that repeat get equal values; columns besides doc_id, text and lang are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, binary_rows, spans, table

DIMS = 1 << 13
PIECE = 1 << 18  # bytes of a text that are counted at a time
UNKNOWN = "und"
_CLEAN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


_LOG = np.concatenate(([0.0], 1 + np.log(np.arange(1, 1 << 16)))).astype(np.float32)  # 1 + log of the usual counts
CLASSES, DEVIATIONS, FLOOR, CEILING, ENOUGH = 32, 6.0, 0.2, 0.35, 20


def trigram_counts(texts: list[str]) -> np.ndarray:
    """[text, DIMS] counts of hashed byte trigrams of whole texts, PIECE bytes at a time; trigrams of spaces alone are left out."""
    out = np.zeros((len(texts), DIMS), np.int32)
    for k, text in enumerate(texts):
        body = np.frombuffer((b" " + text.lower().encode("utf-8", "replace") + b" ").translate(_CLEAN), np.uint8)
        for a in range(0, len(body) - 2, PIECE):
            data = body[a : a + PIECE + 2].astype(np.uint32)
            code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
            bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int32)
            bucket[code == 0x202020] = DIMS
            out[k] += np.bincount(bucket, minlength=DIMS + 1)[:DIMS]
    return out


def log_counts(counts: np.ndarray) -> np.ndarray:
    """1 + log of each count, 0 for 0."""
    out = _LOG[np.minimum(counts, len(_LOG) - 1)]
    if counts.size and counts.max() >= len(_LOG):
        large = counts >= len(_LOG)
        out[large] = 1 + np.log(counts[large].astype(np.float64))
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors, (1 + log tf) * idf, of length 1 (0 where there is no trigram)."""
    out = log_counts(counts)
    out *= idf
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
    return out


def length_class(n_bytes: int) -> int:
    return min(CLASSES - 1, max(1, n_bytes).bit_length() - 1)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # [centroid, DIMS]
    idf: np.ndarray
    reach: np.ndarray  # [centroid, class of lengths]: the largest distance that is accepted


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, label of each row); starts from rows far apart, so the result is the same each time.

    Starts are taken from the nine tenths of rows next to the mean, and centroids of fewer than 2 % of the rows are
    given up: rows unlike all others are no cluster.
    """
    near = x @ x.sum(0)
    usual = x[near >= np.quantile(near, 0.1)]
    k = min(k, len(usual))
    picked = [0]
    nearest = usual @ usual[0]
    for _ in range(k - 1):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, usual @ usual[picked[-1]])
    centres = usual[picked].copy()
    for _ in range(rounds):
        label = (x @ centres.T).argmax(1)
        size = np.bincount(label, minlength=len(centres))
        centres = centres[size >= min(size.max(), max(1, 0.02 * len(x)))]
        label = (x @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (label == j).any():
                centres[j] = x[label == j].sum(0)
                centres[j] /= max(np.linalg.norm(centres[j]), 1e-12)
    return centres, (x @ centres.T).argmax(1)


def fit_counts(langs: list[str], starts: np.ndarray, at: np.ndarray, n: np.ndarray, clusters: int = 4) -> Model:
    """The model of labelled rows, sorted by language; row k has the counts n[starts[k]:starts[k + 1]] of the trigrams `at`. It accepts all distances."""
    langs_of = np.array(langs, dtype=object)
    idf = (np.log((1 + len(langs)) / (1 + np.bincount(at, minlength=DIMS))) + 1).astype(np.float32)
    names, centroids = [], []
    for lang in sorted(set(langs)):
        rows = np.flatnonzero(langs_of == lang)
        counts = np.zeros((len(rows), DIMS), n.dtype)
        a, b = starts[rows[0]], starts[rows[-1] + 1]
        counts[np.repeat(np.arange(len(rows)), np.diff(starts[rows[0] : rows[-1] + 2])), at[a:b]] = n[a:b]
        x = weighted(counts, idf)
        del counts
        centres, _ = spherical_kmeans(x, clusters)
        names += [lang] * len(centres)
        centroids.append(centres)
    stacked = np.concatenate(centroids) if centroids else np.zeros((0, DIMS), np.float32)
    return Model(names, stacked.astype(np.float32), idf, np.ones((len(names), CLASSES)))


def limits(languages: list[str], n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """[centroid, class] limits from how many distances there are, their sums, and the sums of their squares."""
    same = np.array([[a == b for b in languages] for a in languages], float)
    few = n < ENOUGH
    n, total, squares = (np.where(few, same @ x, x) for x in (n, total, squares))
    mean = total / np.maximum(n, 1)
    deviation = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0))
    reach = 1 - np.clip(1 - mean - DEVIATIONS * deviation, FLOOR * (1 - mean), CEILING * (1 - mean))
    for k in range(n.shape[1]):
        few = n[:, k] < ENOUGH
        reach[few, k] = reach[few, k - 1] if k else 1.0
    return reach


def fit(labelled: DataFrame, per_language: int = 1000, clusters: int = 4) -> Model:
    """Fit on a bounded sample of rows (doc_id, text, lang) with a language."""
    known = labelled.where(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language

    # Hashes are even, so the lowest `share` of them holds some four times as many rows as are wanted; the
    # exact bound is then looked up among those few, whatever a language's part of the corpus is.
    first = F.lit(None).cast("bigint")
    for row in sizes:
        share = min(1.0, 4 * per_language / row["n"])
        first = F.when(F.col("lang") == row["lang"], F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))).otherwise(first)
    hashed = known.select("lang", F.xxhash64(F.lit(2), "doc_id").alias("h")).where(F.col("h") <= first)
    ranked = hashed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)
    bounds = ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()

    chosen = F.lit(False)
    for row in bounds:
        chosen = chosen | ((F.col("lang") == row["lang"]) & (F.xxhash64(F.lit(2), "doc_id") <= row["h"]))

    def kernel(batch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a in range(0, len(texts), 64):
            counts = trigram_counts(texts[a : a + 64])
            where = [np.flatnonzero(c).astype(np.int32) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 64], pa.array(where, pa.list_(pa.int32())), pa.array([c[w] for c, w in zip(counts, where)], pa.list_(pa.int32()))], names=["lang", "at", "n"])

    sample = labelled.where(chosen & F.col("text").isNotNull()).select("lang", "text")
    found = sample.mapInArrow(arrow_map(kernel), "lang string, at array<int>, n array<int>").toArrow().sort_by([("lang", "ascending")])
    at, n = (found[c].combine_chunks() for c in ("at", "n"))
    size = at.value_lengths().to_numpy()
    langs = [x for x, k in zip(found["lang"].to_pylist(), size) if k]
    model = fit_counts(langs, np.concatenate(([0], np.cumsum(size[size > 0]))), at.flatten().to_numpy(), n.flatten().to_numpy(), clusters)
    return calibrated(model, sample)


def calibrated(model: Model, sample: DataFrame) -> Model:
    """`model` with limits from the distances of the rows (lang, text), whole and cut to each power of two of bytes."""

    def kernel(batch):
        shape = (len(model.languages), CLASSES)
        n, total, squares = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = [k for k, x in enumerate(model.languages) if x == lang]
            if not own or not text:
                continue
            data = text.encode("utf-8", "replace")
            last = length_class(len(data))
            parts = [*(data[: 1 << k].decode("utf-8", "ignore") for k in range(last + (len(data) > 1 << last))), text]
            cosine = weighted(trigram_counts(parts), model.idf) @ model.centroids[own].T
            best = np.array(own)[cosine[-1].argmax()]  # the whole text tells which centroid it belongs to
            for part, row in zip(parts, cosine[:, cosine[-1].argmax()].tolist()):
                k = length_class(len(part.encode("utf-8", "replace")))
                n[best, k] += 1
                total[best, k] += 1 - row
                squares[best, k] += (1 - row) ** 2
        where = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *(pa.array(x.reshape(-1)[where], pa.float64()) for x in (n, total, squares))], names=["place", "n", "total", "squares"])

    if not model.languages:
        return model
    rows = sample.mapInArrow(arrow_map(kernel), "place int, n double, total double, squares double").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    sums = np.zeros((3, len(model.languages) * CLASSES))
    for r in rows.collect():  # one row for each centroid and class at most
        sums[:, r["place"]] = r["n"], r["total"], r["squares"]
    return Model(model.languages, model.centroids, model.idf, limits(model.languages, *sums.reshape(3, len(model.languages), CLASSES)))


def predict(docs: DataFrame, model: Model, accepted: bool = False) -> DataFrame:
    """`docs` with lang_pred, score and rejected; or those that are accepted, with no column more."""

    def kernel(batch):
        column = batch.column(at)
        for a, b in spans(np.diff(binary_rows(column)[1]), 1_000_000):
            texts = column[a:b].to_pylist()
            n = b - a
            language, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            usable = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if model.languages else []
            for c in range(0, len(usable), 128):
                rows = usable[c : c + 128]
                cosine = weighted(trigram_counts([texts[k] for k in rows]), model.idf) @ model.centroids.T
                best = cosine.argmax(1)
                top = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
                for k, j, s in zip(rows, best.tolist(), top.tolist()):
                    language[k], score[k], rejected[k] = model.languages[j], s, 1 - s > model.reach[j, length_class(len(texts[k].encode("utf-8", "replace")))]
            found = [pa.array(language), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.slice(a, n).columns, *found], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    renamed = {f"c{k}": c for k, c in enumerate(docs.columns)}  # any names, clashing ones included
    rows = docs.toDF(*renamed)
    at = docs.columns.index("text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(arrow_map(kernel), f"{fields}, lang_pred string, score double, rejected boolean")
    if accepted:
        return out.where(~F.col("rejected")).select(*renamed).toDF(*docs.columns)
    return out.toDF(*docs.columns, "lang_pred", "score", "rejected")


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that a model of those that are not held out accepts."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))), accepted=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all of `documents`; `rejected` tells what the pipeline would drop."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
