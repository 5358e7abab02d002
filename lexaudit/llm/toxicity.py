"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words (whole, and cut to their first STEM letters, which joins
inflected forms), word pairs and pairs with one word between, hashed to ``2 ** bits`` coordinates.  FTRL-proximal keeps a rate for each coordinate and, by its L1 term, an
exactly zero weight wherever the evidence is thin, so that the model is a short list of (coordinate,
weight) pairs, bounded by ``2 ** bits``, that travels to the executors in a closure.

Training reads a bounded sample of the labelled rows (``train_docs``, chosen by a hash of the id, so
that it is the same on every run) and runs in one task; the sample's ids are broadcast, the texts
they belong to are the only ones that move.  Scoring reads every whole text where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm._util import free_name, hash_sample, small_batches

#: Bound of the training sample, in documents.
TRAIN_DOCS = 12_000
BITS = 20
WORD = re.compile(r"[^\W_]+")
STEM = 4
#: Words whose hash a worker remembers at most.
REMEMBERED = 300_000

_hashes: dict[str, int] = {}


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner; l1 is in units of summed gradient."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 4
    bits: int = BITS


def _word_hashes(text: str) -> np.ndarray:
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    out = []
    for w in WORD.findall(text.lower()):
        h = _hashes.get(w)
        if h is None:
            stem = zlib.crc32(w[:STEM].encode("utf-8", "surrogatepass"))
            h = _hashes[w] = stem << 32 | zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, np.uint64)


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Coordinates of the text's words, word stems, neighbouring pairs and skip pairs, repeats included."""
    both = _word_hashes(text or "")
    h, stems = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    one, two, skip, stem = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
    return np.concatenate([_mixed(h * one, bits), _mixed(stems * stem, bits), _mixed(h[:-1] * two + h[1:] * one, bits), _mixed(h[:-2] * skip + h[2:] * one, bits)])


def train(rows: list[tuple[str | None, int]], how: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) of the non-zero weights after ``epochs`` passes; coordinate 2 ** bits is the bias."""
    size = 1 << how.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    xs = [np.append(np.unique(features(t, how.bits)), size).astype(np.int32) for t, _ in rows]
    ys = [float(y) for _, y in rows]
    for _ in range(how.epochs):
        for x, y in zip(xs, ys, strict=True):
            zi, ni = z[x], n[x]
            l1 = np.full(len(x), how.l1)
            l1[-1] = 0.0
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2))
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - y
            n[x] = ni + g * g
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha * w
    l1 = np.full(size + 1, how.l1)
    l1[-1] = 0.0
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))
    at = np.flatnonzero(w)
    return at, w[at]


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text, mod 5, is 0.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", train_docs: int = TRAIN_DOCS, how: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from at most train_docs labelled documents that are not held out.

    Of several labels for one id the larger counts; null labels and ids are ignored.  Without any
    labelled document there are no weights.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_y"))
    chosen = hash_sample(known, train_docs, "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(chosen), "doc_id")
    # repeated rows of one id: one text of them, so that the sample stays bounded
    rows = texts.groupBy("doc_id").agg(F.max("_text").alias("_text"), F.max("_y").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        at, w = train([(t, y) for _, t, y in got], how) if got else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    got = rows.select("doc_id", "_text", "_y").repartition(1).mapInArrow(run, "at long, w double").toPandas()
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(np.float64)


def score_texts(texts: list[str | None], model: tuple[np.ndarray, np.ndarray], bits: int) -> list[float]:
    at, w = model
    if not len(at):
        return [0.0] * len(texts)
    dense = np.zeros((1 << bits) + 1)
    dense[at] = w
    bias, out = dense[-1], []
    for t in texts:
        x = features(t, bits)
        x = np.unique(x[dense[x] != 0.0])
        out.append(float(1.0 / (1.0 + np.exp(-np.clip(bias + dense[x].sum(), -35.0, 35.0)))))
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, how: Ftrl = Ftrl(), name: str = "score") -> DataFrame:
    """docs with the score of every whole text appended (an existing column of that name is replaced).

    A null or empty text gets the model's bias alone; without a model every score is 0.  Rows are
    scored one by one, so repeats and extra columns pass unchanged.
    """
    small_batches(docs.sparkSession)
    src = docs.drop(name)
    cols, at = src.columns, [c.lower() for c in src.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_texts(b.column(at).to_pylist(), model, how.bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*cols, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{schema}, `{name}` double")


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, how: Ftrl = Ftrl()) -> DataFrame:
    """The rows of docs that score under the threshold, by a model fitted on labels; columns unchanged."""
    name = free_name(docs, "_toxicity")
    return score(docs, fit(docs, labels, how=how), how=how, name=name).where(F.col(name) < threshold).drop(name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # only id and score leave the Python workers; the texts do not come back
    out = _score_only(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _score_only(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], how: Ftrl = Ftrl()) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_texts(b.column(1).to_pylist(), model, how.bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
