"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits or runs of other marks, so the marks between words are words too. Uni- and bigrams are
hashed to a fixed number of weights. Training reads a bounded sample of labelled rows, drawn by hash, in one task; scores are
sparse dot products with the broadcast weights, whose size is fixed.

Defined cases: a null or empty text has the bias alone; a null doc_id takes no part in learning (it has no fold) and is scored;
repeated rows are scored each; without a labelled row every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common

_WORD = re.compile(r"\w+|[^\w\s]+")
#: Words whose hashes a worker keeps at most.
KEPT_WORDS = 400_000


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    #: Bounds of the training sample: labelled rows, and characters of one of them (longer documents are not drawn).
    rows: int = 12_000
    chars: int = 10_000
    epochs: int = 3
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.0


_HASHES: dict[str, int] = {}


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed uni- and bigrams, and their values: 1 + log of counts, scaled to length 1."""
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    known, words = _HASHES, _WORD.findall(text or "")
    if not words:
        return np.empty(0, "i8"), np.empty(0)
    for w in {*words}.difference(known):
        known[w] = zlib.crc32(w.encode())
    one = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate([one * np.uint64(0xFF51AFD7ED558CCD), two]) >> np.uint64(64 - bits)
    slots, counts = np.unique(mixed.astype("i8"), return_counts=True)
    values = 1 + np.log(counts)
    return slots, values / np.sqrt((values * values).sum())


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(rows: list[tuple[str | None, int]], settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: text and label, in the order of the updates."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    examples = [(np.append(s, size), np.append(v, 1.0), y) for (s, v), y in ((features(t, settings.bits), y) for t, y in rows)]

    def weights(at):
        own = z[at]
        w = -(own - np.sign(own) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(np.abs(own) <= settings.l1, 0.0, w)

    for _ in range(settings.epochs):
        for at, values, label in examples:
            w = weights(at)
            gradient = (_sigmoid(w @ values) - label) * values
            squares = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / settings.alpha * w
            n[at] += squares
    w = weights(np.arange(size + 1))
    return w[:-1].astype("f4"), float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> DataFrame:
    """order, label, text and doc_id of at most rows labelled documents, drawn by hash, without those of over chars characters."""
    drawn = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_doc"), F.col(label).cast("int").alias("label"))
    drawn = drawn.withColumn("order", F.xxhash64("_doc", F.lit(7))).orderBy("order", "label").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id").cast("long") == F.col("_doc"))
    return sample.where(F.coalesce(F.length("text"), F.lit(0)) <= chars).select("order", "label", "text", "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Train on a sample of labels (doc_id, label) that is drawn by hash; its size bounds what one task holds."""
    sample = labelled_sample(docs, labels, label, settings.rows, settings.chars).withColumn("one", F.lit(0))

    def run(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("order", "label", "text")), strict=True), key=lambda r: (r[0], r[1], r[2] or ""))
        weights, bias = train([(t, y) for _, y, t in rows], settings)
        return pa.table({"weights": [weights.tobytes()], "bias": [bias]})

    got = sample.groupBy("one").applyInArrow(run, "weights binary, bias double").collect()
    if not got:
        return np.zeros(1 << settings.bits, "f4"), 0.0
    return np.frombuffer(got[0].weights, "f4"), got[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and score: the probability of label 1."""
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    shape = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(parts):
        weights, bias = held.value
        for part in parts:
            scores = []
            for text in part.column(len(keep)).to_pylist():
                slots, values = features(text, settings.bits)
                scores.append(_sigmoid(float(weights[slots] @ values) + bias))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, shape)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~common.held_out(0, 5))
    scored = score(docs, fit(docs, labels, "quality"))
    return scored.select("doc_id", F.coalesce(common.held_out(0, 5), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
