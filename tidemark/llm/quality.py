"""Quality classifier: naive Bayes features for a support vector machine.

Features are indicators of n-grams: words (1, 2) and word shapes (1 to 3), hashed into `buckets`. Each indicator is
scaled by its log-count ratio between the classes; a linear hinge-loss model over these is fitted by dual coordinate
descent, and its margin is turned into a probability on rows that the fit has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import held_out, sole_cache, table


@dataclass(frozen=True)
class QualityConfig:
    sample_per_class: int = 2500  # bound of the labelled sample that the model is fitted on ...
    sample_chars: int = 16_000_000  # ... and of the characters of its texts a class, so of the driver's memory
    buckets: int = 1 << 18
    smoothing: float = 1.0
    c: float = 0.1
    epochs: int = 12
    accept: float = 0.7
    seed: int = 7


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # per bucket, with the log-count ratio inside
    bias: float
    slope: float
    shift: float
    buckets: int

    def score(self, text: str | None) -> float:
        at = indicators(text, self.buckets)
        margin = (float(self.weights[at].sum()) / np.sqrt(len(at)) if len(at) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


_RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x"), (re.compile(r"\d+"), lambda m: "9")]


class _Tokens(dict):
    """Of each word the hashes of the word and of its shape, as 16 bytes."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        shape = word
        for pattern, to in _RUNS:
            shape = pattern.sub(to, shape)
        self[word] = h = (xxhash.xxh3_64_intdigest(word.lower()) | xxhash.xxh3_64_intdigest(shape, 1) << 64).to_bytes(16, "little")
        return h


_TOKENS = _Tokens()


def _own_cache() -> None:
    """For tasks: functions that are shipped to them would bring copies of the module's names along, this one is looked up there."""
    sole_cache(_TOKENS)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def indicators(text: str | None, buckets: int) -> np.ndarray:
    """Sorted distinct buckets of the whole text's n-grams."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    h = np.frombuffer(b"".join(map(_TOKENS.__getitem__, words)), "<u8").reshape(-1, 2)
    word, shape = h[:, 0], h[:, 1]
    two = word[:-1] * _MUL + word[1:]
    shape2 = shape[:-1] * _MUL + shape[1:]
    shape3 = shape2[:-1] * _MUL + shape[2:] if len(words) > 2 else np.empty(0, np.uint64)
    grams = np.concatenate([word, two, shape, shape2, shape3])
    grams = (grams ^ (grams >> np.uint64(31))) * _MUL
    return np.unique((grams >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, c: QualityConfig) -> DataFrame:
    """(doc_id, quality) of at most sample_per_class training rows a class, those whose ids hash lowest, until their texts reach sample_chars."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    sized = docs.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = marked.join(sized, "doc_id").select("*", F.row_number().over(order).alias("turn")).where(F.col("turn") <= c.sample_per_class)
    before = F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.select("doc_id", "quality", before.alias("before")).where(F.col("before") < c.sample_chars).select("doc_id", "quality")


def descend(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, c: QualityConfig) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model, one dual variable at a time.

    Documents get the same weight each whatever their class, so classes are balanced by the upper bound of their variables.
    """
    rng = np.random.default_rng(c.seed)
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[at] / np.sqrt(max(1, len(at))) for at in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    share = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    for _ in range(c.epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c.c * share[y[i]])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton steps with a little shrinkage."""
    x, t = np.stack([margins, np.ones(len(margins))], 1), (y > 0).astype(float)
    b = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * b)
        b += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel:
    """The model, learned from a bounded sample of the labelled rows that are not held out. One class only or none: a constant."""
    c = config
    drawn = sample(docs, labels, c)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_cache()
        for batch in batches:
            at = [indicators(t, c.buckets).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "quality", "at"])

    ids = drawn.collect()  # at most twice sample_per_class
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, int(r.quality)) for r in ids], "doc_id long, quality int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    got = sorted(texts.mapInArrow(featurize, "doc_id long, quality int, at array<int>").collect(), key=lambda r: (r.doc_id, r.quality))
    rows = [np.array(r["at"], np.int64) for r in got]
    y = np.array([1 if r.quality else -1 for r in got])
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(c.buckets), 0.0, 1.0, 0.0 if not len(y) else float(y[0]) * 3, c.buckets)
    order = np.random.default_rng(c.seed).permutation(len(rows))
    apart = np.zeros(len(rows), bool)
    apart[order[: max(1, len(rows) // 5)]] = True

    counts = np.full((2, c.buckets), c.smoothing)
    for at, label, out in zip(rows, y, apart, strict=True):
        if not out:
            counts[int(label > 0), at] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = descend([r for r, out in zip(rows, apart, strict=True) if not out], ratio, y[~apart], c)
    model = QualityModel(w * ratio, bias, 1.0, 0.0, c.buckets)
    seen = np.flatnonzero(apart) if len(set(y[apart].tolist())) == 2 else np.arange(len(rows))
    margins = np.array([(float(model.weights[rows[i]].sum()) / np.sqrt(len(rows[i])) if len(rows[i]) else 0.0) + bias for i in seen])
    slope, shift = calibrate(margins, y[seen])
    return QualityModel(model.weights.astype(np.float32), bias, slope, shift, c.buckets)


def score_column(model: QualityModel, spark: SparkSession):
    shared = spark.sparkContext.broadcast(model)  # one float per bucket

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _own_cache()
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return score


def score_quality(docs: DataFrame, model: QualityModel, config: QualityConfig = QualityConfig()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Only the text is looked at; null and empty texts get the score of no n-gram at all. Repeated rows get the same
    values, an empty table gives an empty result.
    """
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, docs.sparkSession)(F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= config.accept).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below `accept` go.

    Null and empty texts, which have no features, all get the score of the model's bias and so stay or go together. Very long texts are scored
    whole. Ids take no part: rows without one, and repeated rows, are judged by their texts.
    """
    c = QualityConfig()
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), c)
    return docs.where(score_column(model, spark)(F.col("text")) >= c.accept)
