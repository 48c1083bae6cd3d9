"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.llm.shared import crc_mod, first_rows, plain_broadcast, rebuilt, stored

BITS = 20
ORDERS = (4, 5, 6)
#: Labelled documents of each class that a model is fitted on at most, and their characters at most: the documents of
#: smallest hash are taken until either bound is reached, so what reaches the driver is bounded by bytes, not rows alone.
SAMPLE = 3000
SAMPLE_CHARS = 2_000_000
SMOOTHING = 1.0
#: Documents of the sample that hold a feature at least.
MIN_DOCS = 5
#: Entries of the feature matrix that a training step works on at a time.
ENTRIES = 1 << 20


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a whole text as they occur, repeats included; case and runs of white space don't matter."""
    points = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32)
    parts = []
    with np.errstate(over="ignore"):
        for order in ORDERS:
            n = len(points) - order + 1
            if n <= 0:
                continue
            code = np.full(n, 2166136261 + order, np.uint32)
            for i in range(order):
                code = (code ^ points[i : i + n]) * np.uint32(16777619)
            code ^= code >> np.uint32(15)
            code *= np.uint32(2246822519)
            parts.append(code >> np.uint32(32 - BITS))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


@dataclass
class NaiveBayesLinear:
    """Weights over presence features, each already times its log-count ratio."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        def total(text: str | None) -> float:
            codes = grams(text)
            present = np.unique(codes[self.weights[codes] != 0])
            return self.weights[present].sum(dtype=np.float64)

        sums = np.fromiter(map(total, texts), np.float64)
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))


def log_count_ratio(toxic, clean, n_toxic: int, n_clean: int):
    """Log ratio of the shares of toxic and clean documents that hold a feature."""
    return np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))


def fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, epochs: int = 300, l2: float = 1e-3) -> tuple:
    """Logistic regression over features times ``scale``; rows are lists of feature numbers.

    Accelerated full-batch gradient steps, sized by the largest curvature; both classes weigh the same.
    """
    n_docs, sizes = len(rows), np.array([len(r) for r in rows])
    columns = np.concatenate(rows).astype(np.int32, copy=False)
    docs = np.repeat(np.arange(n_docs, dtype=np.uint16 if n_docs < 1 << 16 else np.int32), sizes)
    docs = docs[np.argsort(columns, kind="stable")]
    per_column = np.bincount(columns, minlength=len(scale))

    def sums(values: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of ``values[of]`` over runs of ``sizes``; a part of the runs at a time."""
        out, ends = np.zeros(len(sizes)), np.cumsum(sizes)
        cuts = [*np.flatnonzero(np.diff(ends // ENTRIES, prepend=-1)), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            full = np.flatnonzero(sizes[a:b]) + a
            if len(full):
                first = ends[a] - sizes[a]
                out[full] = np.add.reduceat(values[of[first : ends[b - 1]]], ends[full] - sizes[full] - first)
        return out

    forth = lambda w: sums(scale * w, columns, sizes)
    back = lambda e: sums(e, docs, per_column) * scale
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    curve, probe = 1.0, np.ones(len(scale))
    for _ in range(10):
        image = back(balance * forth(probe))
        curve = max(float(np.linalg.norm(image)), 1e-12)
        probe = image / curve
    step = 1 / (0.25 * (curve + 1) + l2)
    w, ahead, bias, ahead_bias = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0
    for k in range(epochs):
        error = (1 / (1 + np.exp(-np.clip(forth(ahead) + ahead_bias, -30, 30))) - y) * balance
        new, new_bias = ahead - step * (back(error) + l2 * ahead), ahead_bias - step * error.sum()
        momentum = k / (k + 3)
        ahead, ahead_bias = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and clean documents hold each feature, one row per feature and task."""
    total = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"]):
            total[int(toxic), np.unique(grams(text))] += 1
    code = np.flatnonzero(total.sum(axis=0))
    yield pd.DataFrame({"code": code, "clean": total[0, code], "toxic": total[1, code]})


def _features(selected: np.ndarray):
    """Distinct selected features of each text, looked up in a mask of the feature space."""
    chosen = np.zeros(1 << BITS, bool)
    chosen[selected] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []
            for text in batch["text"]:
                codes = grams(text)
                held.append(np.unique(codes[chosen[codes]]).astype(np.int32).tobytes())
            yield pd.DataFrame({"toxic": batch["toxic"].to_numpy(), "codes": held})

    return run


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, held: int = 1, sample_chars: int = SAMPLE_CHARS
) -> NaiveBayesLinear:
    """Fit on labelled documents whose crc32 of the id isn't ``held`` modulo ``folds``.

    At most ``sample`` documents of each class, those of the smallest hashes of their ids, and of those only as many as
    hold ``sample_chars`` characters together (the first one always), so training costs the same at any size of corpus
    and what is collected is bounded in bytes. Features are all n-grams in ``MIN_DOCS`` documents or more; how far to trust one is left to its
    log-count ratio and the penalty. Rows with a null id, text or label teach nothing. With one class only, or no feature, the
    model is constant.
    """
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(crc_mod(F.col("doc_id"), folds) != held)
    chosen = [first_rows(known.filter(F.col("toxic") == t), ["doc_id"], sample, "toxicity") for t in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # two times ``sample`` rows at most
    joined = docs.filter("text is not null").select("doc_id", "text").join(ids, "doc_id")
    # A window over at most 2 x ``sample`` rows: the running length in the order of the sample's hash.
    order = Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id", F.xxhash64("text"))
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts = stored(joined.withColumn("_before", before).filter(F.col("_before") < sample_chars).select("toxic", "text"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not n_clean or not n_toxic:
        return NaiveBayesLinear(weights, 4.0 if n_toxic else -4.0)
    counted = (
        texts.mapInPandas(_counts, "code int, clean int, toxic int")
        .groupBy("code")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("clean") + F.col("toxic") >= MIN_DOCS)
        .toPandas()  # no more rows than the feature space has
    )
    counted = counted.sort_values("code")
    selected = counted["code"].to_numpy()
    scale = log_count_ratio(counted["toxic"].to_numpy(), counted["clean"].to_numpy(), n_toxic, n_clean)
    if not len(selected):
        return NaiveBayesLinear(weights, float(np.log(n_toxic / n_clean)))
    rows = texts.mapInPandas(_features(selected), "toxic int, codes binary").collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["codes"])))
    toxic = np.array([r["toxic"] for r in rows], np.float64)
    numbers = [np.searchsorted(selected, np.frombuffer(r["codes"], np.int32)).astype(np.int32) for r in rows]
    del rows
    learned, bias = fit(numbers, toxic, scale)
    weights[selected] = learned * scale
    return NaiveBayesLinear(weights, float(bias))


def toxicity(text: Column, model: NaiveBayesLinear) -> Column:
    """Score column, 0 to 1. Texts of an Arrow batch become Python strings one at a time, so a worker never holds a
    batch of them a second time."""
    shared = plain_broadcast(SparkSession.active(), model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = rebuilt(NaiveBayesLinear, shared.value)
        for texts in batches:
            yield pa.array(found.scores(text.as_py() for text in texts))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted (1 from ``threshold`` on), one row per row.

    Null and empty texts have no n-grams and take the score of the bias. A null id is not held out. Only whole texts enter
    a score; other columns are ignored.
    """
    model = train(docs, labels)
    scored = docs.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        toxicity(F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` less the rows whose text scores ``threshold`` or more."""
    return docs.filter(toxicity(F.col("text"), train(docs, labels)) < threshold)
