"""Language of a text by a byte convolutional network, trained in numpy on labelled text.

Bytes are embedded, filters of several widths run over windows of a fixed length, each filter keeps its largest response in
a window, and a softmax gives the languages. A text's answer is the mean over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.shared import crc_mod, plain_broadcast, rebuilt, stored

WINDOW, EMBEDDED, WIDTHS, FILTERS = 256, 4, (2, 3, 4), 8
WIDEST = max(WIDTHS)
#: Labelled documents of each language, windows of each document and languages that a model is trained on at most.
SAMPLE, SAMPLE_WINDOWS, LANGUAGES = 400, 4, 512
#: Windows that go through the network at a time.
BATCH = 2048
UNKNOWN = "und"


def windows_of(text: str) -> np.ndarray:
    """All bytes of a text as rows of ``WINDOW`` bytes; a window ends with the first bytes of the next, so that no filter
    position is lost, and the last is filled with spaces."""
    raw = text.encode("utf-8", "replace")
    n = max(1, -(-len(raw) // WINDOW))
    flat = np.full(n * WINDOW + WIDEST - 1, 32, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW + WIDEST - 1)[::WINDOW]


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDED
    filters: np.ndarray  # (WIDEST * EMBEDDED) x (FILTERS of each width), zero beyond a filter's width
    filter_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patches and filter responses, windows x positions x filters."""
        embedded = self.embedding[windows].reshape(len(windows), -1)
        patches = np.lib.stride_tricks.sliding_window_view(embedded, WIDEST * EMBEDDED, axis=1)[:, ::EMBEDDED]
        patches = np.ascontiguousarray(patches)
        return patches, patches.reshape(-1, WIDEST * EMBEDDED) @ self.filters

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        _, response = self.pooled(windows)
        best = response.reshape(len(windows), WINDOW, -1).max(axis=1)
        z = np.maximum(best + self.filter_bias, 0) @ self.output + self.output_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def mean_probabilities(self, texts: list[str]) -> np.ndarray:
        """Of each text, over all of its windows. Windows of many texts share a batch; sums keep their order."""
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        pending, owners, held = [], [], 0

        def flush() -> None:
            rows = np.concatenate(pending)
            owner = np.concatenate(owners)
            for at in range(0, len(rows), BATCH):
                np.add.at(total, owner[at : at + BATCH], self.probabilities(rows[at : at + BATCH]))

        for i, text in enumerate(texts):
            rows = windows_of(text)
            count[i] = len(rows)
            pending.append(rows)
            owners.append(np.full(len(rows), i))
            held += len(rows)
            if held >= BATCH:
                flush()
                pending, owners, held = [], [], 0
        if held:
            flush()
        return total / count[:, None]


def train_network(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 14) -> ByteNetwork:
    """Adam on cross-entropy in batches of 64 windows; languages weigh the same."""
    rng = np.random.default_rng(11)
    wide = FILTERS * len(WIDTHS)
    mask = np.zeros((WIDEST * EMBEDDED, wide), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBEDDED, k * FILTERS : (k + 1) * FILTERS] = 1
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = ByteNetwork(
        languages, normal(256, EMBEDDED, scale=0.5), normal(WIDEST * EMBEDDED, wide, scale=0.3) * mask,
        np.zeros(wide, np.float32), normal(wide, len(languages), scale=0.2), np.zeros(len(languages), np.float32),
    )
    names = ("embedding", "filters", "filter_bias", "output", "output_bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    share = len(labels) / np.maximum(np.bincount(labels, minlength=len(languages)), 1) / len(languages)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            rows, y = windows[order[at : at + 64]], labels[order[at : at + 64]]
            n = len(rows)
            patches, response = net.pooled(rows)
            response = response.reshape(n, WINDOW, wide)
            where = response.argmax(axis=1)
            best = np.take_along_axis(response, where[:, None], axis=1)[:, 0] + net.filter_bias
            active = np.maximum(best, 0)
            z = active @ net.output + net.output_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(n), y] -= 1
            error *= (share[y] / n)[:, None]
            error = error.astype(np.float32)
            back = (error @ net.output.T) * (best > 0)
            chosen = np.take_along_axis(patches, where[:, :, None], axis=1)  # windows x filters x patch
            into = back[:, :, None] * net.filters.T[None]
            grad = {
                "output": active.T @ error, "output_bias": error.sum(axis=0), "filter_bias": back.sum(axis=0),
                "filters": np.einsum("nf,nfp->pf", back, chosen) * mask, "embedding": np.zeros_like(net.embedding),
            }
            bytes_at = np.take_along_axis(rows[:, None, :], where[:, :, None] + np.arange(WIDEST), axis=2)
            np.add.at(grad["embedding"], bytes_at, into.reshape(n, wide, WIDEST, EMBEDDED))
            step += 1
            rate = 0.01 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name in names:
                first[name] = 0.9 * first[name] + 0.1 * grad[name]
                second[name] = 0.999 * second[name] + 0.001 * grad[name] ** 2
                setattr(net, name, (getattr(net, name) - rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32))
    return net


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of labelled texts, evenly spaced where a text has more than its share."""
    for batch in batches:
        rows = []
        for lang, text in zip(batch["lang"], batch["text"]):
            windows = windows_of(text)
            for i in np.unique(np.linspace(0, len(windows) - 1, SAMPLE_WINDOWS).astype(int)):
                rows.append((lang, windows[i].tobytes()))
        yield pd.DataFrame(rows, columns=["lang", "window"])


def train(docs: DataFrame, folds: int = 5, held: int = 0) -> ByteNetwork:
    """Train on text and lang of documents whose crc32 of the id isn't ``held`` modulo ``folds``.

    Of each language the ``SAMPLE`` documents with the smallest hashes of their ids serve, with ``SAMPLE_WINDOWS`` windows
    each, so training costs the same at any size of corpus; they are found in one scan, by a ranked window within each
    task and then within each language over what the tasks kept. Of more than ``LANGUAGES`` values of lang the most
    frequent are learned and the others teach nothing. Rows with a null id, text or lang teach nothing.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).filter(
        crc_mod(F.col("doc_id"), folds) != held
    )
    # The most frequent languages, LANGUAGES at most; documents of rarer values beyond that teach nothing.
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    if not names:
        return ByteNetwork([], *[np.zeros(0, np.float32)] * 5)
    # One scan: the SAMPLE smallest hashes per language within each task, then per language over those.
    order = F.xxhash64(F.lit("language"), "doc_id")
    hashed = known.filter(F.col("lang").isin(names)).select("doc_id", "lang", order.alias("_h"))
    local = Window.partitionBy("_part", "lang").orderBy("_h", "doc_id")
    whole = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = (
        hashed.withColumn("_part", F.spark_partition_id())
        .withColumn("_r", F.row_number().over(local))
        .filter(F.col("_r") <= SAMPLE)
        .withColumn("_r", F.row_number().over(whole))
        .filter(F.col("_r") <= SAMPLE)
        .select("doc_id", "lang")
    )
    ids = F.broadcast(chosen)  # SAMPLE rows of each language at most
    sample = stored(docs.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"]).select("lang", "text"), "langs")
    rows = sorted(sample.mapInPandas(_sampled, "lang string, window binary").collect())
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(len(rows), -1)
    return train_network(windows, np.array([names.index(r["lang"]) for r in rows]), names)


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Language of every text: doc_id, held_out, lang_pred, score (mean probability of the answer), one row per row.

    A null text and one without a letter are ``und`` with score 0, and so is every text where nothing could be learned.
    Ties go to the language that sorts first. Texts are read whole. A null id is not held out. Only text enters a
    prediction; other columns are ignored.
    """
    network = plain_broadcast(docs.sparkSession, train(docs, folds, held))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = rebuilt(ByteNetwork, network.value)
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if t and net.languages and any(map(str.isalpha, t))]
            if lettered:
                mean = net.mean_probabilities([texts.iloc[i] for i in lettered])
                best = mean.argmax(axis=1)
                lang[lettered] = np.array(net.languages, object)[best]
                score[lettered] = np.minimum(mean[np.arange(len(best)), best], 1.0)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    held_out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), predict("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
