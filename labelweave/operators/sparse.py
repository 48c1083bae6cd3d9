"""Best label by cosine over sparse term vectors: inverted lists with their largest weight, MaxScore pruning.

Label vectors become inverted lists: for every term, the labels that hold it with their normalised weight, and the
largest weight of the list. An item visits its terms in the order of their bound (its own weight times the list's
largest weight). New labels are admitted only while the bounds of the terms not yet visited could still reach the best
score found; after that the remaining lists only complete the admitted labels. A label that was never admitted scores
at most that remaining bound, below the best, so the result equals the exhaustive cosine. Nothing is dense: terms may be
any integers, without a limit on the number of dimensions.

Similarities are compared at ``DECIMALS`` decimals and the smaller ``ord`` wins ties, as in ``top_references``; an
item that shares no term with any label gets the first label with similarity 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators.scoring import DECIMALS

#: Postings (label-term pairs) an index may hold to be broadcast.
MAX_POSTINGS = 20_000_000
#: Scores within this of the best are kept, so that rounding to DECIMALS decides ties as in the dense way.
MARGIN = 1e-8


def unit_terms(buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a bucket list and their weights, scaled to length 1; an empty list has none."""
    if buckets is None or len(buckets) == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    terms, counts = np.unique(np.asarray(buckets, dtype=np.int64), return_counts=True)
    return terms, counts / np.sqrt((counts.astype(np.float64) ** 2).sum())


@dataclass(frozen=True)
class InvertedLabels:
    """Labels sorted by ord; per term (sorted) its postings (label position, weight) and their largest weight."""

    ords: np.ndarray
    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    top: np.ndarray

    @staticmethod
    def build(rows: pd.DataFrame) -> InvertedLabels:
        rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
        term_parts, label_parts, weight_parts = [], [], []
        for position, buckets in enumerate(rows["vector"]):
            terms, weights = unit_terms(buckets)
            term_parts.append(terms)
            weight_parts.append(weights)
            label_parts.append(np.full(len(terms), position, np.int64))
        terms = np.concatenate(term_parts) if term_parts else np.zeros(0, np.int64)
        labels = np.concatenate(label_parts) if label_parts else np.zeros(0, np.int64)
        weights = np.concatenate(weight_parts) if weight_parts else np.zeros(0)
        order = np.lexsort((labels, terms))
        terms, labels, weights = terms[order], labels[order], weights[order]
        unique, starts = np.unique(terms, return_index=True)
        starts = np.append(starts, len(terms))
        top = np.maximum.reduceat(weights, starts[:-1]) if len(unique) else np.zeros(0)
        return InvertedLabels(
            rows["ord"].to_numpy(np.int64), rows["id"].astype(str).to_numpy(), unique, starts, labels, weights, top
        )

    def best(self, buckets) -> tuple[int, float, int]:
        """(label position, rounded similarity, products done) of one item."""
        terms, weights = unit_terms(buckets)
        at = np.searchsorted(self.terms, terms)
        known = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else at < 0
        at, weights = at[known], weights[known]
        bound = weights * self.top[at]
        order = np.argsort(-bound, kind="stable")
        at, weights, bound = at[order], weights[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        score = np.zeros(len(self.ords))
        best, products, j = 0.0, 0, 0
        begin, end, own, left = self.starts[at].tolist(), self.starts[at + 1].tolist(), weights.tolist(), rest.tolist()
        while j < len(own) and left[j] >= best - MARGIN and left[j] > 0:
            lo, hi = begin[j], end[j]
            mine = self.labels[lo:hi]
            score[mine] = reached = score[mine] + own[j] * self.weights[lo:hi]
            products += hi - lo
            best = max(best, float(reached.max()))
            j += 1
        admitted = score > 0  # every weight is above 0
        if j < len(at):  # the remaining lists at once, in the same order
            lo, size = self.starts[at[j:]], self.starts[at[j:] + 1] - self.starts[at[j:]]
            place = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            mine = admitted[self.labels[place]]
            place = place[mine]
            np.add.at(score, self.labels[place], np.repeat(weights[j:], size)[mine] * self.weights[place])
            products += len(place)
        rounded = np.round(score, DECIMALS)
        if not admitted.any() or rounded.max() <= 0:
            return 0, 0.0, products
        winner = int(np.flatnonzero(rounded == rounded[admitted].max())[0])
        return winner, float(rounded[winner]), products


def _block_best(items: DataFrame, rows: pd.DataFrame, vector: str) -> DataFrame:
    index = InvertedLabels.build(rows)
    shared = items.sparkSession.sparkContext.broadcast(
        (index.ords, index.ids, index.terms, index.starts, index.labels, index.weights, index.top)
    )

    @F.pandas_udf("predicted_standard string, confidence double, _ord long, products long")
    def best(vectors: pd.Series) -> pd.DataFrame:
        found = InvertedLabels(*shared.value)
        out = [found.best(v) for v in vectors]
        return pd.DataFrame(
            {
                "predicted_standard": [found.ids[w] for w, _, _ in out],
                "confidence": [s for _, s, _ in out],
                "_ord": [int(found.ords[w]) for w, _, _ in out],
                "products": [p for _, _, p in out],
            }
        )

    return items.withColumn("_best", best(F.col(vector))).select("*", "_best.*").drop("_best")


def sparse_matches(items: DataFrame, labels: DataFrame, *, item_id: str = "item_id", vector: str = "vector") -> DataFrame:
    """``items`` with ``predicted_standard``, ``confidence`` and ``products``: the best label by sparse cosine.

    ``labels`` needs ``ord`` (unique), ``std_id`` and ``vector`` (a list of integer terms). Postings are counted first;
    up to ``MAX_POSTINGS`` the index is broadcast once as plain arrays. Beyond it labels are cut into blocks of about
    that many postings by a hash of ``ord``, each block is broadcast and scored in turn, and the best of the blocks is
    kept per item (higher similarity, then smaller ord), so no label is dropped. Items without labels get null.
    """
    table = labels.select(F.col("ord").cast("long").alias("ord"), F.col("std_id").alias("id"), F.col(vector).alias("vector"))
    postings = table.select(F.size(F.array_distinct("vector")).alias("n")).agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-postings // MAX_POSTINGS))
    if blocks == 1:
        rows = table.toPandas()
        if rows.empty:
            return items.withColumns(
                {"predicted_standard": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"),
                 "products": F.lit(0).cast("long")}
            )
        return _block_best(items, rows, vector).drop("_ord")
    keyed = items.withColumn("_sparse_row", F.monotonically_increasing_id())
    from labelweave.session import materialise

    keyed = materialise(keyed)
    found = None
    for block in range(blocks):
        rows = table.filter(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == block).toPandas()
        if rows.empty:
            continue
        part = _block_best(keyed.select("_sparse_row", vector), rows, vector).drop(vector)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("confidence", (-F.col("_ord")).alias("_late"), "predicted_standard"))
    chosen = found.groupBy("_sparse_row").agg(best.alias("_b"), F.sum("products").alias("products"))
    return keyed.join(chosen, "_sparse_row").select(
        *items.columns, "_b.predicted_standard", "_b.confidence", "products"
    )
