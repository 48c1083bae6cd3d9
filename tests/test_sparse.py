"""Sparse cosine by inverted lists against the dense matrix product: equal winners, ties and empty texts included."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from labelweave.operators import sparse
from labelweave.operators.classify import match_definitions


def frames(spark, rng):
    labels = [(i, f"S{i}", [int(x) for x in rng.integers(0, 60, size=rng.integers(0, 12))]) for i in range(80)]
    labels[5] = (5, "S5", labels[4][2])  # an equal vector: the smaller ord wins
    items = [(i, [int(x) for x in rng.integers(0, 60, size=rng.integers(0, 20))]) for i in range(300)]
    items.append((300, []))
    items.append((301, [500, 501]))  # no term in common with any label
    return (
        spark.createDataFrame(items, "item_id long, vector array<int>"),
        spark.createDataFrame(labels, "ord long, std_id string, vector array<int>"),
    )


def winners(df):
    return {r["item_id"]: (r["predicted_standard"], r["confidence"]) for r in df.collect()}


def test_sparse_equals_dense(spark, monkeypatch):
    items, labels = frames(spark, np.random.default_rng(5))
    dense = winners(match_definitions(items, labels, dims=512))
    assert winners(sparse.sparse_matches(items, labels)) == dense
    monkeypatch.setattr(sparse, "MAX_POSTINGS", 100)  # blocks of labels, merged per item
    assert winners(sparse.sparse_matches(items, labels)) == dense


def test_pruning_does_fewer_products_than_all_postings(spark):
    items, labels = frames(spark, np.random.default_rng(9))
    done = sum(r["products"] for r in sparse.sparse_matches(items, labels).collect())
    index = sparse.InvertedLabels.build(labels.selectExpr("ord", "std_id AS id", "vector").toPandas())
    lengths = np.diff(index.starts)
    every = 0
    for r in items.collect():
        terms = np.unique(np.asarray(r["vector"], dtype=np.int64))
        at = np.searchsorted(index.terms, terms)
        hit = (at < len(index.terms)) & (index.terms[np.minimum(at, len(index.terms) - 1)] == terms)
        every += int(lengths[at[hit]].sum())
    assert 0 < done < every


def test_lists_behind_the_bound_are_completed_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"ord": range(150), "id": [f"S{i}" for i in range(150)]})
    rows["vector"] = [rng.integers(0, 300, size=40) for _ in range(150)]
    index = sparse.InvertedLabels.build(rows)
    dense = np.zeros((150, 300))
    for i, vector in enumerate(rows["vector"]):
        terms, weights = sparse.unit_terms(vector)
        dense[i, terms] = weights
    adds = []
    add = np.add
    counting = SimpleNamespace(at=lambda *a: adds.append(len(a[1])) or add.at(*a))
    monkeypatch.setattr(np, "add", counting)
    for i in range(100):
        item = np.concatenate((rows["vector"][i], rng.integers(0, 300, size=30)))
        terms, weights = sparse.unit_terms(item)
        score = np.round(dense[:, terms] @ weights, 9)
        winner, confidence, _ = index.best(item)
        assert (winner, confidence) == (int(score.argmax()), float(score.max()))
    assert adds and len(adds) <= 100 and sum(adds) > 0


def test_no_labels(spark):
    items, labels = frames(spark, np.random.default_rng(1))
    got = sparse.sparse_matches(items, labels.limit(0)).collect()
    assert len(got) == 302 and all(r["predicted_standard"] is None for r in got)
