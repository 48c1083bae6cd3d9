"""Zero-shot classification: the best label inside the hinted or the inferred category."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.labels import category_of, label_text
from labelweave.operators.scoring import (
    Limits,
    _sorted,
    best_columns,
    cogroup_matches,
    collect_within,
    dimensions,
    row_keyed,
    top_references,
)
from labelweave.operators.vectors import to_matrix, to_unit, unit_vector
from labelweave.plans.skew import skew_join
from labelweave.session import materialise


def label_relation(
    definitions: DataFrame, *, std_id: str = "std_id", definition: str = "definition", ord: str = "ord"
) -> DataFrame:
    """Label table ``ord, std_id, definition, std_text, category`` of a dictionary."""
    label, meaning = F.col(std_id), F.col(definition)
    return definitions.select(
        F.col(ord).cast("long").alias("ord"),
        label.alias("std_id"),
        meaning.alias("definition"),
        label_text(label, meaning).alias("std_text"),
        category_of(label).alias("category"),
    )


@dataclass(frozen=True)
class _LabelIndex:
    """Label dictionary as matrices; labels are in dictionary order, categories in order of first sight."""

    ids: pa.Array
    units: np.ndarray
    categories: list
    category_at: dict
    members: list
    centroids: np.ndarray

    @staticmethod
    def parts(table: pa.Table, dims: int) -> tuple:
        """Field values, of plain types only because they are broadcast."""
        table = _sorted(table)
        units = to_unit(to_matrix(table["vector"], dims))
        names = table["category"].to_pylist()
        categories = list(dict.fromkeys(names))
        category_at = {name: i for i, name in enumerate(categories)}
        own = np.array([category_at[name] for name in names], dtype=np.int64)
        members = [np.flatnonzero(own == i) for i in range(len(categories))]
        centroids = np.stack([units[m].mean(axis=0) for m in members]) if members else units
        ids = table["std_id"].combine_chunks().cast(pa.string())
        return ids, units, categories, category_at, members, centroids

    def candidates(self, hint: str, exact: bool) -> np.ndarray:
        """Labels of the hinted category and of those it is a prefix of."""
        if exact:
            return self.members[self.category_at[hint]]
        admitted = [m for name, m in zip(self.categories, self.members) if name.startswith(hint)]
        return np.sort(np.concatenate(admitted))


def _predict(index: _LabelIndex, rows: np.ndarray, hints: list, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best label position and its cosine per row."""
    known = np.array([index.category_at.get(h, -1) if h else -1 for h in hints], dtype=np.int64)
    scope = known.copy()
    unknown = np.flatnonzero(known < 0)
    if len(unknown):
        # The mean of the cosines over a category is the product with the mean of its unit vectors.
        scope[unknown] = best_columns(rows[unknown], index.centroids, 1)[0][:, 0]
    best, score = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    for hinted in (False, True):
        for category in np.unique(scope[(known >= 0) == hinted]):
            mine = np.flatnonzero((scope == category) & ((known >= 0) == hinted))
            labels = (
                index.candidates(index.categories[category], exact) if hinted else index.members[category]
            )
            column, similarity = best_columns(rows[mine], index.units[labels], 1)
            best[mine], score[mine] = labels[column[:, 0]], similarity[:, 0]
    return best, score


def classify(
    items: DataFrame,
    labels: DataFrame,
    *,
    item_id: str = "item_id",
    vector: str = "vector",
    hint: str | None = "hint",
    exact: bool = False,
    dims: int | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Items with ``predicted_standard`` and ``confidence``.

    ``labels`` needs ``ord, std_id, category, vector``. A hint that equals some category restricts the candidates to
    the categories it is a prefix of (``exact=True``: to itself); otherwise the category with the highest mean cosine
    is inferred. A label without category is in no scope. Ties go to the label, or category, that comes first by ``ord``. Within ``limits`` the label table is
    broadcast and no row is shuffled; a larger one is joined by category.
    """
    columns = labels.where(F.col("category").isNotNull()).select(
        F.col("ord").cast("long").alias("ord"), "std_id", "category", "vector"
    )
    table = collect_within(columns, limits)
    if table is None:
        return _classify_by_join(
            row_keyed(items, "_item_row"), columns,
            item_id="_item_row", vector=vector, hint=hint, exact=exact, dims=dims, limits=limits,
        ).drop("_item_row")
    if table.num_rows == 0:
        return items.withColumns(
            {"predicted_standard": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}
        )
    size = dimensions(table, dims)
    shared = items.sparkSession.sparkContext.broadcast(_LabelIndex.parts(table, size))

    @F.arrow_udf("struct<std_id:string,similarity:double>")
    def predict(vectors: pa.Array, hints: pa.Array) -> pa.Array:
        index = _LabelIndex(*shared.value)
        rows = to_unit(to_matrix(vectors, size))
        best, score = _predict(index, rows, hints.to_pylist(), exact)
        return pa.StructArray.from_arrays([index.ids.take(pa.array(best)), pa.array(score)], ["std_id", "similarity"])

    given = F.col(hint) if hint else F.lit(None).cast("string")
    # Marked so that a later filter on the prediction is not pushed below it, which would score every item twice.
    once = predict.asNondeterministic()
    return (
        items.withColumn("_best", once(F.col(vector), given))
        .withColumns(
            {"predicted_standard": F.col("_best.std_id"), "confidence": F.col("_best.similarity")}
        )
        .drop("_best")
    )


def category_centroids(labels: DataFrame, dims: int) -> DataFrame:
    """``(ord, category, vector)``: mean unit vector per category; sums are combined before the shuffle."""
    return (
        labels.withColumn("_unit", array_to_vector(unit_vector(F.col("vector"), dims)))
        .groupBy("category")
        .agg(F.min("ord").alias("ord"), vector_to_array(Summarizer.mean(F.col("_unit"))).alias("vector"))
    )


def _classify_by_join(
    items: DataFrame,
    labels: DataFrame,
    *,
    item_id: str,
    vector: str,
    hint: str | None,
    exact: bool,
    dims: int | None,
    limits: Limits,
) -> DataFrame:
    """The same for a label table beyond the limits: one centroid per category, then only the labels in scope."""
    labels = materialise(labels)
    if dims is None:
        dims = dimensions(labels.select("vector").where(F.size("vector") > 0).limit(1).toArrow(), None)
    categories = materialise(category_centroids(labels, dims))
    given = F.nullif(F.col(hint), F.lit("")) if hint else F.lit(None).cast("string")
    lean = items.select(item_id, F.col(vector).alias("vector"), given.alias("category"))
    known_names = categories.select("category", F.lit(True).alias("_known"))
    marked = materialise(skew_join(lean, known_names, "category", "left", spread_by=item_id))

    names = categories.select("category")
    prefixes = names.select(
        F.col("category").alias("admitted"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length("category"), F.lit(1))),
                lambda n: F.substring("category", F.lit(1), n),
            )
        ).alias("category"),
    )
    admitted = names.select("category", F.col("category").alias("admitted")) if exact else names.join(
        prefixes, "category"
    )
    hinted = skew_join(
        marked.where("_known"), admitted, "category", "inner", spread_by=item_id
    ).select(item_id, "vector", F.col("admitted").alias("scope"))
    inferred = top_references(
        marked.where(F.col("_known").isNull()).select(item_id, "vector"),
        categories.select("ord", F.col("category").alias("id"), "vector"),
        1, item_id=item_id, dims=dims, scale=False, limits=limits,
    ).select(item_id, "vector", F.col("matches")[0]["id"].alias("scope"))
    matched = cogroup_matches(
        hinted.unionByName(inferred),
        labels.select("ord", F.col("std_id").alias("id"), "vector", F.col("category").alias("scope")),
        1, item_id=item_id, dims=dims, limits=limits, out="_matches",
    )
    best = F.col("_matches")[0]
    return (
        items.join(matched, item_id, "left")
        .withColumns({"predicted_standard": best["id"], "confidence": best["similarity"]})
        .drop("_matches")
    )


def match_definitions(
    items: DataFrame,
    labels: DataFrame,
    *,
    item_id: str = "item_id",
    vector: str = "vector",
    dims: int | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Best label over all labels, no category step."""
    best = F.col("matches")[0]
    return (
        top_references(
            items, labels.withColumn("id", F.col("std_id")), 1,
            item_id=item_id, vector=vector, dims=dims, limits=limits,
        )
        .withColumns({"predicted_standard": best["id"], "confidence": best["similarity"]})
        .drop("matches")
    )


def transfer_labels(
    items: DataFrame,
    training: DataFrame,
    k: int = 5,
    *,
    item_id: str = "item_id",
    vector: str = "vector",
    dims: int | None = None,
    limits: Limits = Limits(),
    indexed: bool = False,
) -> DataFrame:
    """Majority label of the ``k`` most similar training items.

    ``training`` needs ``ord, id, vector`` with the label as ``id``. Ties in votes go to the higher best similarity,
    then to the smaller label. The vote is taken inside the row. ``indexed=True`` finds the neighbours by the metric
    index (``operators.metric_index``), with the same result, for training sets beyond the broadcast bound.
    """
    if indexed:
        from labelweave.operators.metric_index import indexed_matches

        matched = indexed_matches(items, training, k, item_id=item_id, vector=vector, dims=dims)
    else:
        matched = top_references(items, training, k, item_id=item_id, vector=vector, dims=dims, limits=limits)
    votes = F.transform(
        F.array_distinct(F.transform("matches", lambda m: m["id"])),
        lambda label: F.struct(
            (-F.size(F.filter("matches", lambda m: m["id"] == label))).alias("votes"),
            (-F.array_max(F.transform(F.filter("matches", lambda m: m["id"] == label), lambda m: m["similarity"])))
            .alias("similarity"),
            label.alias("label"),
        ),
    )
    return (
        matched.withColumn("_vote", F.array_min(votes))
        .withColumns(
            {"predicted_standard": F.col("_vote.label"), "confidence": -F.col("_vote.similarity")}
        )
        .drop("_vote", "matches")
    )


def predictions(classified: DataFrame, *, item_id: str = "item_id", truth: str = "standard") -> DataFrame:
    """``item_id, predicted_standard, true_standard, confidence``."""
    return classified.select(
        F.col(item_id).alias("item_id"), "predicted_standard", F.col(truth).alias("true_standard"), "confidence"
    )
