"""Evaluation of predictions: accuracy, per-label tables, confusion, label overlap, comparison of approaches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.labels import accuracy_tier, category_of, percent, verdict

TRUTH, PREDICTED = "true_standard", "predicted_standard"


def attach_truth(predictions: DataFrame, truth: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Inner equi-join of predictions with the labelled items (F1)."""
    return truth.join(predictions, item_id, "inner")


def is_correct() -> Column:
    """1 for a right prediction, 0 for a wrong one or a missing truth."""
    return F.coalesce(F.col(PREDICTED) == F.col(TRUTH), F.lit(False)).cast("long")


def accuracy(predictions: DataFrame, *by: str) -> DataFrame:
    """``total, correct, accuracy, percent, verdict`` over all rows, per group when ``by`` is given.

    A row without truth counts as wrong. The accuracy of no rows is null. Group by a hint marker to keep the rows
    whose category came from a hint apart from the rest.
    """
    share = F.avg(is_correct())
    aggregated = predictions.groupBy(*by) if by else predictions
    return aggregated.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(is_correct()), F.lit(0)).alias("correct"),
        share.alias("accuracy"),
    ).withColumns({"percent": percent(F.col("accuracy")), "verdict": verdict(F.col("accuracy"))})


def per_label(predictions: DataFrame) -> DataFrame:
    """Right and all predictions per true label, rows without truth left out."""
    return (
        predictions.where(F.col(TRUTH).isNotNull())
        .groupBy(F.col(TRUTH).alias("standard"))
        .agg(
            F.sum(is_correct()).alias("correct"),
            F.count(F.lit(1)).alias("total"),
            F.avg(is_correct()).alias("accuracy"),
        )
    )


def per_label_accuracy(predictions: DataFrame) -> DataFrame:
    """``per_label``, most frequent label first."""
    return per_label(predictions).orderBy(F.desc("total"), "standard")


def performance_table(predictions: DataFrame) -> DataFrame:
    """Accuracy in percent with its tier, worst label first."""
    return (
        per_label(predictions)
        .withColumn("tier", accuracy_tier(F.col("accuracy")))
        .withColumn("accuracy", percent(F.col("accuracy")))
        .orderBy("accuracy", "standard")
    )


def top_labels(truth: DataFrame, k: int = 6, label: str = TRUTH) -> DataFrame:
    """The ``k`` most frequent labels, ties by label."""
    return (
        truth.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("standard"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "standard")
        .limit(k)
    )


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts per pair of true and predicted label that occurs."""
    return (
        predictions.where(F.col(TRUTH).isNotNull())
        .groupBy(TRUTH, PREDICTED)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_topk(predictions: DataFrame, k: int = 6) -> DataFrame:
    """Long confusion matrix over the ``k`` most frequent true labels on both axes, zeros filled.

    Both the ranking and the cells come from the counts per pair, so predictions are read once.
    """
    pairs = confusion(predictions)
    top = (
        pairs.groupBy(TRUTH).agg(F.sum("n").alias("_total")).orderBy(F.desc("_total"), TRUTH).limit(k)
    )
    listed = top.agg(F.sort_array(F.collect_list(TRUTH)).alias("_top"))
    cells = listed.select(F.explode("_top").alias("_t"), "_top").select("_t", F.explode("_top").alias("_p"))
    # At most k * k distinct rows, whatever the input. The null-safe inner join adds no filter below the counts, so
    # all three uses of them share one shuffle.
    in_cell = F.col(TRUTH).eqNullSafe(F.col("_t")) & F.col(PREDICTED).eqNullSafe(F.col("_p"))
    counted = pairs.join(F.broadcast(cells), in_cell, "inner").select(TRUTH, PREDICTED, "n")
    zeros = cells.select(F.col("_t").alias(TRUTH), F.col("_p").alias(PREDICTED), F.lit(0).cast("long").alias("n"))
    return counted.unionByName(zeros).groupBy(TRUTH, PREDICTED).agg(F.sum("n").alias("n"))


def confusion_matrix(predictions: DataFrame, k: int = 6) -> DataFrame:
    """``confusion_topk`` with one column per predicted label (F6); reads the k names first."""
    names = [row["standard"] for row in top_labels(predictions, k).collect()]
    return (
        predictions.where(F.col(TRUTH).isin(names))
        .groupBy(TRUTH)
        .pivot(PREDICTED, names)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def category_confusion(predictions: DataFrame) -> DataFrame:
    """Counts per pair of true and predicted category, with a flag for those that differ."""
    true_category, predicted_category = category_of(F.col(TRUTH)), category_of(F.col(PREDICTED))
    return (
        predictions.where(F.col(TRUTH).isNotNull())
        .groupBy(true_category.alias("true_category"), predicted_category.alias("predicted_category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("crossed", ~F.col("true_category").eqNullSafe(F.col("predicted_category")))
    )


def label_counts(train: DataFrame, test: DataFrame, label: str = "standard") -> DataFrame:
    """Distinct labels of both sides and of their intersection in one pass over the two."""
    marked = _sides(train, test, label)
    return marked.agg(
        F.coalesce(F.sum("in_train"), F.lit(0)).cast("long").alias("train_labels"),
        F.coalesce(F.sum("in_test"), F.lit(0)).cast("long").alias("test_labels"),
        F.coalesce(F.sum(F.col("in_train") * F.col("in_test")), F.lit(0)).cast("long").alias("overlap"),
    )


def _sides(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    both = train.select(label, F.lit(1).alias("in_train"), F.lit(0).alias("in_test")).unionByName(
        test.select(label, F.lit(0).alias("in_train"), F.lit(1).alias("in_test"))
    )
    return both.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.max("in_train").alias("in_train"), F.max("in_test").alias("in_test")
    )


def label_overlap(train: DataFrame, test: DataFrame, label: str = "standard") -> DataFrame:
    """Labels that occur on both sides (F8), from counts that combine before their shuffle."""
    return _sides(train, test, label).where((F.col("in_train") == 1) & (F.col("in_test") == 1)).select(label)


def tier_counts(predictions: DataFrame) -> DataFrame:
    """Labels in all, at 100 % and at 50 % or more."""
    return per_label(predictions).agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(F.col("accuracy") == 1.0).alias("perfect"),
        F.count_if(F.col("accuracy") >= 0.5).alias("good"),
    )


def _share(part: Column, whole: Column) -> Column:
    percentage = F.format_string("%.0f", F.when(whole > 0, 100.0 * part / whole).otherwise(0.0))
    return F.concat(part.cast("string"), F.lit(" / "), whole.cast("string"), F.lit(" ("), percentage, F.lit("%)"))


def summary_table(
    predictions: DataFrame, train: DataFrame, test: DataFrame, texts: DataFrame, text: str, dims: int
) -> DataFrame:
    """Metric and value, both as text, everything computed.

    Predictions are reduced to one row per true label first, so every figure on them comes from a single pass.
    """
    labels = predictions.groupBy(TRUTH).agg(
        F.count(F.lit(1)).alias("total"), F.sum(is_correct()).alias("correct")
    )
    known = F.col(TRUTH).isNotNull()
    ratio = F.col("correct") / F.col("total")
    totals = labels.agg(
        F.sum("total").alias("total"),
        F.sum("correct").alias("correct"),
        F.count_if(known).alias("labels"),
        F.count_if(known & (ratio == 1.0)).alias("perfect"),
        F.count_if(known & (ratio >= 0.5)).alias("good"),
    )
    metrics = {
        "Total Test Items": F.col("total").cast("string"),
        "Correct Predictions": F.col("correct").cast("string"),
        "Overall Accuracy": F.format_string("%.1f%%", 100.0 * F.col("correct") / F.col("total")),
        "Standards at 100%": _share(F.col("perfect"), F.col("labels")),
        "Standards at 50%+": _share(F.col("good"), F.col("labels")),
        "Embedding Dimension": F.lit(f"{dims} dimensions"),
    }
    rows = [
        totals.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics.values()))).alias("metric", "value")),
        label_counts(train, test).select(
            F.lit("Training/Test Overlap").alias("metric"),
            F.concat(F.col("overlap").cast("string"), F.lit(" standards")).alias("value"),
        ),
        texts.agg(F.avg(F.length(text)).alias("mean")).select(
            F.lit("Text Length (avg)").alias("metric"), F.format_string("%.0f characters", "mean").alias("value")
        ),
    ]
    table = rows[0]
    for more in rows[1:]:
        table = table.unionByName(more)
    return table


def compare_tagged(tagged: DataFrame, baseline: str) -> DataFrame:
    """Accuracy per ``approach`` and its gain over ``baseline``."""
    scores = accuracy(tagged, "approach").select("approach", "total", "correct", "accuracy")
    # One row per approach: the baseline's accuracy is found in a list of that size, within the row.
    listed = scores.agg(F.collect_list(F.struct("*")).alias("_all"))
    base = F.get(F.filter("_all", lambda s: s["approach"] == baseline), 0)["accuracy"]
    return listed.select(base.alias("_base"), F.explode("_all").alias("_one")).select(
        "_one.*", (F.col("_one.accuracy") - F.col("_base")).alias("gain")
    )


def compare_approaches(results: Mapping[str, DataFrame], baseline: str) -> DataFrame:
    """``compare_tagged`` over predictions per approach."""
    if baseline not in results:
        raise ValueError(f"unknown baseline {baseline}")
    tagged = None
    for name, predictions in results.items():
        part = predictions.select(F.lit(name).alias("approach"), TRUTH, PREDICTED)
        tagged = part if tagged is None else tagged.unionByName(part)
    return compare_tagged(tagged, baseline)
