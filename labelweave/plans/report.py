"""Report: predictions and catalogues -> the tables behind the evaluation charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators import evaluate
from labelweave.operators.flatten import flatten_labels


def report(training: DataFrame, testing: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """Overlap, accuracy, per-label table, top labels and confusion of a submission.

    Catalogues of several documents need the order column of ``read_catalogue``, by which items were numbered.
    """
    train, test = flatten_labels(training), flatten_labels(testing)
    truth = test.select("item_id", F.col("standard").alias(evaluate.TRUTH))
    joined = evaluate.attach_truth(predictions.select("item_id", evaluate.PREDICTED), truth)
    return {
        "label_counts": evaluate.label_counts(train, test),
        "label_overlap": evaluate.label_overlap(train, test),
        "accuracy": evaluate.accuracy(joined),
        "performance": evaluate.performance_table(joined),
        "tiers": evaluate.tier_counts(joined),
        "top_labels": evaluate.top_labels(truth),
        "confusion": evaluate.confusion_topk(joined),
        "category_confusion": evaluate.category_confusion(joined),
    }
