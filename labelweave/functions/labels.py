"""Scalars on label ids, accuracies and label lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier names and thresholds of the accuracy report.
PERFECT, GOOD, FAILED = "Perfect (100%)", "Good (50-99%)", "Failed (0-49%)"
VERDICT_EXCELLENT, VERDICT_IMPROVED = 0.60, 0.553


def category_of(label_id: Column) -> Column:
    """First two segments of a dotted id, the whole id when it has fewer."""
    return F.substring_index(label_id, ".", 2)


def label_text(label_id: Column, definition: Column) -> Column:
    """``id: definition``."""
    return F.concat(label_id, F.lit(": "), definition)


def effective_hint(group_hint: Column, item_category: Column) -> Column:
    """The group's hint, else the item's own category (S3). The latter leaks the truth; see ``evaluate``."""
    return F.coalesce(group_hint, item_category)


def accuracy_tier(accuracy: Column) -> Column:
    """Tier of an accuracy in [0, 1]."""
    return F.when(accuracy == 1.0, PERFECT).when(accuracy >= 0.5, GOOD).otherwise(FAILED)


def percent(share: Column) -> Column:
    """Share as percent."""
    return share * 100


def verdict(
    accuracy: Column, excellent: float = VERDICT_EXCELLENT, baseline: float = VERDICT_IMPROVED
) -> Column:
    """Outcome against a baseline."""
    return F.when(accuracy > excellent, "excellent").when(accuracy > baseline, "improved").otherwise("below")


def labels_per_item(labels: Column) -> Column:
    """Number of labels, 0 for a missing or empty list."""
    return F.size(F.coalesce(labels, F.array().cast("array<string>")))


def primary_label(labels: Column) -> Column:
    """First label, null for a missing or empty list."""
    return F.get(labels, 0)
