"""Profile of flat items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.labels import labels_per_item
from labelweave.functions.text import preview, text_length


def item_profile(items: DataFrame) -> DataFrame:
    """Items, items with URL (and percent), with text, without label, in one pass."""
    has_url = F.coalesce(F.col("url") != "", F.lit(False))
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(has_url).alias("with_url"),
        (100 * F.avg(has_url.cast("int"))).alias("url_percent"),
        F.count_if(F.col("combined_text") != "").alias("with_text"),
        F.count_if(F.col("standard").isNull()).alias("without_label"),
    )


def dictionary_size(labels: DataFrame) -> DataFrame:
    """Distinct labels of a dictionary (G1)."""
    return labels.agg(F.count_distinct("std_id").alias("labels"))


def frequency(items: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Value counts without nulls, most frequent first, ties by value."""
    counts = (
        items.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )
    return counts if limit is None else counts.limit(limit)


def labels_histogram(items: DataFrame, labels: str = "standards") -> DataFrame:
    """Items per number of labels."""
    return (
        items.groupBy(labels_per_item(F.col(labels)).alias("n_labels"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "n_labels")
    )


def sample_rows(items: DataFrame, n: int = 5) -> DataFrame:
    """First items, three columns."""
    return items.orderBy("item_id").limit(n).select("item_id", "item_type", "combined_text", "standard")


def row_at(items: DataFrame, position: int, *texts: str) -> DataFrame:
    """One item with length and preview of its texts."""
    columns = [
        column
        for text in texts
        for column in (
            text_length(F.col(text)).cast("long").alias(f"{text}_chars"), preview(F.col(text)).alias(f"{text}_preview")
        )
    ]
    return items.where(F.col("item_id") == position).select("item_id", *columns)


def length_reduction(items: DataFrame, before: str = "enhanced_text", after: str = "enhanced_text_cleaned") -> DataFrame:
    """Mean length before and after cleaning and the reduction in percent."""
    return items.agg(
        F.avg(F.length(before)).alias("mean_before"), F.avg(F.length(after)).alias("mean_after")
    ).withColumn("reduction_percent", (1 - F.col("mean_after") / F.col("mean_before")) * 100)
