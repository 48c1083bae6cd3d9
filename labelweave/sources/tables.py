"""Flat inputs and all outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from labelweave.plans.spread import spread
from labelweave.schemas import ENRICHED_ITEMS, PAGES, SUBMISSION
from labelweave.session import materialise

_CSV = {"header": True, "escape": '"', "quote": '"'}


def read_items(spark: SparkSession, path: str, schema: T.StructType = ENRICHED_ITEMS) -> DataFrame:
    """Flat CSV with a header and a fixed schema; an empty field is null (A3)."""
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST", enforceSchema=False, **_CSV).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Submission file (A3); its fields hold no line ends, so files are split."""
    return spark.read.schema(SUBMISSION).options(mode="FAILFAST", **_CSV).csv(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages ``page_id, url, html`` (A7), over all cores even when the file has few row groups."""
    return spread(spark.read.schema(PAGES).parquet(path))


def write_items(items: DataFrame, path: str) -> None:
    """Flat items as CSV (A4); list columns have a joined twin and are left out."""
    flat = [f.name for f in items.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    items.select(*flat).write.options(emptyValue="", **_CSV).csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Label dictionary as JSON lines (A5)."""
    labels.select("ord", "std_id", "definition").write.json(path)


def write_submission(predictions: DataFrame, path: str) -> None:
    """``item_id, predicted_standard`` as CSV in item order.

    The order is made by a range shuffle, so files are written in parallel and sorted across their names. The shuffle
    samples its input first; both columns are written before, so that no item is scored twice.
    """
    narrow = materialise(predictions.select("item_id", "predicted_standard"))
    narrow.orderBy("item_id").write.options(**_CSV).csv(path)
