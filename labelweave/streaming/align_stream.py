"""Predictions for items that keep arriving.

Flattening, cleaning, vectors and the broadcast classification work row by row, so they run on a stream unchanged and
need no state, watermark or shuffle. Only the sink differs from the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from labelweave.schemas import CATALOGUE


def stream_catalogues(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON-lines catalogues of a folder, each line a document."""
    return spark.readStream.schema(CATALOGUE).option("mode", "FAILFAST").json(folder)


def write_stream(predictions: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append new submissions to a folder of CSV files, then stop; the checkpoint makes each item count once."""
    return (
        predictions.select("item_id", "predicted_standard")
        .writeStream.format("csv")
        .option("header", True)
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
