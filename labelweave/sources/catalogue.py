"""Nested catalogues and their label dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators.classify import label_relation
from labelweave.schemas import CATALOGUE, DOCUMENT


def read_catalogue(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    """One row per nested JSON document (A1), with the order column ``_document`` behind its own.

    ``multiline=False`` reads JSON lines: a catalogue split into one document per line is read in parallel. Numbers
    that run on across documents go by ``_document``, which is unique, and equal in every read of the same files by the
    same session.
    """
    reader = spark.read.schema(CATALOGUE).option("mode", "FAILFAST").option("multiLine", multiline)
    return reader.json(path).withColumn(DOCUMENT, F.monotonically_increasing_id())


def parse_catalogue(documents: DataFrame, column: str = "document", carry: tuple[str, ...] = ()) -> DataFrame:
    """The same from a text column."""
    parsed = F.from_json(F.col(column), CATALOGUE, {"mode": "FAILFAST"})
    return documents.select(*carry, parsed.alias("_catalogue")).select(*carry, "_catalogue.*")


def label_dictionary(catalogues: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Label table of every catalogue's definitions, in their written order."""
    rows = catalogues.select(*carry, F.posexplode("standards_definitions").alias("ord", "std_id", "definition"))
    labels = label_relation(rows)
    if not carry:
        return labels
    return rows.select(*carry, F.col("ord").cast("long").alias("ord"), "std_id", "definition").withColumns(
        {
            "std_text": F.concat("std_id", F.lit(": "), "definition"),
            "category": F.substring_index("std_id", ".", 2),
        }
    )
