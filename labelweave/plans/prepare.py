"""Prepare: nested catalogues -> flat items, label dictionary and profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from labelweave.operators import profile
from labelweave.operators.flatten import flatten_items
from labelweave.sources.catalogue import label_dictionary, read_catalogue
from labelweave.sources.tables import write_items, write_labels


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame
    labels: DataFrame

    def reports(self) -> dict[str, DataFrame]:
        """Every profile of the training items."""
        return {
            "items": profile.item_profile(self.train),
            "labels": profile.dictionary_size(self.labels),
            "item_types": profile.frequency(self.train, "item_type"),
            "books": profile.frequency(self.train, "book_title"),
            "top_labels": profile.frequency(self.train, "standard", 10),
            "labels_per_item": profile.labels_histogram(self.train),
            "sample": profile.sample_rows(self.train),
        }

    def write(self, folder: str) -> None:
        """Items as CSV, dictionary as JSON lines (A4, A5)."""
        write_items(self.train, f"{folder}/train_items")
        write_items(self.test, f"{folder}/test_items")
        write_labels(self.labels, f"{folder}/labels")


def prepare(spark: SparkSession, training: str, testing: str, *, multiline: bool = True) -> Prepared:
    """Read both catalogues; the test items come without labels."""
    train_docs = read_catalogue(spark, training, multiline=multiline)
    test_docs = read_catalogue(spark, testing, multiline=multiline)
    return Prepared(
        train=flatten_items(train_docs),
        test=flatten_items(test_docs, include_labels=False),
        labels=label_dictionary(train_docs),
    )
