"""Nested catalogue -> flat items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.labels import category_of, primary_label
from labelweave.functions.text import join_non_empty
from labelweave.plans.running import ordered_offsets
from labelweave.schemas import BOOK, CLUSTER, DOCUMENT, GROUP

#: Text parts of the profile form and of the match form, in joining order.
PROFILE_TEXT = ("description", "text", "title")
MATCH_TEXT = ("description", "text", "title", "cluster_description", "concept", "domain")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _items_of(value: Column) -> Column:
    """Items of a catalogue's books in traversal order, as one array of structs.

    Nested arrays are unfolded inside the row, so an item's position in the result is its running number and no
    shuffle or window is needed to number it.
    """

    def item(book: Column, group: Column, cluster: Column, leaf: Column) -> Column:
        numbers = F.coalesce(F.array_join(leaf["numbers"], ","), F.lit(""))
        return F.struct(
            book["title"].alias("book_title"),
            _text(group["concept"]).alias("concept"),
            _text(group["domain"]).alias("domain"),
            primary_label(group["standards"]).alias("category_standard"),
            _text(cluster["cluster"]).alias("cluster_description"),
            _text(leaf["type"]).alias("item_type"),
            _text(leaf["description"]).alias("description"),
            _text(leaf["text"]).alias("text"),
            _text(leaf["title"]).alias("title"),
            numbers.alias("numbers"),
            _text(leaf["url"]).alias("url"),
            leaf["standards"].alias("standards"),
        )

    def unfold(parents: Column, visit) -> Column:
        # A level that is missing yields null, which would swallow its siblings in flatten().
        return F.flatten(F.filter(F.transform(parents, visit), lambda level: level.isNotNull()))

    return unfold(
        value,
        lambda book: unfold(
            book["items"],
            lambda group: unfold(
                group["clusters"],
                lambda cluster: F.transform(cluster["items"], lambda leaf: item(book, group, cluster, leaf)),
            ),
        ),
    )


def _count_of(titles: Column) -> Column:
    """Number of items of a catalogue, without unfolding them."""

    def total(parents: Column, count) -> Column:
        return F.aggregate(
            F.coalesce(parents, F.array().cast(kinds[id(count)])),
            F.lit(0).cast("long"),
            lambda n, parent: n + count(parent),
        )

    def in_cluster(cluster: Column) -> Column:
        return F.when(cluster["items"].isNull(), 0).otherwise(F.size(cluster["items"])).cast("long")

    def in_group(group: Column) -> Column:
        return total(group["clusters"], in_cluster)

    def in_book(book: Column) -> Column:
        return total(book["items"], in_group)

    kinds = {id(in_cluster): T.ArrayType(CLUSTER), id(in_group): T.ArrayType(GROUP), id(in_book): T.ArrayType(BOOK)}
    return total(titles, in_book)


def flatten_items(
    catalogues: DataFrame,
    *,
    text_fields: Sequence[str] = PROFILE_TEXT,
    include_labels: bool = True,
    with_hint: bool = False,
    order_by: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per item of every catalogue.

    ``catalogues`` holds one nested document per row. Items are numbered from 0 within each document; with
    ``order_by``, a unique integer column, documents are parts of one catalogue and the numbers run on across them. The
    order column of ``read_catalogue`` is used unasked.
    ``text_fields`` selects what goes into ``combined_text``, ``with_hint`` adds the group's first label and
    ``include_labels`` the item's own labels. ``carry`` names document columns to keep.
    """
    if order_by is None and DOCUMENT in catalogues.columns:
        order_by = DOCUMENT
    if "titles" not in catalogues.columns:
        raise ValueError("catalogue without titles")
    checked = F.when(F.col("titles").isNull(), F.raise_error(F.lit("catalogue without titles"))).otherwise(F.col("titles"))
    first_id = F.lit(0).cast("long")
    if order_by:
        sizes = catalogues.select(order_by, _count_of(F.col("titles")).alias("_n"))
        catalogues = catalogues.join(ordered_offsets(sizes, order_by, "_n", "_first"), order_by)
        first_id = F.col("_first")
    # The outer form, because the inner one evaluates the unfolding once more in a filter on its size.
    flat = (
        catalogues.select(*carry, first_id.alias("_first_id"), F.posexplode_outer(_items_of(checked)).alias("_pos", "_item"))
        .where(F.col("_pos").isNotNull())
        .select(*carry, (F.col("_first_id") + F.col("_pos")).alias("item_id"), "_item.*")
    )
    flat = flat.withColumn("combined_text", join_non_empty(*map(F.col, text_fields)))
    columns = [*carry, "item_id", "book_title", "concept", "domain"]
    columns += ["category_standard"] if with_hint else []
    columns += ["cluster_description", "item_type", "description", "text", "title", "numbers", "url", "combined_text"]
    if include_labels:
        labels = F.coalesce(F.col("standards"), F.array().cast("array<string>"))
        flat = flat.withColumns(
            {
                "standard": primary_label(labels),
                "all_standards": F.array_join(labels, ","),
                "category": category_of(primary_label(labels)),
                "standards": labels,
            }
        )
        columns += ["standard", "all_standards", "category", "standards"]
    return flat.select(*columns)


def flatten_labels(catalogues: DataFrame, *, order_by: str | None = None) -> DataFrame:
    """Item number and first label of every labelled item (B3); numbers count unlabelled items as well."""
    items = flatten_items(catalogues, order_by=order_by)
    return items.where(F.size("standards") > 0).select("item_id", "standard")
