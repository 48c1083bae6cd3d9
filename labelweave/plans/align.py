"""Align: items and label dictionary -> predictions, by any of the compared approaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.labels import effective_hint
from labelweave.functions.text import raw_words
from labelweave.functions.vocab import MAX_WORDS
from labelweave.operators.classify import classify, match_definitions, predictions
from labelweave.operators.pages import add_page_text, enrich_items, extract_wanted_pages
from labelweave.operators.scoring import Limits
from labelweave.operators.vectors import DIMS, encode, hash_buckets

#: Text column of each approach: without page text, with the page as it is, with the cleaned page.
TEXT_OF = {"metadata": "combined_text", "raw_pages": "enhanced_text", "cleaned_pages": "enhanced_text_cleaned"}
#: The page text in it.
PAGE_OF = {"raw_pages": "url_content", "cleaned_pages": "cleaned_url_content"}


def vector_of(text: Column, make_encoder: Callable[[], object] | None = None) -> Column:
    """Vector of a text: by the plugged-in encoder, else hashed counts of its words."""
    return encode(text, make_encoder) if make_encoder else hash_buckets(raw_words(text))


def align(
    items: DataFrame,
    labels: DataFrame,
    pages: DataFrame | None = None,
    *,
    approach: str = "cleaned_pages",
    use_own_category: bool = False,
    hierarchical: bool = True,
    make_encoder: Callable[[], object] | None = None,
    max_items: int | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Predictions ``item_id, predicted_standard, true_standard, confidence``.

    ``items`` is the match form of ``flatten_items`` with a hint. ``use_own_category=True`` falls back to the category
    of an item's true label where its group has no hint; it leaks the truth.
    """
    page = PAGE_OF.get(approach)
    if pages is not None and page:
        texts = extract_wanted_pages(pages, items)
        if not make_encoder:
            # Words never cross the blank between metadata and page, so a page is hashed once, not once per item, and
            # its buckets are joined in place of its text.
            texts = texts.select("url", vector_of(F.col(page)).alias("_page_vector"))
        items = add_page_text(items, texts, max_items=max_items)
    if "_page_vector" in items.columns:
        vector = F.concat(vector_of(F.col("combined_text")), F.col("_page_vector"))
    else:
        if "url_content" not in items.columns:
            items = items.withColumn("url_content", F.lit(""))
        items = enrich_items(items, MAX_WORDS)
        vector = vector_of(F.col(TEXT_OF[approach]), make_encoder)
    hint = F.col("category_standard")
    if use_own_category:
        hint = effective_hint(hint, F.col("category"))
    if "standard" not in items.columns:
        items = items.withColumn("standard", F.lit(None).cast("string"))
    queries = items.select(
        "item_id", "standard", hint.alias("hint"), vector.alias("vector")
    )
    dictionary = labels.withColumn("vector", vector_of(F.col("std_text"), make_encoder))
    dims = None if make_encoder else DIMS
    matched = (
        classify(queries, dictionary, dims=dims, limits=limits)
        if hierarchical
        else match_definitions(queries, dictionary, dims=dims, limits=limits)
    )
    return predictions(matched)


