"""Attach page text to items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.html import page_text
from labelweave.operators import bloom
from labelweave.session import materialise
from labelweave.functions.text import clean_text, enrich
from labelweave.functions.vocab import MAX_WORDS
from labelweave.plans.running import first_rows
from labelweave.plans.skew import skew_join


def extract_pages(pages: DataFrame, max_words: int = MAX_WORDS, **vocabularies) -> DataFrame:
    """``(url, url_content, cleaned_url_content)``, one row per URL.

    Where pages share a URL the one with the smallest ``page_id`` counts. Markup is read once per page in the scan and
    its text cleaned once per URL, before any join repeats it; only text is shuffled, and copies of a URL are combined
    before the shuffle.
    """
    return (
        pages.select("url", "page_id", page_text(F.col("html")).alias("_text"))
        .groupBy("url")
        .agg(F.min_by("_text", "page_id").alias("url_content"))
        .withColumn("cleaned_url_content", clean_text(F.col("url_content"), max_words, **vocabularies))
    )


def extract_wanted_pages(
    pages: DataFrame, wanted: DataFrame, max_words: int = MAX_WORDS, *, rate: float = bloom.FALSE_POSITIVES, **vocabularies
) -> DataFrame:
    """``extract_pages`` of only the URLs that ``wanted`` names in its ``url`` column (not null, not empty).

    A Bloom filter of the wanted URLs, built in pieces by tasks and sized from their count, is probed in the scan of
    ``pages`` before any markup is read: a page whose URL no item names is neither parsed nor shuffled. The exact
    semi-join after it removes the false positives, so the rows equal those of ``extract_pages`` for the wanted URLs.
    Past ``bloom.MAX_FILTER_BYTES`` there is no filter and the semi-join alone decides. The wanted URLs are computed
    once and checkpointed, as the count, the filter and the join all read them.
    """
    urls = materialise(wanted.select("url").where(F.col("url").isNotNull() & (F.col("url") != "")).distinct())
    filter_ = bloom.build(urls, "url", rate)
    candidates = bloom.probe(pages.select("url", "page_id", "html"), "url", filter_)
    return extract_pages(candidates, max_words, **vocabularies).join(urls, "url", "left_semi")


def add_page_text(
    items: DataFrame,
    pages_text: DataFrame,
    *,
    max_items: int | None = None,
    item_id: str = "item_id",
    hot_rows: int | None = None,
) -> DataFrame:
    """Left-join the columns of the pages by URL, '' or an empty list where absent (H1-H3).

    ``max_items`` enriches only the first so many items with a URL, in item order. ``pages_text`` needs one row per
    URL, as ``extract_pages`` returns it.
    """
    url = F.col("url")
    if max_items:
        chosen = first_rows(items.where(url != "").select(item_id), item_id, max_items)
        items = items.join(chosen.withColumn("_chosen", F.lit(True)), item_id, "left")
        url = F.when(F.col("_chosen"), url)
    keyed = items.withColumn("_url", F.nullif(url, F.lit("")))
    empty = {
        f.name: F.lit("") if isinstance(f.dataType, T.StringType) else F.array().cast(f.dataType)
        for f in pages_text.schema
        if f.name != "url"
    }
    pages_text = pages_text.withColumnRenamed("url", "_url")
    joined = skew_join(keyed, pages_text, "_url", "left", spread_by=item_id, hot_rows=hot_rows)
    return joined.withColumns({c: F.coalesce(c, e) for c, e in empty.items()}).drop("_url", "_chosen")


def enrich_items(items: DataFrame, max_words: int = MAX_WORDS, **vocabularies) -> DataFrame:
    """Add the raw and the cleaned variant of the item text (C1-C14, H8); text cleaned per page is taken over."""
    text, content = F.col("combined_text"), F.col("url_content")
    if "cleaned_url_content" not in items.columns:
        items = items.withColumn("cleaned_url_content", clean_text(content, max_words, **vocabularies))
    return items.withColumns(
        {
            "enhanced_text": enrich(text, content),
            "enhanced_text_cleaned": enrich(text, F.col("cleaned_url_content")),
        }
    )
