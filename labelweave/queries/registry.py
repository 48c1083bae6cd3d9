"""Registered queries: name -> function of (session, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.html import page_text
from labelweave.functions.labels import category_of, effective_hint, label_text, labels_per_item
from labelweave.functions.text import clean_text, clean_words, preview, raw_words, text_length
from labelweave.operators import evaluate, profile
from labelweave.operators.classify import classify, match_definitions, predictions, transfer_labels
from labelweave.operators.flatten import flatten_items, flatten_labels
from labelweave.operators.sparse import sparse_matches
from labelweave.operators.pages import add_page_text, enrich_items, extract_pages, extract_wanted_pages
from labelweave.operators.vectors import DIMS, encode, hash_buckets, term_counts
from labelweave.plans.align import TEXT_OF, align, vector_of
from labelweave.queries import inputs
from labelweave.queries.encoder import HashedCounts
from labelweave.session import shared_dir
from labelweave.sources import tables
from labelweave.sources.catalogue import label_dictionary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Shares and means at 6 decimals; confidences come rounded from the scoring already."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Classification on given vectors


def _vector_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = inputs.vector_items(spark, sf_dir, 6, 3)
    return classify(inputs.with_hints(items), inputs.vector_labels(items))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(_vector_predictions(spark, sf_dir))


@query
def zero_shot_vectors(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query
def zero_shot_prefix_bleed(spark, sf_dir):
    """A hint L1.1 admits L1.10 and L1.11 as well."""
    items = inputs.vector_items(spark, sf_dir, 24, 12)
    return predictions(classify(inputs.with_hints(items), inputs.vector_labels(items)))


@query
def zero_shot_exact_hint(spark, sf_dir):
    items = inputs.vector_items(spark, sf_dir, 24, 12)
    matched = classify(inputs.with_hints(items), inputs.vector_labels(items), exact=True)
    return predictions(matched)


@query
def definition_match(spark, sf_dir):
    items = inputs.vector_items(spark, sf_dir, 6, 3)
    return predictions(match_definitions(items, inputs.vector_labels(items)))


def _transferred(spark: SparkSession, sf_dir: str, indexed: bool = False) -> DataFrame:
    """Items without a row in ``labels`` get the class of the most similar items that have one."""
    items = inputs.vector_items(spark, sf_dir, 6, 3).withColumn("standard", F.substring_index("standard", ".", 1))
    marked = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    training = items.join(marked, "item_id", "left_semi").select(
        F.col("item_id").alias("ord"), F.col("standard").alias("id"), "vector"
    )
    return predictions(transfer_labels(items.join(marked, "item_id", "left_anti"), training, 5, indexed=indexed))


@query
def knn_transfer(spark, sf_dir):
    return _transferred(spark, sf_dir)


@query
def knn_transfer_indexed(spark, sf_dir):
    """As ``knn_transfer``, neighbours found by the metric index instead of one broadcast."""
    return _transferred(spark, sf_dir, indexed=True)


@query
def compare_approaches(spark, sf_dir):
    items = inputs.vector_items(spark, sf_dir, 6, 3)
    labels = inputs.vector_labels(items)
    results = {
        "k-NN": _transferred(spark, sf_dir),
        "definition": predictions(match_definitions(items, labels)),
        "hierarchical": predictions(classify(inputs.with_hints(items), labels)),
    }
    return rounded(evaluate.compare_approaches(results, "definition"), "accuracy", "gain")


# Classification on texts


@query
def text_term_vectors(spark, sf_dir):
    return term_counts(inputs.documents(spark, sf_dir), "doc_id", clean_words(F.col("text"), None))


@query
def text_label_match(spark, sf_dir):
    items = inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"), hash_buckets(clean_words(F.col("text"), None)).alias("vector")
    )
    labels = inputs.text_labels(spark, sf_dir).withColumn(
        "vector", hash_buckets(clean_words(F.col("std_text"), None))
    )
    matched = match_definitions(items, labels, dims=DIMS)
    return matched.select("item_id", "predicted_standard", "confidence")


@query
def text_label_match_sparse(spark, sf_dir):
    """As ``text_label_match``, by inverted lists of the labels' terms instead of dense rows."""
    items = inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"), hash_buckets(clean_words(F.col("text"), None)).alias("vector")
    )
    labels = inputs.text_labels(spark, sf_dir).withColumn(
        "vector", hash_buckets(clean_words(F.col("std_text"), None))
    )
    return sparse_matches(items, labels).select("item_id", "predicted_standard", "confidence")


def _text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all text variants in one pass over the documents."""
    items = enrich_items(inputs.document_items(spark, sf_dir))
    variants = F.array(
        *[F.struct(F.lit(name).alias("approach"), vector_of(F.col(column)).alias("vector")) for name, column in TEXT_OF.items()]
    )
    exploded = items.select("item_id", F.explode(variants).alias("_variant")).select("item_id", "_variant.*")
    labels = inputs.text_labels(spark, sf_dir).withColumn("vector", vector_of(F.col("std_text")))
    return classify(exploded, labels, hint=None, dims=DIMS).select("approach", "item_id", "predicted_standard", "confidence")


@query
def text_variant_predictions(spark, sf_dir):
    return _text_variants(spark, sf_dir)


@query
def compare_text_variants(spark, sf_dir):
    tagged = evaluate.attach_truth(_text_variants(spark, sf_dir), inputs.contained_labels(spark, sf_dir))
    return rounded(evaluate.compare_tagged(tagged, "metadata"), "accuracy", "gain")


@query
def encode_hook(spark, sf_dir):
    """Vectors of a plugged-in encoder; the one used here counts hashed words."""
    labels = inputs.text_labels(spark, sf_dir)
    vectors = labels.select("std_id", encode(F.col("std_text"), HashedCounts).alias("vector"))
    return (
        vectors.select("std_id", F.posexplode("vector").alias("bucket", "n"))
        .where(F.col("n") > 0)
        .select("std_id", "bucket", F.col("n").cast("long").alias("n"))
    )


# Evaluation


@query
def accuracy(spark, sf_dir):
    return rounded(evaluate.accuracy(_evaluated(spark, sf_dir)), "accuracy", "percent")


@query
def accuracy_by_hint(spark, sf_dir):
    """Rows with a hint that was honoured apart from those whose category was inferred."""
    hinted = F.coalesce(F.size(F.split("hint", "[.]")) == 2, F.lit(False))
    marked = _vector_predictions(spark, sf_dir).select(
        F.when(hinted, "hinted").otherwise("inferred").alias("basis"),
        "predicted_standard",
        F.col("standard").alias("true_standard"),
    )
    return rounded(evaluate.accuracy(marked, "basis"), "accuracy", "percent")


@query
def per_label_accuracy(spark, sf_dir):
    return rounded(evaluate.per_label_accuracy(_evaluated(spark, sf_dir)), "accuracy")


@query
def performance_tiers(spark, sf_dir):
    return rounded(evaluate.performance_table(_evaluated(spark, sf_dir)), "accuracy")


@query
def tier_counts(spark, sf_dir):
    return evaluate.tier_counts(_evaluated(spark, sf_dir))


@query
def top_labels(spark, sf_dir):
    return evaluate.top_labels(inputs.vector_items(spark, sf_dir, 6, 3), 6, "standard")


@query
def confusion_topk(spark, sf_dir):
    """Classes instead of single labels, so that the cells fill."""
    scored = _evaluated(spark, sf_dir).select(
        *[F.substring_index(c, ".", 1).alias(c) for c in (evaluate.TRUTH, evaluate.PREDICTED)]
    )
    return evaluate.confusion_topk(scored, 6)


@query
def category_confusion(spark, sf_dir):
    return evaluate.category_confusion(_evaluated(spark, sf_dir))


def _document_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels ``source.lang`` of the documents with and without a quality mark."""
    documents = inputs.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(".", "source", "lang").alias("standard")
    )
    marked = inputs.table(spark, sf_dir, "labels").select("doc_id")
    return documents.join(marked, "doc_id", "left_semi"), documents.join(marked, "doc_id", "left_anti")


@query
def label_overlap(spark, sf_dir):
    return evaluate.label_overlap(*_document_labels(spark, sf_dir))


@query
def label_counts(spark, sf_dir):
    return evaluate.label_counts(*_document_labels(spark, sf_dir))


@query
def summary_table(spark, sf_dir):
    train, test = _document_labels(spark, sf_dir)
    texts = inputs.documents(spark, sf_dir).select(clean_text(F.col("text")).alias("cleaned"))
    return evaluate.summary_table(_evaluated(spark, sf_dir), train, test, texts, "cleaned", 64)


# Scalars, cleaning and pages


@query
def category_labels(spark, sf_dir):
    """Dotted host names as label ids."""
    host = F.regexp_extract("url", "//([^/:?#]+)", 1)
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id",
        host.alias("std_id"),
        category_of(host).alias("category"),
        label_text(host, F.col("url")).alias("std_text"),
        effective_hint(F.nullif(F.regexp_extract("url", "#(.*)", 1), F.lit("")), category_of(host)).alias("hint"),
    )


@query
def clean_documents(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query
def clean_documents_whole(spark, sf_dir):
    """Without the limit on words."""
    return inputs.documents(spark, sf_dir).select("doc_id", clean_text(F.col("text"), None).alias("cleaned"))


@query
def word_lists(spark, sf_dir):
    """Words per text before and after filtering, text length and preview."""
    text = F.col("text")
    return inputs.documents(spark, sf_dir).select(
        "doc_id",
        F.size(raw_words(text)).cast("long").alias("words"),
        F.size(clean_words(text, None)).cast("long").alias("meaningful"),
        text_length(text).cast("long").alias("chars"),
        preview(text).alias("start"),
    )


@query
def page_texts(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select("page_id", page_text(F.col("html")).alias("url_content"))


@query
def wanted_page_texts(spark, sf_dir):
    """Text of the pages that items name, one row per URL; other pages are not parsed."""
    items = inputs.catalogue_items(spark, sf_dir)
    return extract_wanted_pages(inputs.pages(spark, sf_dir), items).select("url", "url_content", "cleaned_url_content")


# Catalogue


@query
def flatten_catalogue(spark, sf_dir):
    return inputs.catalogue_items(spark, sf_dir).drop("standards")


@query
def flatten_profile_form(spark, sf_dir):
    """Three-part text, no labels, every document numbered from 0."""
    return flatten_items(inputs.catalogues(spark, sf_dir), include_labels=False, carry=("volume",))


@query
def label_flatten(spark, sf_dir):
    return flatten_labels(inputs.catalogues(spark, sf_dir), order_by="volume")


@query
def label_relation(spark, sf_dir):
    return label_dictionary(inputs.catalogues(spark, sf_dir), carry=("volume",))


def _with_pages(spark: SparkSession, sf_dir: str, max_items: int | None = None) -> DataFrame:
    items = inputs.catalogue_items(spark, sf_dir)
    pages = extract_wanted_pages(inputs.pages(spark, sf_dir), items)
    return enrich_items(add_page_text(items, pages, max_items=max_items))


@query
def enriched_items(spark, sf_dir):
    return _with_pages(spark, sf_dir).select(
        "item_id", "url_content", "enhanced_text", "cleaned_url_content", "enhanced_text_cleaned"
    )


@query
def enriched_first_items(spark, sf_dir):
    """Only the first 100 items with a URL get their page."""
    return _with_pages(spark, sf_dir, 100).select("item_id", "url_content")


@query
def item_alignment(spark, sf_dir):
    """The whole way: nested documents, page text, cleaning, vectors, hinted classification, truth."""
    documents = inputs.catalogues(spark, sf_dir)
    labels = (
        label_dictionary(documents, carry=("volume",))
        .groupBy("std_id", "category", "std_text")
        .agg(F.min(F.col("volume") * 1000 + F.col("ord")).alias("ord"))
    )
    pages = inputs.pages(spark, sf_dir)
    return align(inputs.items_of(documents), labels, pages)


# Profile


@query
def profile_items(spark, sf_dir):
    return rounded(profile.item_profile(inputs.catalogue_items(spark, sf_dir, numbered=False)), "url_percent")


@query
def dictionary_size(spark, sf_dir):
    return profile.dictionary_size(label_dictionary(inputs.catalogues(spark, sf_dir)))


@query
def type_frequency(spark, sf_dir):
    return profile.frequency(inputs.catalogue_items(spark, sf_dir, numbered=False), "item_type")


@query
def book_frequency(spark, sf_dir):
    return profile.frequency(inputs.catalogue_items(spark, sf_dir, numbered=False), "book_title")


@query
def top10_labels(spark, sf_dir):
    return profile.frequency(inputs.catalogue_items(spark, sf_dir, numbered=False), "standard", 10)


@query
def labels_histogram(spark, sf_dir):
    return profile.labels_histogram(inputs.catalogue_items(spark, sf_dir, numbered=False))


@query
def labels_per_item_counts(spark, sf_dir):
    return inputs.catalogue_items(spark, sf_dir).select(
        "item_id", labels_per_item(F.col("standards")).cast("long").alias("n_labels")
    )


@query
def missing_labels(spark, sf_dir):
    return profile.item_profile(inputs.catalogue_items(spark, sf_dir, numbered=False)).select("without_label")


@query
def sample_rows(spark, sf_dir):
    return profile.sample_rows(inputs.catalogue_items(spark, sf_dir))


@query
def row_at(spark, sf_dir):
    items = enrich_items(inputs.document_items(spark, sf_dir))
    return profile.row_at(items, 12, "enhanced_text", "enhanced_text_cleaned")


@query
def length_reduction(spark, sf_dir):
    items = enrich_items(inputs.document_items(spark, sf_dir))
    return rounded(profile.length_reduction(items), "mean_before", "mean_after", "reduction_percent")


# Sinks


@query
def items_roundtrip(spark, sf_dir):
    """Flat items written as CSV and read back; empty fields come back as null."""
    folder = shared_dir(spark, "items")
    items = inputs.catalogue_items(spark, sf_dir)
    tables.write_items(items, folder)
    flat = items.drop("standards").schema
    return tables.read_items(spark, folder, flat)


@query
def labels_roundtrip(spark, sf_dir):
    """Label dictionary written as JSON lines and read back."""
    folder = shared_dir(spark, "labels")
    tables.write_labels(inputs.text_labels(spark, sf_dir), folder)
    return spark.read.schema("ord long, std_id string, definition string").json(folder)


@query
def submission_roundtrip(spark, sf_dir):
    """Predictions written as the two-column CSV and read back."""
    folder = shared_dir(spark, "submission")
    tables.write_submission(_evaluated(spark, sf_dir), folder)
    return tables.read_predictions(spark, folder)
