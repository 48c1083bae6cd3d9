"""Inputs of the registered queries, derived from the given tables. Every row of a table is used."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.labels import category_of
from labelweave.operators.classify import label_relation
from labelweave.operators.flatten import MATCH_TEXT, flatten_items
from labelweave.plans.spread import spread
from labelweave.schemas import TABLES
from labelweave.sources.catalogue import parse_catalogue
from labelweave.sources.tables import read_pages

#: Customers per catalogue document.
VOLUME = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def vector_items(spark: SparkSession, sf_dir: str, per_class: int, categories: int) -> DataFrame:
    """Every embedding as an item; its true label is ``L{class}.{category}.{group}``, its group ``vec_id % per_class``."""
    group = F.col("vec_id") % per_class
    path = F.concat_ws(".", F.concat(F.lit("L"), "label"), group % categories, group)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").alias("vector"),
        (F.col("label") * per_class + group).alias("ord"),
        path.alias("standard"),
    )


def vector_labels(items: DataFrame) -> DataFrame:
    """Label dictionary of the items: one label per group, defined by the mean of its vectors.

    Means are combined before the shuffle, so a group with a third of all rows is one partial sum per task.
    """
    mean = vector_to_array(Summarizer.mean(array_to_vector("vector")))
    return items.groupBy("ord", F.col("standard").alias("std_id")).agg(mean.alias("vector")).select(
        F.col("ord").cast("long").alias("ord"), "std_id", category_of(F.col("std_id")).alias("category"), "vector"
    )


def with_hints(items: DataFrame) -> DataFrame:
    """Half of the items carry their category as hint, a quarter none, a quarter a deeper id that is no category."""
    turn = F.col("item_id") % 4
    hint = F.when(turn % 2 == 0, category_of(F.col("standard"))).when(turn == 3, F.col("standard"))
    return items.withColumn("hint", hint)


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as label definitions ``B.{item_id % 5}.{item_id}``."""
    number = F.col("item_id")
    return label_relation(
        table(spark, sf_dir, "benchmark").select(
            number.alias("ord"),
            F.concat_ws(".", F.lit("B"), number % 5, number).alias("std_id"),
            F.col("text").alias("definition"),
        )
    )


def sentences(text):
    trimmed = F.transform(F.split(text, "[.]"), lambda s: F.btrim(s, F.lit(" \n\r\t")))
    return F.array_distinct(F.filter(trimmed, lambda s: s != ""))


def contained_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, true_standard)``: the first label all of whose sentences occur in the document."""
    labels = text_labels(spark, sf_dir).select("ord", "std_id", sentences(F.col("definition")).alias("_sentences"))
    wanted = labels.select("ord", "std_id", F.size("_sentences").alias("_all"), F.explode("_sentences").alias("sentence"))
    found = documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"), F.explode(sentences(F.col("text"))).alias("sentence")
    )
    return (
        found.join(wanted, "sentence")
        .groupBy("item_id", "ord", "std_id", "_all")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == F.col("_all"))
        .groupBy("item_id")
        .agg(F.min_by("std_id", "ord").alias("true_standard"))
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: language and source as their metadata, the text as their page."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"),
        F.concat_ws(" ", "lang", "source").alias("combined_text"),
        F.col("text").alias("url_content"),
    )


def catalogue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(volume, document)``: nested JSON documents region > nation > segment > customer.

    A volume holds the customers of VOLUME consecutive keys, so a document is bounded however many customers there
    are. One shuffle by volume serves all four levels of nesting.
    """
    n_pages = table(spark, sf_dir, "pages").count()
    page_of = F.col("c_custkey") % n_pages
    customers = (
        table(spark, sf_dir, "customer")
        .withColumn("page_id", page_of)
        .join(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url")), "page_id", "left")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("volume", F.floor(F.col("c_custkey") / VOLUME).cast("long"))
        .repartition("volume")
    )
    balance = F.col("c_acctbal")
    category = F.concat(F.lit("R"), "r_regionkey", F.lit(".N"), "n_nationkey")
    own = F.concat_ws(".", category, "c_mktsegment")
    leaf = F.struct(
        F.when(balance < 0, "exercise").when(balance < 5000, "section").otherwise("chapter").alias("type"),
        F.col("c_name").alias("description"),
        F.when(balance >= 0, F.concat(F.lit("Balance "), balance.cast("decimal(12,2)").cast("string"))).alias("text"),
        F.concat_ws(" ", "c_mktsegment", "n_name").alias("title"),
        F.array(
            F.floor(F.col("c_custkey") / 10).cast("string"), (F.col("c_custkey") % 10).cast("string")
        ).alias("numbers"),
        F.when(balance >= 0, F.col("page_url")).alias("url"),
        F.when(balance < 0, F.array().cast("array<string>"))
        .when(balance > 9000, F.array(own, category))
        .otherwise(F.array(own))
        .alias("standards"),
    )
    definition = F.concat(F.col("c_mktsegment"), F.lit(" customers of "), F.col("n_name"))
    collected = lambda *parts: F.array_sort(F.collect_list(F.struct(*parts)))
    items = customers.groupBy("volume", "r_regionkey", "r_name", "n_nationkey", "n_name", "c_mktsegment").agg(
        collected("c_custkey", leaf.alias("leaf")).alias("_items"),
        F.first(category).alias("category"),
        F.struct(F.first(own).alias("key"), F.first(definition).alias("value")).alias("_definition"),
    )
    clusters = items.groupBy("volume", "r_regionkey", "r_name", "n_nationkey", "n_name", "category").agg(
        collected(
            "c_mktsegment", F.transform("_items", lambda i: i["leaf"]).alias("leaves"), "_definition"
        ).alias("_clusters")
    )
    groups = clusters.groupBy("volume", "r_regionkey", "r_name").agg(
        collected(
            "n_nationkey",
            F.struct(
                F.col("n_name").alias("concept"),
                F.col("r_name").alias("domain"),
                F.array("category").alias("standards"),
                F.transform(
                    "_clusters", lambda c: F.struct(c["c_mktsegment"].alias("cluster"), c["leaves"].alias("items"))
                ).alias("clusters"),
            ).alias("group"),
            F.transform("_clusters", lambda c: c["_definition"]).alias("definitions"),
        ).alias("_groups")
    )
    books = groups.groupBy("volume").agg(
        collected(
            "r_regionkey",
            F.struct(
                F.col("r_name").alias("title"), F.transform("_groups", lambda g: g["group"]).alias("items")
            ).alias("book"),
            F.flatten(F.transform("_groups", lambda g: g["definitions"])).alias("definitions"),
        ).alias("_books")
    )
    document = F.struct(
        F.map_from_entries(F.flatten(F.transform("_books", lambda b: b["definitions"]))).alias("standards_definitions"),
        F.transform("_books", lambda b: b["book"]).alias("titles"),
    )
    return books.select("volume", F.to_json(document).alias("document"))


def catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_catalogue(catalogue_documents(spark, sf_dir), carry=("volume",))


def items_of(documents: DataFrame, numbered: bool = True) -> DataFrame:
    """Flat items of all documents, numbered across them unless only counts are wanted."""
    return flatten_items(
        documents, text_fields=MATCH_TEXT, with_hint=True, order_by="volume" if numbered else None
    )


def catalogue_items(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    return items_of(catalogues(spark, sf_dir), numbered)
