"""Every registered query against its SQL twin, and the shape of its plan."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as contract
from labelweave.queries import oracles, registry
from tests.conftest import plan_of

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLES = registry.QUERIES, oracles.build()
PYTHON_FREE = {
    "clean_documents", "clean_documents_whole", "word_lists", "page_texts", "category_labels", "flatten_catalogue",
    "flatten_profile_form", "label_flatten", "label_relation", "enriched_items", "label_overlap", "label_counts",
    "text_term_vectors", "profile_items", "type_frequency", "top10_labels", "labels_histogram", "length_reduction",
}


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def plain(value):
    if isinstance(value, (bool, str)) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return str(value) if isinstance(value, datetime.date) else float(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in PYTHON_FREE:
        assert "EvalPython" not in plan and "InArrow" not in plan
    got = table(df.columns, df.collect())
    cursor = duck.execute(ORACLES[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "no rows"


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_scans_read_only_what_is_needed(spark, sf_dir):
    plan = plan_of(QUERIES["label_counts"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan and "text" not in plan
    plan = plan_of(QUERIES["row_at"](spark, sf_dir))
    assert "EqualTo(doc_id,12)" in plan


def test_classification_shuffles_nothing(spark, sf_dir):
    assert "Exchange" not in plan_of(QUERIES["zero_shot_vectors"](spark, sf_dir))


def test_confusion_scores_items_once(spark, sf_dir):
    df = QUERIES["confusion_topk"](spark, sf_dir)
    df.collect()
    final = plan_of(df)
    assert "ReusedExchange" in final
