import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators.pages import add_page_text, enrich_items, extract_pages
from labelweave.plans.skew import hot_keys, skew_join

PAGES = [(2, "u1", "<p>second</p>"), (1, "u1", "<p>First  page</p>"), (3, "u2", "<b>See cones</b> and x"), (4, "u3", None)]
ITEMS = [(0, "u1", "zero"), (1, "", "one"), (2, None, "two"), (3, "u2", "three"), (4, "gone", "four"), (5, "u1", None), (6, "u3", "six")]


@pytest.fixture
def tables(spark):
    return (
        spark.createDataFrame(ITEMS, "item_id long, url string, combined_text string"),
        extract_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string")),
    )


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_page_join(spark, tables, hot_rows):
    rows = add_page_text(*tables, hot_rows=hot_rows).orderBy("item_id").collect()
    assert [r.item_id for r in rows] == list(range(7))
    assert [r.url_content for r in rows] == ["First page", "", "", "See cones and x", "", "First page", ""]


def test_only_the_first_items(spark, tables):
    rows = add_page_text(*tables, max_items=2).orderBy("item_id").collect()
    assert [r.url_content for r in rows] == ["First page", "", "", "See cones and x", "", "", ""]


def test_enriched_texts(spark, tables):
    rows = enrich_items(add_page_text(*tables)).orderBy("item_id").collect()
    assert rows[3].enhanced_text == "three See cones and x" and rows[3].enhanced_text_cleaned == "three cones"
    assert rows[1].enhanced_text == "one " and rows[5].enhanced_text == " First page"
    again = enrich_items(add_page_text(*tables).drop("cleaned_url_content")).orderBy("item_id").collect()
    assert [r.enhanced_text_cleaned for r in again] == [r.enhanced_text_cleaned for r in rows]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_a_plain_join(spark, how):
    left = spark.range(400).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise((F.col("id") % 11).cast("string")).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("4", 3), ("9", 4), (None, 5)], "k string, v int")
    assert hot_keys(left, "k", 100) == {"hot": 134}
    salted = skew_join(left, right, "k", how, spread_by="id", hot_rows=20)
    plain = left.join(right, "k", how)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, salted.select(plain.columns).collect())) == sorted(map(key, plain.collect()))


def test_adaptive_execution_splits_a_hot_url(spark):
    changed = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        left = spark.range(0, 30000, 1, 8).select(
            F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        right = spark.range(0, 30000, 3, 4).select(F.when(F.col("id") == 0, "hot").otherwise((F.col("id") + 1).cast("string")).alias("k"))
        joined = skew_join(left, right, "k", "left", spread_by="id")
        assert len(joined.collect()) == 30000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_wanted_pages_equal_all_pages_for_those_urls(spark):
    from labelweave.operators.pages import extract_wanted_pages

    pages = spark.createDataFrame(PAGES + [(5, None, "<p>no url</p>"), (6, "", "<p>empty</p>")], "page_id long, url string, html string")
    items = spark.createDataFrame(ITEMS, "item_id long, url string, combined_text string")
    want = sorted(extract_pages(pages).where("url IN ('u1', 'u2', 'u3')").collect())
    assert sorted(extract_wanted_pages(pages, items).collect()) == want
    # A filter that lets half of all keys through changes nothing: the semi-join is exact.
    assert sorted(extract_wanted_pages(pages, items, rate=0.5).collect()) == want
    assert extract_wanted_pages(pages, items.limit(0)).count() == 0


def test_unreferenced_pages_are_not_parsed(spark):
    from labelweave.operators import bloom

    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('https://x.org/', id) AS url", "'<p>x</p>' AS html")
    wanted = spark.range(0, 20_000, 200).selectExpr("concat('https://x.org/', id) AS url")
    filter_ = bloom.build(wanted, "url")
    assert filter_.n_bits >= 100 * 9 and filter_.n_hashes == 7
    passed = bloom.probe(pages, "url", filter_)
    # All 100 wanted URLs pass, and of the 19,900 others about 1 %: the rest never reach the markup.
    assert set(r.url for r in wanted.collect()) <= set(r.url for r in passed.collect())
    assert passed.count() < 100 + 0.03 * 19_900
    assert bloom.probe(pages, "url", None).count() == 20_000


def test_probe_is_the_filters_own_test(spark):
    from labelweave.operators import bloom

    keys = spark.range(500).selectExpr("concat('k', id) AS url")
    filter_ = bloom.build(keys, "url")
    probes = spark.range(5_000).selectExpr("concat('k', id) AS url", "xxhash64(concat('k', id)) AS h1",
                                          "xxhash64('bloom', concat('k', id)) AS h2").collect()
    by_numpy = filter_.might_contain(np.array([r.h1 for r in probes]), np.array([r.h2 for r in probes]))
    passed = {r.url for r in bloom.probe(spark.createDataFrame([(r.url,) for r in probes], "url string"), "url", filter_).collect()}
    assert passed == {r.url for r, hit in zip(probes, by_numpy) if hit}
    assert {f"k{i}" for i in range(500)} <= passed
