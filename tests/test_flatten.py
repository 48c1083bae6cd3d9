import json

import pytest

from labelweave.operators.flatten import MATCH_TEXT, flatten_items, flatten_labels
from labelweave.sources.catalogue import label_dictionary, parse_catalogue, read_catalogue
from tests.conftest import plan_of

ITEM_A = {"type": "section", "description": "Powers", "text": None, "title": "1.1", "numbers": ["1", "1"],
          "url": "http://x/1", "standards": ["8.EE.A.1", "8.EE.A.2"]}
ITEM_B = {"title": "Roots", "standards": []}
ITEM_C = {"description": "Cones", "standards": ["8.G.C.9"]}
FIRST = {
    "standards_definitions": {"8.EE.A.1": "Know powers", "8.G.C.9": "Know volumes", "8": "All"},
    "titles": [
        {"title": "Book 1", "items": [
            {"concept": "Numbers", "domain": "EE", "standards": ["8.EE.A"],
             "clusters": [{"cluster": "Work with radicals", "items": [ITEM_A, ITEM_B]}, {"cluster": "Empty", "items": []}]},
            {"concept": "No clusters"},
            {"clusters": [{"items": [{}]}, {"cluster": "No items"}]},
        ]},
        {"title": "Book without groups"},
        {"title": "Book 2", "items": [{"domain": "G", "clusters": [{"cluster": "Volumes", "items": [ITEM_C]}]}]},
    ],
}
SECOND = {"titles": [{"title": "Book 3", "items": [{"clusters": [{"items": [ITEM_C, ITEM_B]}]}]}]}
NO_BOOKS = {"titles": []}


def parsed(spark, *documents):
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)]
    return parse_catalogue(spark.createDataFrame(rows, "part long, document string"), carry=("part",))


def test_profile_form(spark):
    rows = flatten_items(parsed(spark, FIRST)).orderBy("item_id").collect()
    assert [r.item_id for r in rows] == [0, 1, 2, 3]
    assert [r.book_title for r in rows] == ["Book 1", "Book 1", "Book 1", "Book 2"]
    assert [r.combined_text for r in rows] == ["Powers 1.1", "Roots", "", "Cones"]
    assert [r.standard for r in rows] == ["8.EE.A.1", None, None, "8.G.C.9"]
    assert [r.all_standards for r in rows] == ["8.EE.A.1,8.EE.A.2", "", "", "8.G.C.9"]
    assert [r.category for r in rows] == ["8.EE", None, None, "8.G"]
    assert [r.numbers for r in rows] == ["1,1", "", "", ""]
    assert [r.url for r in rows] == ["http://x/1", "", "", ""]
    assert rows[2].concept == rows[2].domain == rows[2].cluster_description == rows[2].item_type == ""


def test_match_form(spark):
    items = flatten_items(parsed(spark, FIRST), text_fields=MATCH_TEXT, with_hint=True, include_labels=False)
    assert "standard" not in items.columns
    rows = items.orderBy("item_id").collect()
    assert rows[0].combined_text == "Powers 1.1 Work with radicals Numbers EE"
    assert [r.category_standard for r in rows] == ["8.EE.A", "8.EE.A", None, None]


def test_numbers_run_on_across_parts(spark):
    parts = parsed(spark, FIRST, NO_BOOKS, SECOND)
    rows = flatten_items(parts, order_by="part", carry=("part",)).orderBy("item_id").collect()
    assert [(r.part, r.item_id) for r in rows] == [(0, 0), (0, 1), (0, 2), (0, 3), (2, 4), (2, 5)]
    own = flatten_items(parts, carry=("part",)).where("part = 2").orderBy("item_id").collect()
    assert [r.item_id for r in own] == [0, 1]


def test_labels_number_every_item(spark):
    rows = flatten_labels(parsed(spark, FIRST)).orderBy("item_id").collect()
    assert [tuple(r) for r in rows] == [(0, "8.EE.A.1"), (3, "8.G.C.9")]


def test_dictionary_keeps_its_order(spark):
    rows = label_dictionary(parsed(spark, FIRST)).orderBy("ord").collect()
    assert [r.std_id for r in rows] == ["8.EE.A.1", "8.G.C.9", "8"]
    assert [r.category for r in rows] == ["8.EE", "8.G", "8"]
    assert rows[0].std_text == "8.EE.A.1: Know powers"


def test_catalogue_without_titles_fails(spark):
    with pytest.raises(Exception, match="without titles"):
        flatten_items(parsed(spark, {"standards_definitions": {}})).collect()


def test_broken_json_fails(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text('{"titles": [')
    with pytest.raises(Exception):
        read_catalogue(spark, str(path)).collect()


def test_one_document_is_flattened_without_shuffle_or_python(spark):
    plan = plan_of(flatten_items(parsed(spark, FIRST)))
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "Python" not in plan
