"""The three end-to-end jobs, files included, and the streaming form."""

import json

import pytest
from pyspark.sql import functions as F

from labelweave.operators.flatten import MATCH_TEXT, flatten_items
from labelweave.operators.vectors import encode
from labelweave.plans.align import align
from labelweave.plans.prepare import prepare
from labelweave.plans.report import report
from labelweave.queries.encoder import HashedCounts
from labelweave.sources import tables
from labelweave.sources.catalogue import label_dictionary, read_catalogue
from labelweave.streaming.align_stream import stream_catalogues, write_stream

DEFINITIONS = {
    "8.G.C.9": "Know the formulas for volumes of cones cylinders spheres",
    "8.G.B.7": "Apply the pythagorean theorem to right triangles",
    "8.EE.A.1": "Know the properties of integer exponents",
    "8.EE.A.2": "Use square root and cube root symbols",
}


def catalogue(*items):
    return {
        "standards_definitions": DEFINITIONS,
        "titles": [{"title": "Book", "items": [
            {"concept": "Geometry", "domain": "G", "standards": ["8.G"], "clusters": [{"cluster": "Shapes", "items": list(items[:2])}]},
            {"concept": "Expressions", "domain": "EE", "clusters": [{"cluster": "Radicals", "items": list(items[2:])}]},
        ]}],
    }


TESTING = catalogue(
    {"type": "section", "title": "Volumes of cones, \"big\" ones", "url": "u0", "standards": ["8.G.C.9"]},
    {"type": "section", "title": "Right triangles", "standards": ["8.G.B.7"]},
    {"type": "exercise", "title": "Square root symbols\nand cube root", "standards": []},
    {"type": "section", "title": "Integer exponents", "url": "u3", "standards": ["8.EE.A.1"]},
)
TRAINING = catalogue({"title": "Slope", "standards": ["8.F.A.1"]}, {"title": "Lines", "standards": ["8.EE.A.1"]})


@pytest.fixture
def files(tmp_path):
    for name, content in {"training": TRAINING, "testing": TESTING}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    return tmp_path


def test_prepare(spark, files):
    prepared = prepare(spark, str(files / "training.json"), str(files / "testing.json"))
    assert prepared.train.count() == 2 and prepared.test.count() == 4 and "standard" not in prepared.test.columns
    reports = {name: df.collect() for name, df in prepared.reports().items()}
    assert reports["labels"][0].labels == 4 and reports["items"][0].items == 2
    prepared.write(str(files / "out"))
    back = tables.read_items(spark, str(files / "out" / "train_items"), prepared.train.drop("standards").schema)
    assert [r.title for r in back.orderBy("item_id").collect()] == ["Slope", "Lines"]
    labels = spark.read.json(str(files / "out" / "labels")).orderBy("ord").collect()
    assert [r.std_id for r in labels] == list(DEFINITIONS)


def test_csv_keeps_quotes_and_line_ends(spark, files):
    items = flatten_items(read_catalogue(spark, str(files / "testing.json")))
    tables.write_items(items, str(files / "items"))
    back = tables.read_items(spark, str(files / "items"), items.drop("standards").schema).orderBy("item_id").collect()
    assert back[0].title == 'Volumes of cones, "big" ones' and back[2].title == "Square root symbols\nand cube root"
    assert back[2].standard is None and back[1].url is None


@pytest.mark.parametrize("approach", ["metadata", "raw_pages", "cleaned_pages"])
@pytest.mark.parametrize("encoder", [None, HashedCounts])
def test_align_and_report(spark, files, approach, encoder):
    testing, training = (read_catalogue(spark, str(files / f"{n}.json")) for n in ("testing", "training"))
    pages = spark.createDataFrame(
        [(0, "u0", "<p>volumes of spheres</p>"), (1, "u3", "<p>properties of integer exponents</p>")],
        "page_id long, url string, html string",
    )
    items = flatten_items(testing, text_fields=MATCH_TEXT, with_hint=True)
    labels = label_dictionary(training)
    predicted = align(items, labels, pages, approach=approach, make_encoder=encoder)
    rows = {r.item_id: r for r in predicted.collect()}
    assert len(rows) == 4 and rows[0].predicted_standard.startswith("8.G") and rows[0].true_standard == "8.G.C.9"
    path = str(files / "submission")
    tables.write_submission(predicted, path)
    back = tables.read_predictions(spark, path)
    assert back.columns == ["item_id", "predicted_standard"] and back.count() == 4
    result = {name: df.collect() for name, df in report(training, testing, back).items()}
    assert tuple(result["label_counts"][0]) == (2, 3, 1) and [r[0] for r in result["label_overlap"]] == ["8.EE.A.1"]
    assert result["accuracy"][0].total == 3


def test_own_category_is_only_used_when_asked(spark, files):
    testing = read_catalogue(spark, str(files / "testing.json"))
    labels = label_dictionary(testing)
    items = flatten_items(testing, text_fields=MATCH_TEXT, with_hint=True).where("item_id = 3").withColumn(
        "combined_text", F.lit("volumes of cones")
    )
    free = align(items, labels, approach="metadata").first()
    leaked = align(items, labels, approach="metadata", use_own_category=True).first()
    assert free.predicted_standard == "8.G.C.9" and leaked.predicted_standard.startswith("8.EE")
    flat = align(items, labels, approach="metadata", hierarchical=False).first()
    assert flat.predicted_standard == "8.G.C.9"


def test_stream_equals_batch(spark, files):
    lines = files / "lines"
    lines.mkdir()
    (lines / "a.json").write_text(json.dumps(TESTING) + "\n")
    labels = label_dictionary(read_catalogue(spark, str(files / "training.json")))

    def predict(documents):
        items = flatten_items(documents, text_fields=MATCH_TEXT, with_hint=True)
        return align(items, labels, approach="metadata")

    query = write_stream(
        predict(stream_catalogues(spark, str(lines))), str(files / "stream_out"), str(files / "stream_state")
    )
    assert query.awaitTermination(120)
    got = tables.read_predictions(spark, str(files / "stream_out")).orderBy("item_id").collect()
    batch = predict(read_catalogue(spark, str(lines), multiline=False)).orderBy("item_id").collect()
    assert [tuple(r) for r in got] == [(r.item_id, r.predicted_standard) for r in batch]


def test_numbers_run_on_across_documents(spark, files):
    """Three JSON lines in two files are one catalogue: ids are unique, and a perfect submission counts every item."""
    folder = files / "parts"
    folder.mkdir()
    one = catalogue({"title": "Cones", "standards": ["8.G.C.9"]}, {"title": "Triangles", "standards": ["8.G.B.7"]})
    (folder / "a.json").write_text(json.dumps(one) + "\n" + json.dumps(one) + "\n")
    (folder / "b.json").write_text(json.dumps(one) + "\n")
    docs = read_catalogue(spark, str(folder), multiline=False)
    items = flatten_items(docs)
    assert sorted(r.item_id for r in items.collect()) == list(range(6))
    perfect = items.select("item_id", F.col("standard").alias("predicted_standard"))
    row = report(docs, docs, perfect)["accuracy"].first()
    assert (row.total, row.correct, row.accuracy) == (6, 6, 1.0)


def test_writing_encodes_once_with_one_encoder_per_worker(spark, tmp_path):
    """A submission of n items makes n encodings, and no worker makes a second encoder."""
    log = tmp_path / "log"
    log.mkdir()

    def make():
        import os
        import uuid

        import numpy as np

        class Counting:
            def __init__(self):
                (log / f"made-{os.getpid()}-{uuid.uuid4()}").touch()

            def encode(self, texts):
                (log / f"texts-{uuid.uuid4()}").write_text(str(len(texts)))
                return np.ones((len(texts), 2))

        return Counting()

    predicted = spark.range(200, numPartitions=8).select(
        F.col("id").alias("item_id"), encode(F.col("id").cast("string"), make)[0].cast("string").alias("predicted_standard")
    )
    tables.write_submission(predicted, str(tmp_path / "out"))
    assert sum(int(f.read_text()) for f in log.glob("texts-*")) == 200
    workers = [f.name.split("-")[1] for f in log.glob("made-*")]
    assert len(workers) == len(set(workers)) <= 8
