import pytest

from labelweave.operators import evaluate as E
from labelweave.operators import profile as P

SCHEMA = "item_id long, predicted_standard string, true_standard string"
ROWS = [
    (0, "A.1.1", "A.1.1"), (1, "A.1.2", "A.1.1"), (2, "A.1.1", "A.1.1"), (3, "B.1.1", "B.1.1"), (4, "A.1.1", "B.1.1"),
    (5, "A.1.1", None), (6, None, "C.1.1"), (7, "Z.1.1", "C.1.1"), (8, "D.1.1", "D.1.1"),
]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_attach_truth_is_an_inner_join(spark):
    truth = spark.createDataFrame([(0, "A"), (1, "B")], "item_id long, true_standard string")
    predicted = spark.createDataFrame([(1, "B"), (2, "C")], "item_id long, predicted_standard string")
    assert [tuple(r) for r in E.attach_truth(predicted, truth).collect()] == [(1, "B", "B")]


def test_accuracy_counts_missing_truth_as_wrong(scored):
    row = E.accuracy(scored).first()
    assert (row.total, row.correct, row.verdict) == (9, 4, "below") and row.accuracy == pytest.approx(4 / 9)
    empty = E.accuracy(scored.limit(0)).first()
    assert (empty.total, empty.correct, empty.accuracy) == (0, 0, None)


def test_per_label_tables(scored):
    rows = E.per_label_accuracy(scored).collect()
    assert [(r.standard, r.correct, r.total) for r in rows] == [
        ("A.1.1", 2, 3), ("B.1.1", 1, 2), ("C.1.1", 0, 2), ("D.1.1", 1, 1),
    ]
    table = E.performance_table(scored).collect()
    assert [r.standard for r in table] == ["C.1.1", "B.1.1", "A.1.1", "D.1.1"]
    assert [r.tier[:4] for r in table] == ["Fail", "Good", "Good", "Perf"]
    assert tuple(E.tier_counts(scored).first()) == (4, 1, 3)


def test_top_labels_break_ties_by_name(scored):
    assert [tuple(r) for r in E.top_labels(scored, 2).collect()] == [("A.1.1", 3), ("B.1.1", 2)]


def test_confusion(scored):
    cells = {(r.true_standard, r.predicted_standard): r.n for r in E.confusion_topk(scored, 3).collect()}
    assert len(cells) == 9
    assert cells == {
        (t, p): sum(1 for _, a, b in ROWS if (b, a) == (t, p))
        for t in ("A.1.1", "B.1.1", "C.1.1") for p in ("A.1.1", "B.1.1", "C.1.1")
    }
    wide = {r.true_standard: r for r in E.confusion_matrix(scored, 3).collect()}
    assert wide["B.1.1"]["A.1.1"] == 1 and wide["C.1.1"]["C.1.1"] == 0


def test_category_confusion(scored):
    rows = {(r.true_category, r.predicted_category): (r.n, r.crossed) for r in E.category_confusion(scored).collect()}
    assert rows[("A.1", "A.1")] == (3, False) and rows[("B.1", "A.1")] == (1, True) and rows[("C.1", None)] == (1, True)


def test_overlap_is_symmetric(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "standard string")
    b = spark.createDataFrame([("y",), ("z",), (None,)], "standard string")
    assert [r[0] for r in E.label_overlap(a, b).collect()] == [r[0] for r in E.label_overlap(b, a).collect()] == ["y"]
    assert tuple(E.label_counts(a, b).first()) == (2, 2, 1)
    assert tuple(E.label_counts(a.limit(0), b).first()) == (0, 2, 0)


def test_comparison(spark, scored):
    right = scored.selectExpr("item_id", "true_standard AS predicted_standard", "true_standard")
    rows = {r.approach: r for r in E.compare_approaches({"base": scored, "oracle": right}, "base").collect()}
    assert rows["base"].gain == 0 and rows["oracle"].gain == pytest.approx(4 / 9)
    with pytest.raises(ValueError):
        E.compare_approaches({"base": scored}, "other")


def test_summary(spark, scored):
    a = spark.createDataFrame([("x",)], "standard string")
    texts = spark.createDataFrame([("abcd",), ("ab",)], "t string")
    got = {r.metric: r.value for r in E.summary_table(scored, a, a, texts, "t", 6).collect()}
    assert got == {
        "Total Test Items": "9", "Correct Predictions": "4", "Overall Accuracy": "44.4%", "Standards at 100%": "1 / 4 (25%)",
        "Standards at 50%+": "3 / 4 (75%)", "Embedding Dimension": "6 dimensions", "Training/Test Overlap": "1 standards",
        "Text Length (avg)": "3 characters",
    }


def test_profile(spark):
    items = spark.createDataFrame(
        [(0, "a", "u", "t", "L1", ["L1", "L2"]), (1, "b", "", "", None, []), (2, "a", None, "t", "L1", ["L1,x"]), (3, None, "u", "t", "L2", None)],
        "item_id long, item_type string, url string, combined_text string, standard string, standards array<string>",
    )
    assert tuple(P.item_profile(items).first()) == (4, 2, 50.0, 3, 1)
    assert [tuple(r) for r in P.frequency(items, "item_type").collect()] == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in P.frequency(items, "standard", 1).collect()] == [("L1", 2)]
    assert [tuple(r) for r in P.labels_histogram(items).collect()] == [(0, 2), (1, 1), (2, 1)]
    assert [r.item_id for r in P.sample_rows(items, 2).collect()] == [0, 1]
    assert tuple(P.row_at(items, 2, "combined_text").first()) == (2, 1, "t")
    lengths = P.length_reduction(items, "item_type", "combined_text").first()
    assert lengths.mean_before == 1.0 and lengths.mean_after == 0.75 and lengths.reduction_percent == 25.0
