import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelweave.operators.classify import classify, match_definitions, predictions, transfer_labels
from labelweave.operators.scoring import Limits, collect_within, top_references
from labelweave.operators.vectors import cosine, encode, hash_buckets, to_matrix
from labelweave.queries.encoder import HashedCounts
from tests.conftest import plan_of

SHARED = Limits()
BLOCKS = Limits(broadcast_rows=0, block_rows=5)
BOTH = pytest.mark.parametrize("limits", [SHARED, BLOCKS], ids=["broadcast", "blocks"])

ITEM = "item_id long, vector array<float>, hint string, standard string"
LABEL = "ord long, std_id string, category string, vector array<float>"


def cos(a, b):
    na, nb = math.hypot(*a), math.hypot(*b)
    return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9) if na and nb else 0.0


def brute(vector, hint, labels, exact=False):
    """Nearest label inside the hinted or the best category, first one wins."""
    categories = list(dict.fromkeys(c for _, _, c, _ in labels))
    if hint and hint in categories:
        inside = [x for x in labels if (x[2] == hint if exact else x[2].startswith(hint))]
    else:
        def mean(category):
            sims = [cos_raw(vector, v) for _, _, c, v in labels if c == category]
            return round(sum(sims) / len(sims), 9)

        best = max(categories, key=mean)
        inside = [x for x in labels if x[2] == best]
    winner = max(inside, key=lambda x: cos(vector, x[3]))
    return winner[1], cos(vector, winner[3])


def cos_raw(a, b):
    na, nb = math.hypot(*a), math.hypot(*b)
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def example(seed=3, n_items=60, n_labels=40):
    rng = random.Random(seed)
    draw = lambda: [float(rng.randint(-3, 3)) for _ in range(6)]
    labels = []
    for i in range(n_labels):
        category = f"H.{rng.choice(['C', 'CO', 'D', 'E1', 'E10'])}"
        labels.append((i, f"{category}.{i}", category, draw()))
    labels[7] = (*labels[7][:3], [0.0] * 6)
    labels[9] = (*labels[9][:3], labels[8][3])
    hints = [None, "", "H.C", "H.CO", "H.E1", "H.C.4", "X", "H"]
    items = [(i, draw(), rng.choice(hints), rng.choice(labels)[1]) for i in range(n_items)]
    items[0] = (0, [0.0] * 6, None, None)
    return items, labels


@BOTH
@pytest.mark.parametrize("exact", [False, True])
def test_classify_equals_brute_force(spark, limits, exact):
    items, labels = example()
    got = classify(
        spark.createDataFrame(items, ITEM), spark.createDataFrame(labels, LABEL), exact=exact, limits=limits
    ).collect()
    assert len(got) == len(items)
    found = {r.item_id: (r.predicted_standard, r.confidence) for r in got}
    for item_id, vector, hint, _ in items:
        label, similarity = brute(vector, hint, labels, exact)
        assert found[item_id][0] == label, (item_id, hint)
        assert found[item_id][1] == pytest.approx(similarity, abs=1e-8)
        assert -1 <= found[item_id][1] <= 1


@BOTH
def test_a_prefix_hint_admits_longer_categories(spark, limits):
    labels = [(0, "H.C.1", "H.C", [1.0, 0.0]), (1, "H.CO.1", "H.CO", [0.0, 1.0])]
    items = [(0, [0.1, 1.0], "H.C", None), (1, [0.1, 1.0], "H.C.1", None), (2, [1.0, 0.1], "H.CO", None)]
    df, dictionary = spark.createDataFrame(items, ITEM), spark.createDataFrame(labels, LABEL)
    by = lambda exact: {
        r.item_id: r.predicted_standard for r in classify(df, dictionary, exact=exact, limits=limits).collect()
    }
    assert by(False) == {0: "H.CO.1", 1: "H.CO.1", 2: "H.CO.1"}
    assert by(True) == {0: "H.C.1", 1: "H.CO.1", 2: "H.CO.1"}


@BOTH
def test_ties_go_to_the_first(spark, limits):
    labels = [(5, "B.1.5", "B.1", [1.0, 1.0]), (2, "A.1.2", "A.1", [2.0, 2.0]), (3, "A.1.3", "A.1", [1.0, 1.0])]
    items = [(0, [1.0, 1.0], None, None), (1, [0.0, 0.0], None, None)]
    got = classify(spark.createDataFrame(items, ITEM), spark.createDataFrame(labels, LABEL), limits=limits).collect()
    assert {r.item_id: (r.predicted_standard, round(r.confidence, 6)) for r in got} == {
        0: ("A.1.2", 1.0), 1: ("A.1.2", 0.0),
    }


def test_single_label_and_no_labels(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0], None, None)], ITEM)
    one = spark.createDataFrame([(0, "8", "8", [0.0, 1.0])], LABEL)
    assert predictions(classify(items, one)).first().predicted_standard == "8"
    none = classify(items, one.limit(0)).first()
    assert none.predicted_standard is None and none.confidence is None


def test_scaling_a_vector_changes_nothing(spark):
    items, labels = example(11)
    scaled = [(i, [x * 7 for x in v], h, s) for i, v, h, s in items]
    dictionary = spark.createDataFrame(labels, LABEL)
    a, b = (
        {r.item_id: r.predicted_standard for r in classify(spark.createDataFrame(x, ITEM), dictionary).collect()}
        for x in (items, scaled)
    )
    assert a == b


@BOTH
def test_definition_match_takes_every_label(spark, limits):
    items, labels = example(5)
    got = match_definitions(
        spark.createDataFrame(items, ITEM), spark.createDataFrame(labels, LABEL), limits=limits
    ).collect()
    for r in got:
        best = max(labels, key=lambda x: (cos(items[r.item_id][1], x[3]), -x[0]))
        assert r.predicted_standard == best[1]


@BOTH
def test_neighbours_and_votes(spark, limits):
    items, labels = example(6)
    df = spark.createDataFrame(items, ITEM)
    training = spark.createDataFrame([(o, c, v) for o, _, c, v in labels], "ord long, id string, vector array<float>")
    near = {r.item_id: [(m.ord, m.id) for m in r.matches] for r in top_references(df, training, 5, limits=limits).collect()}
    voted = {r.item_id: r.predicted_standard for r in transfer_labels(df, training, 5, limits=limits).collect()}
    for item_id, vector, _, _ in items:
        ranked = sorted(labels, key=lambda x: (-cos(vector, x[3]), x[0]))[:5]
        assert near[item_id] == [(x[0], x[2]) for x in ranked]
        names = [x[2] for x in ranked]
        best = {c: max(cos(vector, x[3]) for x in ranked if x[2] == c) for c in names}
        assert voted[item_id] == min(names, key=lambda c: (-names.count(c), -best[c], c))


@BOTH
def test_fewer_references_than_k(spark, limits):
    items = spark.createDataFrame([(0, [1.0, 0.0])], "item_id long, vector array<float>")
    refs = spark.createDataFrame([(0, "a", [1.0, 0.0])], "ord long, id string, vector array<float>")
    assert [m.id for m in top_references(items, refs, 5, limits=limits).first().matches] == ["a"]


def test_bucket_lists_are_counts(spark):
    texts = spark.createDataFrame([(0, "cone cone area"), (1, "slope"), (2, "")], "item_id long, t string")
    vectors = texts.select("item_id", hash_buckets(F.split("t", " ")).alias("vector"))
    refs = spark.createDataFrame([(0, "x", "cone area"), (1, "y", "slope")], "ord long, id string, t string")
    refs = refs.withColumn("vector", hash_buckets(F.split("t", " ")))
    for limits in (SHARED, BLOCKS):
        rows = top_references(vectors, refs, 1, limits=limits, dims=384).collect()
        got = {r.item_id: (r.matches[0].id, round(r.matches[0].similarity, 6)) for r in rows}
        assert got[0] == ("x", round(3 / math.sqrt(10), 6)) and got[1] == ("y", 1.0)


def test_vectors_of_other_size_fail(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0, 2.0])], "item_id long, vector array<float>")
    refs = spark.createDataFrame([(0, "a", [1.0, 0.0])], "ord long, id string, vector array<float>")
    with pytest.raises(Exception, match="2 dimensions"):
        top_references(items, refs, 1).collect()


def test_row_cosine(spark):
    rows = [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == pytest.approx([0.8, 0.0])


def test_encoder_hook(spark):
    df = spark.createDataFrame([("a b a",), (None,)], "t string")
    rows = df.select(encode(F.col("t"), HashedCounts, batch_size=1).alias("v")).collect()
    assert [sum(r.v) for r in rows] == [3.0, 0.0] and len(rows[0].v) == 384


def test_plans(spark):
    items, labels = example(5)
    df, dictionary = spark.createDataFrame(items, ITEM), spark.createDataFrame(labels, LABEL)
    plan = plan_of(classify(df, dictionary).where("confidence > 0"))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    big = plan_of(classify(df, dictionary, limits=BLOCKS))
    assert "CartesianProduct" not in big and "NestedLoop" not in big


def test_repeated_ids_and_odd_labels_on_both_sides_of_the_limit(spark):
    """Rows of one id keep their own answers; an empty first vector or a missing category changes neither way."""
    from labelweave.operators.classify import classify, match_definitions
    from labelweave.operators.scoring import Limits

    labels = spark.createDataFrame(
        [(0, "A.1.a", "A.1", None), (1, "A.1.b", "A.1", [1.0, 0.0]), (2, "B.1.a", "B.1", [0.0, 1.0]), (3, "C", None, [1.0, 1.0])],
        "ord bigint, std_id string, category string, vector array<double>",
    )
    items = spark.createDataFrame(
        [(7, 1, [1.0, 0.1], ""), (7, 2, [0.1, 1.0], ""), (7, 3, [1.0, 0.2], "B.1"), (None, 4, [0.0, 2.0], None)],
        "item_id bigint, variant int, vector array<double>, hint string",
    )
    for run, expected in (
        (classify, {1: "A.1.b", 2: "B.1.a", 3: "B.1.a", 4: "B.1.a"}),
        (match_definitions, {1: "A.1.b", 2: "B.1.a", 3: "A.1.b", 4: "B.1.a"}),
    ):
        for limits in (Limits(), Limits(broadcast_rows=0)):
            got = {r.variant: r.predicted_standard for r in run(items, labels, limits=limits).collect()}
            assert got == expected, (run.__name__, limits)


def test_few_long_lists_take_the_block_path(spark):
    refs = spark.range(6).select(F.col("id").alias("ord"), F.array_repeat(F.lit(1), 1000).alias("vector"))
    assert collect_within(refs, Limits(broadcast_bytes=48_000)).num_rows == 6
    assert collect_within(refs, Limits(broadcast_bytes=30_000)) is None
    assert collect_within(refs, Limits(broadcast_rows=5)) is None
    assert collect_within(refs.limit(0), Limits()).num_rows == 0


def test_buckets_out_of_range_fail():
    with pytest.raises(ValueError, match="from 0 to 3"):
        to_matrix(pa.array([[0, 4]], pa.list_(pa.int32())), 4)
