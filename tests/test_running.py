import random

from labelweave.plans import running
from tests.conftest import plan_of


def test_running_offset_equals_a_plain_sum(spark):
    rng = random.Random(1)
    keys = rng.sample(range(500), 120)
    rows = [(k, rng.randrange(5)) for k in keys]
    df = spark.createDataFrame(rows, "k long, n long")
    expected, total = {}, 0
    for k, n in sorted(rows):
        expected[k], total = total, total + n
    for levels in (0, 1, 2):
        got = running.running_offset(df, "k", "n", "first", fan_out=7, levels=levels).collect()
        assert {r.k: r.first for r in got} == expected


def test_first_rows_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(k * 3,) for k in range(50)], "k long")
    small = sorted(r.k for r in running.first_rows(df, "k", 9).collect())
    monkeypatch.setattr(running, "TOP_N_ROWS", 0)
    assert sorted(r.k for r in running.first_rows(df, "k", 9).collect()) == small == [k * 3 for k in range(9)]


def test_only_block_totals_meet_in_one_task(spark):
    df = spark.range(100).selectExpr("id AS k", "1 AS n")
    plan = plan_of(running.running_offset(df, "k", "n", "first", fan_out=10, levels=1))
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(single) == 1


def test_ordered_offsets_on_sparse_negative_and_large_keys(spark):
    rng = random.Random(2)
    keys = [-(2**62), -5, 0, 3, 10**12, 2**62, *rng.sample(range(-(10**9), 10**9), 300)]
    rows = [(k, rng.choice([None, 0, 1, 2, 7])) for k in keys]
    df = spark.createDataFrame(rows, "k long, n long")
    expected, total = {}, 0
    for k, n in sorted(rows):
        expected[k], total = total, total + (n or 0)
    for partitions in (1, 3, 16):
        got = running.ordered_offsets(df, "k", "n", "first", partitions).collect()
        assert {r.k: r.first for r in got} == expected
    assert running.ordered_offsets(df.limit(0), "k", "n", "first").count() == 0


def test_ordered_offsets_leave_no_window(spark):
    df = spark.range(1000).selectExpr("id * 7919 - 3000000 AS k", "1 AS n")
    plan = plan_of(running.ordered_offsets(df, "k", "n", "first", 4))
    assert "Window" not in plan and "SinglePartition" not in plan
