"""The metric index against the exhaustive matrix product: equal matches, ties included, and fewer item copies."""

import math
import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa

from labelweave.operators import metric_index
from labelweave.operators.metric_index import IndexLimits, MetricIndex, indexed_matches
from labelweave.operators.scoring import Limits, top_references


def clustered(rng, n, centres, dims=16, spread=0.05):
    centre = centres[rng.integers(len(centres), size=n)]
    return centre + spread * rng.standard_normal((n, dims))


def frames(spark, seed=7):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    refs = clustered(rng, 3000, centres)
    refs[10] = refs[11] = refs[12]  # equal vectors: ties go to the smaller ord
    refs[20] = 0.0  # a zero vector scores 0 with everything
    items = clustered(rng, 400, centres)
    items[0] = refs[12]
    items[1] = 0.0
    references = spark.createDataFrame(
        [(i, f"L{i % 5}", [float(x) for x in v]) for i, v in enumerate(refs)], "ord long, id string, vector array<double>"
    )
    queries = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(items)] + [(400, None)], "item_id long, vector array<double>"
    )
    return references, queries


def as_dict(df):
    return {r["item_id"]: [(m["similarity"], m["ord"], m["id"]) for m in r["matches"]] for r in df.collect()}


def test_index_equals_exhaustive_ties_included(spark):
    references, queries = frames(spark)
    want = as_dict(top_references(queries, references, 5, limits=Limits(broadcast_rows=10, block_rows=700)))
    small = IndexLimits(cell_rows=100, block_rows=60, part_rows=50)
    got = as_dict(indexed_matches(queries, references, 5, limits=small))
    assert got == want
    assert [m[1] for m in got[0][:3]] == [10, 11, 12]


def test_index_sends_few_copies_on_clustered_vectors(spark):
    references, queries = frames(spark, seed=3)
    limits = IndexLimits(cell_rows=100, block_rows=100, part_rows=1000)
    index = MetricIndex(references, limits=limits)
    index.top(queries.withColumnRenamed("item_id", "q"), 5, item_id="q").count()
    blocks = int(index.blocks.sum())
    exhaustive = 401 * math.ceil(3000 / limits.block_rows)
    assert sum(index.sent) < exhaustive / 3, (index.sent, exhaustive, blocks)


def test_items_that_reach_all_cells_leave_in_small_batches(monkeypatch):
    rng = np.random.default_rng(4)
    pivots = rng.standard_normal((200, 8))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    vectors = rng.standard_normal((6000, 8))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6000), pa.int64()), pa.array(vectors.tolist()), pa.array(np.full(6000, -np.inf))], ["q", "vector", "kth"]
    )
    cells, bounds = [], metric_index._bounds
    monkeypatch.setattr(metric_index, "_bounds", lambda unit, *a: cells.append(len(unit) * 200) or bounds(unit, *a))
    sizes, seen = [], np.zeros((6000, 200), np.int64)
    for out in metric_index._copies([batch], "q", pivots, np.full(200, math.pi), 8, 5000):
        sizes.append(out.num_rows)
        np.add.at(seen, (out.column("q").to_numpy(), out.column("cell").to_numpy()), 1)
    assert max(sizes) <= 5000 and max(cells) <= 1_000_000
    assert seen.max() == 1 and (seen.sum(axis=1) == 199).all()
    assert (seen[np.arange(6000), (vectors @ pivots.T).argmax(axis=1)] == 0).all()


def test_index_of_no_references(spark):
    references, queries = frames(spark)
    got = indexed_matches(queries, references.limit(0), 3).collect()
    assert len(got) == 401 and all(r["matches"] == [] for r in got)


def stored_bytes(spark):
    folder = spark.sparkContext.getCheckpointDir()
    folder = urlparse(folder).path if folder else ""
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


def uniform(spark, n, seed, key="item_id long"):
    vectors = np.random.default_rng(seed).standard_normal((n, 24))
    names = [(i, f"L{i % 7}") if "id string" in key else (i,) for i in range(n)]
    return spark.createDataFrame(
        [(*name, [float(x) for x in v]) for name, v in zip(names, vectors)], f"{key}, vector array<double>"
    )


def test_rows_written_grow_with_items_and_references_where_no_cell_can_be_skipped(spark):
    """Copies of items for each cell grew with the square; these, which compress well, were 2.8 times the bytes for twice
    the rows."""
    limits = IndexLimits(cell_rows=10, block_rows=200, part_rows=100)
    written = []
    for n in (500, 1000):
        items, references = uniform(spark, n, 1), uniform(spark, n, 2, "ord long, id string")
        before = stored_bytes(spark)
        got = indexed_matches(items, references, 5, limits=limits)
        matches = as_dict(got)
        written.append(stored_bytes(spark) - before)
        assert matches == as_dict(top_references(items, references, 5))
    vectors = 2000 * 24 * 8
    assert 0 < written[1] < 8 * vectors and written[1] < 2.4 * written[0], written


def test_equal_vectors_and_other_keys(spark):
    """One cell holds all references, held by several tasks: blocks and parts stay small, the smallest ords win, keys may be strings."""
    references = spark.createDataFrame([(i, f"L{i}", [1.0, 2.0]) for i in range(500)], "ord long, id string, vector array<float>")
    items = spark.createDataFrame(
        [(f"i{i}", [2.0, 4.0] if i % 2 else [-1.0, 0.5]) for i in range(300)], "item_id string, vector array<float>"
    )
    index = MetricIndex(references, limits=IndexLimits(cell_rows=20, block_rows=60, part_rows=40, hold_bytes=2000))
    sizes = [len(row["ords"]) for row in index.references.select("ords").collect()]
    assert max(sizes) <= 60 and sum(sizes) == 500
    got = as_dict(index.top(items, 3))
    assert got == {f"i{i}": [(1.0 if i % 2 else 0.0, j, f"L{j}") for j in range(3)] for i in range(300)}


def test_fewer_references_than_matches(spark):
    references = uniform(spark, 7, 3, "ord long, id string")
    items = uniform(spark, 50, 4)
    small = IndexLimits(cell_rows=2, block_rows=2, part_rows=9, hold_bytes=400)
    assert as_dict(indexed_matches(items, references, 12, limits=small)) == as_dict(top_references(items, references, 12))


def test_runs_are_bounded_and_of_one_key():
    rng = np.random.default_rng(5)
    home = np.sort(rng.integers(6, size=1000))
    table = pa.table({"home": home, "at": np.arange(1000)})
    for size in (7, 64, 1000):
        runs = list(metric_index._runs(table.to_batches(max_chunksize=size), 50, "home"))
        assert max(r.num_rows for r in runs) <= 50 and all(len(set(r["home"].to_pylist())) == 1 for r in runs)
        assert pa.concat_tables(runs).equals(table)
        assert len(runs) == sum(math.ceil(n / 50) for n in np.bincount(home))
