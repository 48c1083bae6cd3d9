"""Best references per item by cosine, without pairing rows in Spark.

Every item meets every candidate reference in a matrix product inside a task, and only the best few leave the task:
item-reference pairs never become rows. Two ways lead there, with equal results:

* the references fit a checked bound: they are broadcast and items stay where they are, no shuffle;
* they do not: references are cut into blocks and items into parts of bounded size, each block meets each part in a
  cogrouped task, and the winners per block are merged per item.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.operators.vectors import DIMS, to_matrix, to_unit
from labelweave.plans.skew import skew_join
from labelweave.session import materialise

#: Similarities are compared at this many decimals, so equal scores tie whatever the order of summation.
DECIMALS = 9
#: Cells of a similarity matrix held at once by a task.
CELLS = 4_000_000


@dataclass(frozen=True)
class Limits:
    """Sizes that decide between broadcast and blocks, and the size of a block."""

    broadcast_rows: int = 32_768
    broadcast_bytes: int = 256 << 20
    block_rows: int = 16_384


def collect_within(df: DataFrame, limits: Limits) -> pa.Table | None:
    """All rows if they are within the limits, else None.

    At most ``broadcast_rows + 1`` rows reach the driver, and none behind the one whose vector passes
    ``broadcast_bytes``; a vector counts as the longer of its list and its row of the broadcast matrix.
    """
    of_counts = df.schema["vector"].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    own = F.greatest(F.size("vector"), F.lit(DIMS if of_counts else 0)).cast("long") * 8
    one_task = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.limit(limits.broadcast_rows + 1).withColumn("_bytes", own)
    before = rows.withColumn("_before", F.coalesce(F.sum("_bytes").over(one_task), F.lit(0)))
    table = before.filter(F.col("_before") <= limits.broadcast_bytes).toArrow()
    size = pc.sum(table["_bytes"]).as_py() or 0
    table = table.drop_columns(["_bytes", "_before"])
    within = table.num_rows <= limits.broadcast_rows and max(size, table.nbytes) <= limits.broadcast_bytes
    return table if within else None


def dimensions(table: pa.Table, dims: int | None) -> int:
    """Vector size: as given, else that of the first vector that isn't empty; bucket lists have DIMS."""
    vectors = table["vector"]
    if dims:
        return dims
    if pa.types.is_integer(vectors.type.value_type):
        return DIMS
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    return int(sizes[np.argmax(sizes > 0)]) if len(sizes) else 0


def row_keyed(items: DataFrame, key: str) -> DataFrame:
    """Items with a key of their own per row, since a caller's id may repeat or be null; written, so that keys stay."""
    return materialise(items.withColumn(key, F.monotonically_increasing_id()))


def best_columns(rows: np.ndarray, references: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best references per row; the first one wins ties. Both are n x min(k, m)."""
    n, m = len(rows), len(references)
    k = min(k, m)
    best, score = np.zeros((n, k), dtype=np.int64), np.zeros((n, k))
    step = max(1, CELLS // max(1, m))
    for start in range(0, n, step):
        part = slice(start, start + step)
        similarity = np.round(rows[part] @ references.T, DECIMALS)
        every = np.arange(len(similarity))
        for rank in range(k):
            best[part, rank] = winner = similarity.argmax(axis=1)
            score[part, rank] = similarity[every, winner]
            similarity[every, winner] = -np.inf
    return best, score


MATCHES = "array<struct<similarity:double,ord:bigint,id:string>>"


def _as_matches(best: np.ndarray, score: np.ndarray, table: pa.Table) -> pa.Array:
    n, k = best.shape
    flat = pa.array(best.ravel())
    structs = pa.StructArray.from_arrays(
        [
            pa.array(score.ravel()),
            table["ord"].combine_chunks().cast(pa.int64()).take(flat),
            table["id"].combine_chunks().cast(pa.string()).take(flat),
        ],
        ["similarity", "ord", "id"],
    )
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), structs)


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("ord").combine_chunks()


def top_references(
    items: DataFrame,
    references: DataFrame,
    k: int = 1,
    *,
    item_id: str = "item_id",
    vector: str = "vector",
    dims: int | None = None,
    scale: bool = True,
    limits: Limits = Limits(),
    out: str = "matches",
) -> DataFrame:
    """Items with an array of their ``k`` most similar references, best first.

    ``references`` needs ``ord`` (unique integer, decides ties), ``id`` and ``vector``. Every reference is scored.
    ``scale=False`` takes the references' vectors as they are, for the product with a mean of unit vectors.
    """
    references = references.select(F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id"), "vector")
    table = collect_within(references, limits)
    if table is None:
        items = row_keyed(items, "_scored_row")
        matched = cogroup_matches(
            items.select("_scored_row", F.col(vector).alias("vector")), references, k,
            item_id="_scored_row", dims=dims, scale=scale, limits=limits, out=out,
        )
        return items.join(matched, "_scored_row", "left").drop("_scored_row")
    if table.num_rows == 0:
        return items.withColumn(out, F.array().cast(MATCHES))
    table = _sorted(table)
    size = dimensions(table, dims)
    matrix = to_matrix(table["vector"], size)
    shared = items.sparkSession.sparkContext.broadcast(
        (to_unit(matrix) if scale else matrix, table.select(["ord", "id"]))
    )

    @F.arrow_udf(MATCHES)
    def match(vectors: pa.Array) -> pa.Array:
        matrix, names = shared.value
        best, score = best_columns(to_unit(to_matrix(vectors, size)), matrix, k)
        return _as_matches(best, score, names)

    # Marked so that a later filter on the matches is not pushed below it, which would score every item twice.
    return items.withColumn(out, match.asNondeterministic()(vector))


def _spread(df: DataFrame, by: str, own: str, n_own: Column, other: str, n_other: Column) -> DataFrame:
    """Give every row its own block number and one copy per block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(by), n_own).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), (n_other - 1).cast("int")))
    ).drop("_parts", "_blocks")


def cogroup_matches(
    items: DataFrame,
    references: DataFrame,
    k: int,
    *,
    item_id: str = "item_id",
    dims: int | None = None,
    scale: bool = True,
    limits: Limits = Limits(),
    out: str = "matches",
) -> DataFrame:
    """``(item_id, matches)`` for references of any size, within their ``scope`` only if both sides have one.

    Rows are dealt to blocks by the hash of their id, so a scope that holds most of the items or references becomes
    many tasks of about ``block_rows`` rows a side. Each task hands back at most k matches per item.
    """
    if dims is None:
        sample = references.select("vector").where(F.size("vector") > 0).limit(1).toArrow()
        dims = dimensions(sample, None)

    if "scope" in references.columns:
        keys = ["scope", "_part", "_block"]
        rows = F.count(F.lit(1))
        # One row per scope on either side; counts are combined before the shuffle.
        sizes = items.groupBy("scope").agg(F.ceil(rows / limits.block_rows).alias("_parts")).join(
            references.groupBy("scope").agg(F.ceil(rows / limits.block_rows).alias("_blocks")), "scope"
        )
        items = skew_join(items, sizes, "scope", "inner", spread_by=item_id)
        references = skew_join(references, sizes, "scope", "inner", spread_by="ord")
        parts, blocks = F.col("_parts"), F.col("_blocks")
    else:
        keys = ["_part", "_block"]
        parts, blocks = (
            F.lit(max(1, -(-df.count() // limits.block_rows))).cast("long") for df in (items, references)
        )
    left = _spread(items, item_id, "_part", parts, "_block", blocks)
    right = _spread(references, "ord", "_block", blocks, "_part", parts)
    key_type = items.schema[item_id].dataType.simpleString()

    def match(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if mine.num_rows == 0 or theirs.num_rows == 0:
            return pa.table({item_id: mine[item_id].slice(0, 0), out: _empty_matches()})
        theirs = _sorted(theirs)
        matrix = to_matrix(theirs["vector"], dims)
        best, score = best_columns(
            to_unit(to_matrix(mine["vector"], dims)), to_unit(matrix) if scale else matrix, k
        )
        return pa.table({item_id: mine[item_id], out: _as_matches(best, score, theirs)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        match, f"{item_id} {key_type}, {out} {MATCHES}"
    )
    if k == 1:
        # One winner per block: a combining maximum, nothing is collected.
        first = F.col(out)[0]
        best = F.max(F.struct(first["similarity"].alias("similarity"), (-first["ord"]).alias("late"), first["id"].alias("id")))
        return found.groupBy(item_id).agg(best.alias("_best")).select(
            item_id,
            F.array(
                F.struct(
                    F.col("_best.similarity").alias("similarity"),
                    (-F.col("_best.late")).alias("ord"),
                    F.col("_best.id").alias("id"),
                )
            ).alias(out),
        )
    # Ranked, not collected: blocks are many when references are, and most rows are dropped before the shuffle.
    order = Window.partitionBy(item_id).orderBy(F.desc("_match.similarity"), "_match.ord")
    ranked = (
        found.select(item_id, F.explode(out).alias("_match"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
    )
    kept = F.sort_array(F.collect_list(F.struct("_rank", "_match")))
    return ranked.groupBy(item_id).agg(F.transform(kept, lambda r: r["_match"]).alias(out))


def _empty_matches() -> pa.Array:
    return _as_matches(
        np.zeros((0, 1), dtype=np.int64),
        np.zeros((0, 1)),
        pa.table({"ord": pa.array([], pa.int64()), "id": pa.array([], pa.string())}),
    )
