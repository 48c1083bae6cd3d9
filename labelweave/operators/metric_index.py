"""Exact top-k by cosine beyond the broadcast bound: references in pivot cells, cells skipped by their ball bound.

References are dealt to the nearest of a few pivots, and each cell keeps its angular radius: the largest angle from
its pivot to one of its references. For an item at angle ``a`` from a pivot, no reference of that cell is more
similar than ``cos(max(0, a - radius))``. Items first meet a block of references around their nearest pivot, which gives
each a k-th best similarity; then only the blocks with a cell whose bound reaches that similarity are visited. The result
equals the exhaustive one, ties included: a cell whose bound equals the k-th best is still visited, and the smaller
``ord`` wins among equal scores.

Pivots are a bounded sample (the references of smallest salted hash of ``ord``, ``max_pivots`` of them at most), numbered
so that neighbours are similar; every reference is indexed. References in the order of their cells are cut into blocks of
at most ``block_rows``, items in the order of their first block into parts of at most ``part_rows``, and each block and
part is one row, so a cell that holds most references, or draws most items, is many tasks. Parts meet blocks in a product
of their stored partitions, which copies neither through a shuffle: where nothing can be skipped the work is items x
references, but the rows written, and so the disk, grow with items + references. A task holds ``hold_bytes`` of blocks, one
part, and a similarity matrix of bounded size; only the best k of a part's items leave it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.operators.scoring import (
    CELLS,
    DECIMALS,
    MATCHES,
    _as_matches,
    _sorted,
    best_columns,
    dimensions,
)
from labelweave.operators.vectors import to_matrix, to_unit
from labelweave.session import arrow_bytes, materialise

#: Margin on the bound against rounding: scores are compared at ``DECIMALS`` decimals.
MARGIN = 1e-7


@dataclass(frozen=True)
class IndexLimits:
    """References per pivot aimed at, pivots at most, rows of a reference block and of an item part at most, bytes of vectors
    in a block, a part or a batch of item copies, and bytes of blocks that a task holds."""

    cell_rows: int = 256
    max_pivots: int = 4096
    block_rows: int = 16_384
    part_rows: int = 16_384
    copy_bytes: int = 4 << 20
    hold_bytes: int = 64 << 20


def _unit(vectors, dims: int) -> np.ndarray:
    return to_unit(to_matrix(vectors, dims))


def _bounds(unit: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the cosine between each vector and any reference of each cell (-inf for empty cells), and
    each vector's nearest non-empty cell."""
    cos = np.where(np.isnan(radius)[None, :], -np.inf, unit @ pivots.T)
    bound = np.cos(np.maximum(0.0, _angles(cos) - np.nan_to_num(radius, nan=0.0)))
    bound = np.where(np.isnan(radius)[None, :], -np.inf, bound)
    return bound, cos.argmax(axis=1) if len(unit) else np.zeros(0, dtype=np.int64)


def _pivot_matrix(references: DataFrame, n_pivots: int, dims: int) -> np.ndarray:
    sample = references.orderBy(F.xxhash64(F.lit("pivot"), "ord"), "ord").limit(n_pivots).select("vector").toArrow()
    return _unit(sample["vector"], dims)


def _steps(rows: int, n_pivots: int) -> list[slice]:
    """Slices of the rows whose matrix of rows x pivots has ``CELLS // 4`` cells at most: several such matrices are held
    at once."""
    step = max(1, CELLS // 4 // max(1, n_pivots))
    return [slice(start, min(start + step, rows)) for start in range(0, rows, step)]


def _slices(batch: pa.RecordBatch, n_pivots: int):
    for part in _steps(batch.num_rows, n_pivots):
        yield batch.slice(part.start, part.stop - part.start)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _reached(unit: np.ndarray, kth: np.ndarray, pivots: np.ndarray, radius: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """Whether a cell of a block may hold a reference that reaches the item's ``kth``: items x blocks."""
    reach = _bounds(unit, pivots, radius)[0] >= (kth[:, None] - MARGIN)
    return np.stack([reach[:, cells].any(axis=1) for cells in holds], axis=1)


def _copies(batches, item_id: str, pivots: np.ndarray, radius: np.ndarray, dims: int, copies: int):
    """``(item_id, vector, cell)`` for each cell but the nearest whose bound reaches the item's ``kth``, ``copies`` rows a
    batch at most. For callers that deal copies to cells; ``MetricIndex`` sends none, see the head of this module."""
    for batch in batches:
        for part in _slices(batch, len(pivots)):
            bound, nearest = _bounds(_unit(part.column("vector"), dims), pivots, radius)
            kth = part.column("kth").to_numpy(zero_copy_only=False)
            reach = bound >= (kth[:, None] - MARGIN)
            reach[np.arange(len(nearest)), nearest] = False
            rows, cells = np.nonzero(reach)
            for start in range(0, len(rows), copies):
                row, cell = rows[start : start + copies], cells[start : start + copies]
                yield pa.RecordBatch.from_arrays(
                    [part.column(item_id).take(pa.array(row)), part.column("vector").take(pa.array(row)),
                     pa.array(cell.astype(np.int32))],
                    [item_id, "vector", "cell"],
                )


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots, each followed by the most similar one left, so that cells of close numbers are close."""
    order, left = [0], np.ones(len(pivots), dtype=bool)
    while len(order) < len(pivots):
        left[order[-1]] = False
        order.append(int(np.where(left, pivots @ pivots[order[-1]], -np.inf).argmax()))
    return pivots[order]


def _runs(batches, rows: int, key: str | None = None):
    """Tables of at most ``rows`` consecutive rows, of one value of ``key`` each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = [0, batch.num_rows]
        if key and batch.num_rows:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            if held and held[-1].column(key)[0].as_py() != values[0]:
                yield pa.Table.from_batches(held)
                held = []
            cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start and held:
                yield pa.Table.from_batches(held)
                held = []
            while start < end:
                piece = batch.slice(start, min(end - start, rows - sum(b.num_rows for b in held)))
                held.append(piece)
                start += piece.num_rows
                if sum(b.num_rows for b in held) == rows:
                    yield pa.Table.from_batches(held)
                    held = []
    if held:
        yield pa.Table.from_batches(held)


def _packed(*columns: pa.Array | pa.ChunkedArray) -> list[pa.Array]:
    """Each column as the one list of a single row."""
    whole = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in whole]


def _unpacked(column: pa.Array, row: int) -> pa.Array:
    return column.slice(row, 1).flatten()


def _reaching(rows: np.ndarray, references: np.ndarray, floor: np.ndarray, k: int):
    """``(row, column, score)`` of the pairs whose score reaches the row's ``floor``, among them the k best of each row."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    step = max(1, CELLS // 4 // max(1, len(references)))
    for start in range(0, len(rows), step):
        mine, least = rows[start : start + step], floor[start : start + step]
        similarity = mine @ references.T
        cells = np.flatnonzero(similarity >= (least - 10.0**-DECIMALS)[:, None])
        if len(cells) > 4 * k * len(mine):  # equal vectors, or items without k matches so far
            best, score = best_columns(mine, references, k)
            row, column, score = np.repeat(np.arange(len(mine)), best.shape[1]), best.ravel(), score.ravel()
        else:
            row, column = np.divmod(cells, len(references))
            score = np.round(similarity[row, column], DECIMALS)
        kept = score >= least[row]
        found.append((row[kept] + start, column[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


class _Part:
    """A part of the items and the best matches found so far in the blocks it has met: at most k an item."""

    def __init__(self, items: pa.Array, unit: np.ndarray, floor: np.ndarray, reach: np.ndarray, k: int):
        self.items, self.unit, self.floor, self.reach, self.k = items, unit, floor.copy(), reach, k
        self.row, self.score = np.zeros(0, dtype=np.int64), np.zeros(0)
        self.ord, self.id = pa.array([], pa.int64()), pa.array([], pa.string())

    def meet(self, block: int, references: np.ndarray, ord: pa.Array, id: pa.Array) -> None:
        """Match the items that reach the block, whose references are in the order of ``ord``."""
        mine = np.flatnonzero(self.reach[:, block])
        row, column, score = _reaching(self.unit[mine], references, self.floor[mine], self.k)
        if not len(row):
            return
        row, score = np.concatenate([self.row, mine[row]]), np.concatenate([self.score, score])
        ord = pa.concat_arrays([self.ord, ord.take(pa.array(column))])
        id = pa.concat_arrays([self.id, id.take(pa.array(column))])
        order = np.lexsort((ord.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), -score, row))
        start = np.flatnonzero(np.diff(row[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
        kept, last = order[rank < self.k], order[rank == self.k - 1]
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])
        self.row, self.score, self.ord, self.id = row[kept], score[kept], ord.take(pa.array(kept)), id.take(pa.array(kept))

    def matches(self, item_id: str) -> pa.RecordBatch:
        """``(item_id, matches)`` of the items with a match, best first."""
        start = np.flatnonzero(np.diff(self.row, prepend=-1))
        structs = pa.StructArray.from_arrays([pa.array(self.score), self.ord, self.id], ["similarity", "ord", "id"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(self.row)).astype(np.int32)), structs)
        return pa.RecordBatch.from_arrays([self.items.take(pa.array(self.row[start])), lists], [item_id, "matches"])


class MetricIndex:
    """References in blocks of neighbouring cells, the pivots, each cell's radius and the blocks that hold it."""

    def __init__(self, references: DataFrame, dims: int | None = None, limits: IndexLimits = IndexLimits()):
        references = materialise(references.select(
            F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id"), "vector"
        ))
        if dims is None:
            dims = dimensions(references.select("vector").where(F.size("vector") > 0).limit(1).toArrow(), None)
        self.dims, self.limits = dims, limits
        self.n_refs = n_refs = references.count()
        n_pivots = max(1, min(limits.max_pivots, math.ceil(n_refs / limits.cell_rows)))
        self.pivots = _chained(_pivot_matrix(references, n_pivots, dims)) if n_refs else np.zeros((1, dims))
        shared = references.sparkSession.sparkContext.broadcast(self.pivots)

        def assign(batches):
            for batch in batches:
                for part in _slices(batch, len(shared.value)):
                    cos = _unit(part.column("vector"), dims) @ shared.value.T
                    cell = cos.argmax(axis=1)
                    near = cos[np.arange(len(part)), cell]
                    yield part.append_column("cell", pa.array(cell.astype(np.int32))).append_column("cosp", pa.array(near))

        vtype = references.schema["vector"].dataType.simpleString()
        placed = references.mapInArrow(assign, f"ord long, id string, vector {vtype}, cell int, cosp double")
        stats = placed.groupBy("cell").agg(F.min("cosp").alias("cosp")).collect()
        self.radius = np.full(len(self.pivots), np.nan)  # cells without references are never visited
        for row in stats:
            self.radius[row["cell"]] = _angles(np.array([row["cosp"]]))[0]
        fit = limits.copy_bytes // (8 * max(1, dims))
        self.block_rows, self.part_rows = max(1, min(limits.block_rows, fit)), max(1, min(limits.part_rows, fit))
        rows = self.block_rows

        def pack(batches):
            for table in _runs(batches, rows):
                cell = table["cell"].to_numpy()
                table = _sorted(table)
                yield pa.RecordBatch.from_arrays(
                    [*_packed(table["ord"], table["id"], table["vector"]), pa.array([cell.min()]), pa.array([cell.max()])],
                    ["ords", "ids", "vectors", "first", "last"],
                )

        # A quarter more partitions than full blocks: few partitions then exceed one block by a small rest.
        packed = (
            placed.repartitionByRange(max(1, math.ceil(1.25 * n_refs / rows)), "cell", "ord")
            .sortWithinPartitions("cell", "ord")
            .mapInArrow(pack, f"ords array<long>, ids array<string>, vectors array<{vtype}>, first int, last int")
        )
        self.references = materialise(packed.withColumn("block", F.monotonically_increasing_id()))
        ends = sorted(tuple(row) for row in self.references.select("first", "last", "block").collect())
        #: Of each block its key and, per cell, whether it is between the first and the last cell of the block.
        self.keys = np.array([block for _, _, block in ends], dtype=np.int64)
        cells = np.arange(len(self.pivots))
        self.holds = np.array([(first <= cells) & (cells <= last) for first, last, _ in ends]).reshape(-1, len(cells))
        self.blocks = self.holds.sum(axis=0)
        self.sent: list[int] = []  # item rows that met a block, per pass of ``top``

    def bounds(self, vectors) -> np.ndarray:
        return _bounds(_unit(vectors, self.dims), self.pivots, self.radius)[0]

    def _meeting(self, parts: DataFrame, condition) -> DataFrame:
        """Each part with each block that fulfils the condition, by a product of their partitions, without a shuffle."""
        sides = math.ceil(8 * max(1, self.dims) * self.n_refs / self.limits.hold_bytes)
        blocks = self.references.select("block", "ords", "ids", F.col("vectors").alias("references"))
        return parts.join(blocks.coalesce(sides).hint("shuffle_replicate_nl"), condition)

    def top(self, items: DataFrame, k: int, *, item_id: str = "item_id", vector: str = "vector") -> DataFrame:
        """``(item_id, matches)``: the k most similar references of every item, best first, as ``top_references``.

        ``item_id`` must be unique; items without references get an empty array.
        """
        return self._top(materialise(items.select(item_id, F.col(vector).alias("vector"))), k, item_id)

    def _top(self, items: DataFrame, k: int, item_id: str) -> DataFrame:
        """``top`` of stored items ``(item_id, vector)``."""
        if self.n_refs == 0:
            return items.select(item_id, F.array().cast(MATCHES).alias("matches"))
        dims, pivots, radius, keys, holds = self.dims, self.pivots, self.radius, self.keys, self.holds
        vtype = items.schema["vector"].dataType.simpleString()
        ktype = items.schema[item_id].dataType.simpleString()
        n_items = items.count()
        cores = items.sparkSession.sparkContext.defaultParallelism
        rows = max(1, min(self.part_rows, math.ceil(n_items / (2 * cores))))
        lowest, n_blocks = holds.argmax(axis=0), self.blocks
        number = {int(key): i for i, key in enumerate(keys)}

        def home(batches):
            for batch in batches:
                for part in _slices(batch, len(pivots)):
                    _, nearest = _bounds(_unit(part.column("vector"), dims), pivots, radius)
                    block = lowest[nearest] + np.arange(len(nearest)) % n_blocks[nearest]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(item_id), part.column("vector"), pa.array(block.astype(np.int32))],
                        [item_id, "vector", "home"],
                    )

        def pack(batches):
            for table in _runs(batches, rows, "home"):
                block = keys[table["home"][0].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *_packed(table[item_id], table["vector"])], ["home", "items", "vectors"]
                )

        def begin(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    unit = _unit(_unpacked(batch.column("vectors"), at), dims)
                    names = pa.table([_unpacked(batch.column(c), at) for c in ("ords", "ids")], ["ord", "id"])
                    best, score = best_columns(unit, _unit(_unpacked(batch.column("references"), at), dims), k)
                    kth = score[:, -1] if score.shape[1] == k else np.full(len(unit), -np.inf)
                    reach = np.concatenate([
                        _reached(unit[part], kth[part], pivots, radius, holds) for part in _steps(len(unit), len(pivots))
                    ])
                    reach[:, number[batch.column("home")[at].as_py()]] = False
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).slice(at, 1) for c in ("items", "vectors")),
                            *_packed(_as_matches(best, score, names), pa.array(kth)),
                            pa.array([np.packbits(reach).tobytes()], pa.binary()),
                            *_packed(pa.array(keys[reach.any(axis=0)])),
                            pa.array([int(reach.sum())]),
                        ],
                        ["items", "vectors", "matches", "kth", "reach", "blocks", "sent"],
                    )

        def further(batches):
            part, now = None, None
            for batch in batches:
                for at in range(batch.num_rows):
                    if part is None or now != batch.column("part")[at].as_py():
                        if part is not None:
                            yield part.matches(item_id)
                        now = batch.column("part")[at].as_py()
                        items, kth = (_unpacked(batch.column(c), at) for c in ("items", "kth"))
                        bits = np.frombuffer(batch.column("reach")[at].as_py(), dtype=np.uint8)
                        reach = np.unpackbits(bits, count=len(items) * len(keys)).reshape(len(items), len(keys)).astype(bool)
                        unit = _unit(_unpacked(batch.column("vectors"), at), dims)
                        part = _Part(items, unit, kth.to_numpy(zero_copy_only=False), reach, k)
                    part.meet(
                        number[batch.column("block")[at].as_py()],
                        _unit(_unpacked(batch.column("references"), at), dims),
                        *(_unpacked(batch.column(c), at) for c in ("ords", "ids")),
                    )
            if part is not None:
                yield part.matches(item_id)

        parts = (
            items.mapInArrow(home, f"{item_id} {ktype}, vector {vtype}, home int")
            .repartitionByRange(max(1, math.ceil(n_items / rows)), "home", item_id)
            .sortWithinPartitions("home")
            .mapInArrow(pack, f"home long, items array<{ktype}>, vectors array<{vtype}>")
        )
        self.sent.append(n_items)
        first = self._meeting(parts, F.col("home") == F.col("block")).mapInArrow(
            begin,
            f"items array<{ktype}>, vectors array<{vtype}>, matches array<{MATCHES}>, kth array<double>, reach binary, "
            "blocks array<long>, sent long",
        )
        with arrow_bytes(items.sparkSession, self.limits.copy_bytes):  # a part with a block is a large row
            first = materialise(first.withColumn("part", F.monotonically_increasing_id()))
        self.sent.append(first.agg(F.sum("sent")).first()[0] or 0)
        rest = self._meeting(
            first.select("part", "items", "vectors", "kth", "reach", "blocks"), F.array_contains("blocks", F.col("block"))
        ).mapInArrow(further, f"{item_id} {ktype}, matches {MATCHES}")
        with arrow_bytes(items.sparkSession, self.limits.copy_bytes):
            rest = materialise(rest)
        start = first.select(F.explode(F.arrays_zip("items", "matches")).alias("_first")).select(
            F.col("_first.items").alias(item_id), F.col("_first.matches").alias("matches")
        )
        return _merged(start.unionByName(rest), k, item_id)


def _merged(found: DataFrame, k: int, item_id: str) -> DataFrame:
    """The best k of all matches found per item: higher similarity first, then smaller ord."""
    order = Window.partitionBy(item_id).orderBy(F.desc("_match.similarity"), "_match.ord")
    ranked = (
        found.select(item_id, F.explode("matches").alias("_match"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
    )
    kept = F.sort_array(F.collect_list(F.struct("_rank", "_match")))
    return ranked.groupBy(item_id).agg(F.transform(kept, lambda r: r["_match"]).alias("matches"))


def indexed_matches(
    items: DataFrame, references: DataFrame, k: int, *, item_id: str = "item_id", vector: str = "vector",
    dims: int | None = None, limits: IndexLimits = IndexLimits(),
) -> DataFrame:
    """Items with their k most similar references by the index; equal to ``top_references`` with unit vectors."""
    from labelweave.operators.scoring import row_keyed

    keyed = row_keyed(items, "_indexed_row")
    stored = keyed.select("_indexed_row", F.col(vector).alias("vector"))
    matched = MetricIndex(references, dims, limits)._top(stored, k, "_indexed_row")
    return keyed.join(matched, "_indexed_row").drop("_indexed_row")
