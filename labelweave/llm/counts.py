"""Tables of counts with a fixed number of cells, summed over all tasks in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a piece.
PIECE = 1 << 12
COUNTS = "piece int, counts binary"
_SCHEMA = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])


def _batch(pieces: dict[int, np.ndarray]) -> pa.RecordBatch:
    blobs = [v.astype(np.int64).tobytes() for v in pieces.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array(blobs, pa.binary())], schema=_SCHEMA)


def pieces_of(total: np.ndarray) -> pa.RecordBatch:
    """Rows of the pieces that hold a count."""
    pieces = total.reshape(-1, PIECE)
    return _batch({int(i): pieces[i] for i in np.flatnonzero(pieces.any(axis=1))})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the pieces of a task; memory is that of the whole table at most."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            cells = np.frombuffer(counts.as_py(), np.int64)
            totals[piece] = totals[piece] + cells if piece in totals else cells
    yield _batch(totals)


def collected(rows: DataFrame, cells: int) -> np.ndarray:
    """The whole table of ``cells`` cells on the driver, from rows (piece, counts) of all tasks."""
    total = np.zeros(cells, np.int64)
    for row in rows.select("piece", "counts").repartition("piece").mapInArrow(_summed, COUNTS).collect():
        total[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] += np.frombuffer(row["counts"], np.int64)
    return total
