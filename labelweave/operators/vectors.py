"""Vectors of texts: hashed term counts, or any encoder with an ``encode(list)`` method."""

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of the hashed vectors, those of the sentence model they stand in for.
DIMS = 384


def hash_buckets(words: Column, dims: int = DIMS) -> Column:
    """Bucket of every word occurrence: first 8 hex digits of its MD5, modulo ``dims`` (D3).

    This array of integers is the compact form of the term-count vector; the scoring operators read it as counts.
    """
    return F.transform(
        words,
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"),
    )


def term_counts(df: DataFrame, key: str, words: Column, dims: int = DIMS) -> DataFrame:
    """Term-count vectors in long form ``(key, bucket, n)`` (D3); counts are combined before the shuffle."""
    return (
        df.select(key, F.explode(hash_buckets(words, dims)).alias("bucket"))
        .groupBy(key, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def to_matrix(vectors, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix. Integer lists are bucket occurrences, others dense vectors; null is zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    n = len(vectors)
    if pa.types.is_integer(vectors.type.value_type):
        if len(values) and not (values.min() >= 0 and values.max() < dims):
            raise ValueError(f"buckets must be from 0 to {dims - 1}")
        cells = np.repeat(np.arange(n), sizes) * dims + values
        return np.bincount(cells, minlength=n * dims).reshape(n, dims).astype(np.float64)
    filled = sizes > 0
    if not (sizes[filled] == dims).all():
        raise ValueError(f"vectors must have {dims} dimensions")
    matrix = np.zeros((n, dims))
    matrix[filled] = values.reshape(-1, dims)
    return matrix


def to_unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero, so its cosine with anything is 0."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def to_lists(matrix: np.ndarray) -> pa.Array:
    """Matrix as a list column."""
    n, dims = matrix.shape
    offsets = pa.array(np.arange(0, n * dims + 1, dims, dtype=np.int32)) if dims else pa.array([0] * (n + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))


def unit_vector(vector: Column, dims: int) -> Column:
    """Dense vector of length 1 of a vector column in either form."""

    @F.arrow_udf("array<double>")
    def scale(vectors: pa.Array) -> pa.Array:
        return to_lists(to_unit(to_matrix(vectors, dims)))

    return scale(vector)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors of the same row, 0 when either is zero."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def _encoder(digest: str, make_encoder: Callable[[], object]) -> object:
    """The encoder that this process made last, if its factory has this digest, else a new one.

    The package travels to workers by value, so its module state is new in every task; ``sys`` is the worker's own.
    """
    made = vars(sys).setdefault("_labelweave_encoder", {})
    if digest not in made:
        made.clear()
        made[digest] = make_encoder()
    return made[digest]


def encode(text: Column, make_encoder: Callable[[], object], batch_size: int = 256) -> Column:
    """Vectors from an encoder.

    ``make_encoder`` runs once per Python worker, whose later tasks use the same object, and returns an object whose
    ``encode(list_of_texts)`` gives one vector per text; texts arrive in Arrow batches and are handed on ``batch_size``
    at a time.
    """
    digest = hashlib.sha256(cloudpickle.dumps(make_encoder)).hexdigest()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(digest, make_encoder)
        for batch in batches:
            texts = [text or "" for text in batch.to_pylist()]
            parts = [
                np.asarray(encoder.encode(texts[i : i + batch_size]), dtype=np.float32)
                for i in range(0, len(texts), batch_size)
            ]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)
            yield to_lists(matrix).cast(pa.list_(pa.float32()))

    # Marked so that no rewrite encodes a text twice.
    return run.asNondeterministic()(text)
