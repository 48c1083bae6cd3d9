"""Small helpers of the operators: tables, scratch folders and column expressions."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, and the optimizer knows the size."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row: marked for broadcast if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand at most ``rows`` rows at a time to Python, so neither side holds many texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of a key as text, modulo ``mod``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_rows(df: DataFrame, keys: Iterable[str], limit: int, seed: str) -> DataFrame:
    """A bounded sample: the rows of the smallest salted hashes of their keys, equal in every run."""
    keys = list(keys)
    order = F.xxhash64(F.lit(seed), *keys)
    return df.orderBy(order, *keys).limit(limit)


def plain_broadcast(spark: SparkSession, model: object):
    """The fields of ``model`` broadcast as plain values (arrays, lists, numbers), not as an object of this package,
    so that executors need no copy of the package to read them; ``rebuilt`` makes the object again in a task."""
    return spark.sparkContext.broadcast(dict(vars(model)))


def rebuilt(kind: type, fields: dict) -> object:
    """An object of ``kind`` with the given fields, without running its constructor again."""
    made = object.__new__(kind)
    made.__dict__.update(fields)
    return made


def in_worker(key: object, make: Callable[[], object]) -> object:
    """``make()`` once per Python process and key. The cache lives in a module of the process, not of this package:
    functions of this package reach the workers by value, so a cache of their own would not outlive a task."""
    store = sys.modules.setdefault("_labelweave_worker_cache", types.ModuleType("_labelweave_worker_cache"))
    entries = store.__dict__.setdefault("entries", {})
    if key not in entries:
        entries[key] = make()
    return entries[key]
