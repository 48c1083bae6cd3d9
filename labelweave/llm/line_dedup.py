"""Incremental, reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. The state is a table of
reference counts: for every key, by its 128-bit hash pair, the number of documents that hold it, grouped in Spark
(a document's copies of a line are combined before the shuffle, so a key found in a third of all documents is one
partial count per task).
Keys held by at least ``min_docs`` documents are frequent, and every line with a frequent key is dropped.

Frequent keys are also kept in cuckoo filters (buckets of four 16-bit fingerprints, two buckets a key, partial-key
cuckoo hashing), one per shard of the 64-bit key hash; the number of shards follows from a count of frequent keys so
that no shard holds more than ``SHARD_KEYS``. A filter answers "maybe frequent" in the scan, and only those lines
meet the exact table by a join, so the result is exact: a false positive is sent to the join and kept there.
Unlike Bloom filters, cuckoo filters delete: when documents are removed, their keys' counts go down, keys that fall
below the bound leave their shard's filter, and the state equals that of never having added them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.shared import lower_az, stored

#: Fixed values of the contract: documents that make a key frequent, and the least length of a key.
MIN_DOCS, MIN_KEY_CHARS = 10, 1
#: Keys a shard's filter holds at most, slots per bucket, the load a new filter is sized for, and kicks per insert.
SHARD_KEYS, SLOTS, LOAD, KICKS = 1 << 20, 4, 0.84, 500
#: Filters are broadcast up to this many bytes in all; beyond it every line goes to the exact join, same result.
BROADCAST_FILTER_BYTES = 64 << 20

SPACE_CHARS = " \t\n\x0b\x0c\r"
FILTER = "shard int, n_buckets long, slots binary, overflow boolean"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at either end, A-Z lower-cased; a trim, not a pattern."""
    return lower_az(F.btrim(line, F.lit(SPACE_CHARS)))


def key_hashes(key: Column) -> Column:
    """The 128-bit hash pair (h, g) by which keys are counted and looked up."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit("line"), key).alias("g"))


def doc_lines(docs: DataFrame) -> DataFrame:
    """(_row, pos, h, g) of every line whose key has ``MIN_KEY_CHARS`` code points or more; h and g hash the key."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    exploded = docs.select("_row", F.posexplode(keys).alias("pos", "key"))
    return exploded.filter(F.length("key") >= MIN_KEY_CHARS).select("_row", "pos", key_hashes(F.col("key")).alias("k")).select(
        "_row", "pos", "k.h", "k.g"
    )


def key_counts(docs: DataFrame, sign: int = 1) -> DataFrame:
    """(h, g, n_docs): documents that hold each key of at least ``MIN_KEY_CHARS`` code points, times ``sign``.

    Keys are counted by their 128-bit hash pair, so 16 bytes a key are shuffled, and a document's keys are made
    distinct inside its row before that, so no shuffle is needed to count each document once.
    """
    keys = F.filter(
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key), lambda k: F.length(k) >= MIN_KEY_CHARS
    )
    held = docs.select(F.explode(F.array_distinct(F.transform(keys, key_hashes))).alias("k"))
    return held.groupBy("k.h", "k.g").agg((F.count(F.lit(1)) * sign).alias("n_docs"))


# --- cuckoo filters, on arrays in tasks ---


def _fingerprint(h: np.ndarray) -> np.ndarray:
    fp = ((h.astype(np.uint64) >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
    return np.where(fp == 0, np.uint16(1), fp)


def _buckets(h: np.ndarray, fp: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(n_buckets - 1)
    first = h.astype(np.uint64) & mask
    second = (first ^ (fp.astype(np.uint64) * np.uint64(0x5BD1E995))) & mask
    return first.astype(np.int64), second.astype(np.int64)


def _alternate(bucket: int, fp: int, n_buckets: int) -> int:
    return (bucket ^ (fp * 0x5BD1E995)) & (n_buckets - 1)


def new_filter(n_keys: int) -> np.ndarray:
    n_buckets = 1 << max(1, math.ceil(math.log2(max(1, n_keys) / (SLOTS * LOAD))))
    return np.zeros((n_buckets, SLOTS), dtype=np.uint16)


def insert(table: np.ndarray, hashes: np.ndarray, seed: int = 0) -> bool:
    """Add keys by their hashes; False if a key found no place after ``KICKS`` displacements."""
    n_buckets = len(table)
    rng = np.random.default_rng(seed)
    fps = _fingerprint(hashes)
    firsts, seconds = _buckets(hashes, fps, n_buckets)
    for fp, b1, b2 in zip(fps.tolist(), firsts.tolist(), seconds.tolist()):
        placed = False
        for b in (b1, b2):
            free = np.flatnonzero(table[b] == 0)
            if len(free):
                table[b, free[0]] = fp
                placed = True
                break
        if placed:
            continue
        b = b1 if rng.random() < 0.5 else b2
        for _ in range(KICKS):
            slot = int(rng.integers(SLOTS))
            fp, table[b, slot] = int(table[b, slot]), fp
            b = _alternate(b, fp, n_buckets)
            free = np.flatnonzero(table[b] == 0)
            if len(free):
                table[b, free[0]] = fp
                placed = True
                break
        if not placed:
            return False
    return True


def delete(table: np.ndarray, hashes: np.ndarray) -> None:
    """Remove one copy of each key's fingerprint from one of its two buckets; absent keys change nothing."""
    fps = _fingerprint(hashes)
    firsts, seconds = _buckets(hashes, fps, len(table))
    for fp, b1, b2 in zip(fps.tolist(), firsts.tolist(), seconds.tolist()):
        for b in (b1, b2):
            hit = np.flatnonzero(table[b] == fp)
            if len(hit):
                table[b, hit[0]] = 0
                break


def contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    fps = _fingerprint(hashes)
    firsts, seconds = _buckets(hashes, fps, len(table))
    return (table[firsts] == fps[:, None]).any(axis=1) | (table[seconds] == fps[:, None]).any(axis=1)


def shard_of(h: Column, n_shards: int) -> Column:
    """Shards by the top bits of the hash; fingerprints and buckets use the low 48."""
    return F.pmod(F.shiftrightunsigned(h, 48), F.lit(n_shards)).cast("int")


# --- state ---


@dataclass(frozen=True)
class LineDedup:
    """Reference counts (h, g, n_docs) as a stored table, and a cuckoo filter per shard as another."""

    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int = MIN_DOCS

    @staticmethod
    def build(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineDedup:
        """State of the documents' lines. ``docs`` needs ``text``; other columns are ignored."""
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), "text")
        counts = stored(key_counts(rows), "line-counts")
        n_frequent = counts.filter(F.col("n_docs") >= min_docs).count()
        n_shards = max(1, math.ceil(n_frequent / SHARD_KEYS))
        frequent = counts.filter(F.col("n_docs") >= min_docs).select(shard_of(F.col("h"), n_shards).alias("shard"), "h")
        filters = stored(frequent.groupBy("shard").applyInPandas(_build_shard, FILTER), "line-filters")
        state = LineDedup(counts, filters, n_shards, min_docs)
        return state._rebuilt_overflows()

    def add(self, docs: DataFrame) -> LineDedup:
        """The state with ``docs`` added: counts go up, keys that reach the bound enter their filters."""
        return self._changed(docs, 1)

    def remove(self, docs: DataFrame) -> LineDedup:
        """The state with ``docs`` (added before) taken out: counts go down, keys below the bound leave the filters."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineDedup:
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), "text")
        delta = key_counts(rows, sign).withColumnRenamed("n_docs", "delta")
        old = self.counts.withColumnRenamed("n_docs", "before")
        joined = old.join(delta, ["h", "g"], "full").select(
            "h", "g", F.coalesce("before", F.lit(0)).alias("before"),
            (F.coalesce("before", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("n_docs"),
        )
        joined = stored(joined, "line-counts")
        counts = stored(joined.filter("n_docs > 0").select("h", "g", "n_docs"), "line-counts")
        bound = self.min_docs
        entering = (F.col("before") < bound) & (F.col("n_docs") >= bound)
        leaving = (F.col("before") >= bound) & (F.col("n_docs") < bound)
        changes = joined.filter(entering | leaving).select(
            shard_of(F.col("h"), self.n_shards).alias("shard"), "h", entering.alias("enter")
        )
        filters = stored(
            self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_update_shard, FILTER),
            "line-filters",
        )
        return LineDedup(counts, filters, self.n_shards, bound)._rebuilt_overflows()

    def _rebuilt_overflows(self) -> LineDedup:
        """Shards whose filter overflowed are built again from the exact counts, with twice the buckets."""
        full = self.filters.filter("overflow").select("shard", "n_buckets")
        if full.isEmpty():
            return self
        keys = self.frequent().select(shard_of(F.col("h"), self.n_shards).alias("shard"), "h").join(full, "shard")
        rebuilt = keys.groupBy("shard").applyInPandas(_build_shard, FILTER)
        filters = stored(self.filters.filter("not overflow").unionByName(rebuilt), "line-filters")
        return LineDedup(self.counts, filters, self.n_shards, self.min_docs)._rebuilt_overflows()

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.min_docs).select("h", "g")

    def maybe_frequent(self, lines: DataFrame) -> DataFrame:
        """Lines whose key the filters may hold; with filters over the broadcast bound, all lines."""
        size = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        if size > BROADCAST_FILTER_BYTES:
            return lines
        shards = {
            r["shard"]: (r["n_buckets"], bytes(r["slots"])) for r in self.filters.select("shard", "n_buckets", "slots").collect()
        }
        shared = lines.sparkSession.sparkContext.broadcast(shards)
        n_shards = self.n_shards
        schema = lines.schema

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = {
                s: np.frombuffer(raw, dtype=np.uint16).reshape(n, SLOTS) for s, (n, raw) in shared.value.items()
            }
            for batch in batches:
                h = batch["h"].to_numpy(dtype=np.int64)
                shard = ((h.view(np.uint64) >> np.uint64(48)) % np.uint64(n_shards)).astype(np.int64)
                hit = np.zeros(len(batch), dtype=bool)
                for s, table in tables.items():
                    at = np.flatnonzero(shard == s)
                    if len(at):
                        hit[at] = contains(table, h[at].view(np.uint64))
                yield batch[hit]

        return lines.mapInPandas(probe, schema)

    def dropped(self, lines: DataFrame) -> DataFrame:
        """(_row, pos) of lines with a frequent key: the filter first, then the join on the hash pair."""
        candidates = self.maybe_frequent(lines.select("_row", "pos", "h", "g"))
        return candidates.join(self.frequent(), ["h", "g"], "left_semi").select("_row", "pos")


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    shard = int(keys["shard"].iloc[0])
    hashes = keys["h"].to_numpy(dtype=np.int64).view(np.uint64)
    n_keys = len(hashes)
    if "n_buckets" in keys:  # a rebuild after an overflow: twice the buckets it had
        n_keys = max(n_keys, int(keys["n_buckets"].iloc[0]) * SLOTS * 2 * LOAD)
    table = new_filter(int(n_keys))
    while not insert(table, hashes, seed=shard):
        table = np.zeros((len(table) * 2, SLOTS), dtype=np.uint16)
    return pd.DataFrame([{"shard": shard, "n_buckets": len(table), "slots": table.tobytes(), "overflow": False}])


def _update_shard(filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    if changes.empty:
        return filters
    shard = int(changes["shard"].iloc[0])
    if filters.empty:
        table, n_buckets = new_filter(int(changes["enter"].sum())), None
    else:
        n_buckets = int(filters["n_buckets"].iloc[0])
        table = np.frombuffer(filters["slots"].iloc[0], dtype=np.uint16).reshape(n_buckets, SLOTS).copy()
    hashes = changes["h"].to_numpy(dtype=np.int64).view(np.uint64)
    enter = changes["enter"].to_numpy(dtype=bool)
    delete(table, hashes[~enter])
    ok = insert(table, hashes[enter], seed=shard)
    return pd.DataFrame([{"shard": shard, "n_buckets": len(table), "slots": table.tobytes(), "overflow": not ok}])


def deduplicate(documents: DataFrame, state: LineDedup | None = None) -> DataFrame:
    """Per document row: doc_id, n_lines, n_dropped, kept_sha256 (of the kept lines joined by ``\\n``), kept_text.

    ``state`` defaults to the state built from ``documents`` themselves; the documents are read again, not copied.
    Keys are told apart by their 128-bit hash pair: two keys that share one would be counted together, at odds of
    about n^2 / 2^129 for n distinct keys. Lines split at ``\\n`` only; a null or
    empty text is one empty line, which is kept. Repeated rows count as separate documents; a null doc_id stays
    null. Columns other than doc_id and text are ignored.
    """
    docs = documents.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    state = state or LineDedup.build(docs)
    dropped = state.dropped(doc_lines(docs)).groupBy("_row").agg(F.collect_list("pos").alias("gone"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n")
    return docs.join(dropped, "_row", "left").select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
        kept.alias("kept_text"),
    )
