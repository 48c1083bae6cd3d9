"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: a shard holds the postings of a batch of documents, one row per shard, written to the shared
folder. A posting is a token's place in the shard, with a gap between documents that no phrase bridges. A search takes
every window of the test items to every shard, intersects the offset-adjusted lists of its terms from the rarest on,
and returns exact phrase and proximity matches. No text, posting or match is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.shared import stored

#: Distinct documents are this many places apart at least, so it bounds ``near``.
GAP = 1024
#: Test words taken to the shards at a time; more of them are searched in further passes over the index.
PASS_WORDS = 2_000_000
#: ASCII letters fold to lower case, other ASCII but digits separates words, everything above ASCII belongs to words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
INDEX = (
    "doc_ids array<bigint>, starts array<int>, n_words array<int>, terms array<string>, "
    "term_starts array<int>, postings array<int>"
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def _shards(terms: dict[bytes, int], names: list[str]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, schema = terms.get, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, codes, places, starts, at = [], [], [], [], 0
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = np.fromiter((code(w, -1) for w in words), np.int32, len(words))
                here = np.flatnonzero(found >= 0)
                codes.append(found[here])
                places.append((here + at).astype(np.int32))
                starts.append(at)
                lengths.append(len(words))
                at += len(words) + GAP
                if at > 2**31 - 1:
                    raise ValueError("a shard holds more than 2^31 words: lower spark.sql.execution.arrow.maxBytesPerBatch")
            codes, places = np.concatenate(codes), np.concatenate(places)
            order = np.argsort(codes, kind="stable")
            held, first = np.unique(codes[order], return_index=True)
            row = [
                batch.column(0).to_pylist(), np.array(starts, np.int32), np.array(lengths, np.int32),
                [names[c] for c in held], np.append(first, len(order)).astype(np.int32), places[order],
            ]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            labels = [part.split(" ")[0] for part in INDEX.split(", ")]
            schema = schema or pa.schema([(n, pa.list_(k)) for n, k in zip(labels, kinds)])
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in zip(row, kinds)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return build


def build_index(docs: DataFrame, terms: Iterable[bytes]) -> DataFrame:
    """Postings of ``terms`` in ``docs`` (doc_id, text), a row per shard of documents.

    Postings of words that no test item holds would never be read, so they aren't stored.
    """
    code = {w: i for i, w in enumerate(terms)}
    names = [w.decode() for w in code]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_shards(code, names), INDEX)


@dataclass
class Windows:
    """Windows of test items as rows of term codes; short items have their own width."""

    terms: list[str]
    codes: np.ndarray  # windows x width, -1 behind the end of a short one
    items: np.ndarray  # number of the item of each window
    widths: np.ndarray


def windows_of(items: list[tuple[int, list[bytes]]], width: int) -> Windows:
    """All windows of ``width`` consecutive words; an item of fewer words, but not none, is one window."""
    code: dict[bytes, int] = {}
    rows, owner = [], []
    for number, words in items:
        numbers = [code.setdefault(w, len(code)) for w in words]
        for i in range(max(1, len(numbers) - width + 1) if numbers else 0):
            rows.append(numbers[i : i + width] + [-1] * (width - len(numbers)))
            owner.append(number)
    codes = np.array(rows, np.int64).reshape(len(rows), width)
    return Windows([w.decode() for w in code], codes, np.array(owner, np.int64), (codes >= 0).sum(axis=1))


def _within(held: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Is there an entry of the sorted list between each low and high, both included?"""
    at = np.searchsorted(held, low)
    return (at < len(held)) & (held[np.minimum(at, len(held) - 1)] <= high)


def search_shard(row: dict, windows: Windows, near: int) -> Iterator[tuple]:
    """(doc_id, n_words, hits as start-end pairs, items with exact windows) of every document, by the shard's postings."""
    slot = {term: i for i, term in enumerate(row["terms"])}
    place = np.array([slot.get(t, -1) for t in windows.terms] + [-1], np.int64)  # the last stands for no word
    bounds, postings = np.asarray(row["term_starts"]), np.asarray(row["postings"], dtype=np.int64)
    starts, lengths = np.asarray(row["starts"], dtype=np.int64), np.asarray(row["n_words"], dtype=np.int64)
    there = place[windows.codes]
    alive = np.flatnonzero(((there >= 0) | (windows.codes < 0)).all(axis=1))
    hits: dict[int, list] = {}
    found: dict[int, set] = {}
    close: dict[int, set] = {}
    for w in alive:
        lists = [postings[bounds[t] : bounds[t + 1]] for t in there[w][: windows.widths[w]]]
        order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
        exact, nearby = lists[order[0]] - order[0], lists[order[0]]
        for i in order[1:]:
            exact = exact[_within(lists[i], exact + i, exact + i)]
            nearby = nearby[_within(lists[i], nearby - near, nearby + near)] if len(nearby) else nearby
            if not len(exact) and not len(nearby):
                break
        for start in exact:
            d = int(np.searchsorted(starts, start, "right")) - 1
            hits.setdefault(d, []).append((int(start - starts[d]), int(start - starts[d] + windows.widths[w])))
            found.setdefault(d, set()).add(int(windows.items[w]))
        for at in nearby:
            close.setdefault(int(np.searchsorted(starts, at, "right")) - 1, set()).add(int(windows.items[w]))
    for d, doc_id in enumerate(row["doc_ids"]):
        yield doc_id, int(lengths[d]), merged(hits.get(d, [])), sorted(found.get(d, ())), sorted(close.get(d, ()))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


FOUND = "doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<bigint>, near_items array<bigint>"


def search(index: DataFrame, windows: Windows, near: int) -> DataFrame:
    """Matches of the windows in every document of the index, a row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                rows = [
                    (doc, n, [{"start": a, "end": b} for a, b in spans], items, close)
                    for doc, n, spans, items, close in search_shard(row, windows, near)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "n_words", "spans", "items", "near_items"]).astype(
                    {"doc_id": "Int64"}
                )

    return index.mapInPandas(run, FOUND)


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Test items in portions of bounded size, read in the order of a written table."""
    portion, size = [], 0
    for row in benchmark.toLocalIterator():
        words = words_of(row["text"])
        if portion and size + len(words) > PASS_WORDS:
            yield portion
            portion, size = [], 0
        portion.append((row["item_id"], words))
        size += len(words)
    yield portion


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = 10, near: int = 20) -> DataFrame:
    """Where windows of test items occur in documents.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Returns doc_id, n_words, spans (start and end of every
    run of words inside exact matches), items (item_ids with exact matches), near_items (item_ids with a window whose
    words all lie within ``near`` words of the rarest of them). One row per row of ``docs``. Null and empty texts have no
    words; null ids pass through; items without words or id match nothing; rows that repeat an id, or have none, are
    judged each for itself however many passes the test items need. The rows are keyed by a number of their own, from
    the scan of ``docs``, which every pass reads again.
    """
    if near >= GAP or width > GAP:
        raise ValueError(f"windows and distances are limited to {GAP} words")
    items = stored(benchmark.filter("item_id is not null").select("item_id", "text").distinct(), "items")
    # Every row gets a key of its own, so rows that repeat or lack an id stay apart in every pass and in the merge.
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").alias("_doc_id"), "text")
    keyed = rows.select(F.col("_row").alias("doc_id"), "text")
    results = []
    for portion in _passes(items):
        windows = windows_of(portion, width)
        index = stored(build_index(keyed, [t.encode() for t in windows.terms]), "index")
        results.append(search(index, windows, near))
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    if len(results) > 1:
        every = _merged(every)
    own = rows.select("_row", "_doc_id")
    return every.withColumnRenamed("doc_id", "_row").join(own, "_row").select(
        F.col("_doc_id").alias("doc_id"), *[c for c in every.columns if c != "doc_id"]
    )


def _merged(every: DataFrame) -> DataFrame:
    """Findings of several passes per row key, as one."""
    joined = every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    return joined.withColumn("spans", joined_spans(F.col("spans")))


def joined_spans(spans):
    """Union of sorted spans that may overlap, in SQL functions."""
    last = lambda acc: F.element_at(acc, -1)
    grow = lambda acc, s: F.concat(
        F.slice(acc, 1, F.size(acc) - 1),
        F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))),
    )
    return F.aggregate(
        F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))),
        F.slice(spans, 1, 1),
        lambda acc, s: F.when(s["start"] <= last(acc)["end"], grow(acc, s)).otherwise(F.concat(acc, F.array(s))),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, near: int = 20) -> DataFrame:
    """Digest of ``find_passages``: doc_id, n_words, n_hit (words inside exact matches), n_items, items_sha256 (of the
    item_ids sorted as strings and joined by commas), contaminated (n_hit > 0), n_near_items."""
    found = find_passages(docs, benchmark, width, near)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less every row whose doc_id has a test passage. Rows without id can't be matched and stay."""
    bad = contamination(docs, benchmark).filter("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(stored(bad, "contaminated"), "doc_id", "left_anti").select(docs.columns)
