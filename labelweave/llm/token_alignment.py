"""Alignment of two tokenizers' tokens by interval coalescing, and corpus-wide counts of the linked id pairs.

Each text is encoded twice: by a byte-level BPE (A, given space + text) and by a SentencePiece model (B, which adds
the space itself). Both tile the same bytes. All tokens of both are sorted by start (``np.lexsort``), the running
maximum of their ends is taken with ``np.maximum.accumulate``, and a group breaks where a start reaches the running
maximum of the ends before it: there no token of either side straddles the offset. Within a group every A token is
linked to every B token. A document hands on only its distinct (A id, B id) pairs with their multiplicity, so copies
are combined before the shuffle; how many documents hold a pair, and the largest such count of each A id, come from
two aggregations in Spark and meet the documents' pairs again by a join.
"""

from __future__ import annotations

import hashlib
import json
from operator import itemgetter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.bpe_count import byte_letters
from labelweave.llm.shared import in_worker, small

#: The word-start mark of SentencePiece pieces and the form of its byte pieces.
PIECE_SPACE = "▁"
BYTE_PIECE = ("<0x", ">")

TOKENS = (
    "_row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pa array<int>, pb array<int>, pm array<long>"
)
COLUMNS = [part.split(" ")[0] for part in TOKENS.split(", ")]
#: Texts are encoded in pieces of at most this many characters (or one longer text alone), so a task's memory is
#: bounded by the piece and not by the Arrow batch.
CHUNK_CHARS, CHUNK_TEXTS = 1 << 18, 64


def _models(a_path: str, b_path: str):
    return in_worker(("alignment", a_path, b_path), lambda: _load(a_path, b_path))


def _load(a_path: str, b_path: str):
    """A's encoder and B's processor with the bytes of every id and the texts of ids in digests, made once per Python worker, one thread each.

    A's vocabulary and merge ranks come from its JSON file: the byte-level letters of each entry give its bytes, its id
    is its rank, and text is split by the vocabulary's pattern before merging. The merges are done by tiktoken's
    engine, which gives the same ids as the tokenizers library on this kind of vocabulary (held to it in the tests)
    in a quarter of the time. Added special tokens are left out, so their strings in a text are plain text.
    """
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(a_path, encoding="utf-8") as file:
        model = json.load(file)
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    vocab = model["model"]["vocab"]
    special = {t["id"] for t in model.get("added_tokens", ())}
    a_bytes = [b""] * (max([*vocab.values(), *special], default=-1) + 1)
    for token, i in vocab.items():
        a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    ranks = {a_bytes[i]: i for i in vocab.values() if i not in special}
    a = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_byte(i) and piece.startswith(BYTE_PIECE[0]) and piece.endswith(BYTE_PIECE[1]):
            b_bytes.append(bytes([int(piece[3:-1], 16)]))
        elif b.is_control(i) or b.is_unknown(i):
            b_bytes.append(b"")
        else:
            b_bytes.append(piece.replace(PIECE_SPACE, " ").encode())
    a_len = np.array([len(x) for x in a_bytes], dtype=np.int64)
    b_len = np.array([len(x) for x in b_bytes], dtype=np.int64)
    return a, b, a_bytes, b_bytes, a_len, b_len, digest_table(max(len(a_bytes), len(b_bytes)))


def groups_of(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers of A's and B's tokens by interval coalescing; both must tile the same bytes."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    starts = np.concatenate([a_end - a_len, b_end - b_len])
    ends = np.concatenate([a_end, b_end])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a_len)], group[len(a_len) :], int(breaks.sum())


NO_IDS = np.zeros(0, dtype=np.int32)


def _within(counts: np.ndarray) -> np.ndarray:
    """For blocks of the given sizes, the position inside its block of every element."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _joined(table: list[bytes], ids: list[int]) -> bytes:
    return table[ids[0]] if len(ids) == 1 else b"".join(itemgetter(*ids)(table))


def digest_table(n_ids: int) -> list[bytes]:
    """Every id in decimal behind ``;`` (first of its group), ``,`` and ``|`` (B's first behind A's), in that order."""
    names = [b"%d" % i for i in range(n_ids)]
    return [mark + name for mark in (b";", b",", b"|") for name in names]


def digest(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, counts: tuple, table: list[bytes]) -> str:
    """sha256 of the groups in order, A's ids before B's. A token's place is its number on its side, and how many
    tokens of the other side come in groups before: its own group included if it is B's."""
    a_count, b_count = counts
    width = len(table) // 3
    a_first, b_first = np.ones(len(a_ids), bool), np.ones(len(b_ids), bool)
    a_first[1:], b_first[1:] = a_group[1:] != a_group[:-1], b_group[1:] != b_group[:-1]
    b_mark = np.where(b_first, np.where(a_count > 0, 2, 0)[b_group], 1)
    items = np.empty(len(a_ids) + len(b_ids), np.int64)
    items[np.arange(len(a_ids)) + (np.cumsum(b_count) - b_count)[a_group]] = a_ids + np.where(a_first, 0, width)
    items[np.arange(len(b_ids)) + np.cumsum(a_count)[b_group]] = b_ids + b_mark * width
    return hashlib.sha256(_joined(table, items.tolist())[1:]).hexdigest()


def linked_pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, counts: tuple) -> tuple:
    """Distinct linked (A id, B id) pairs, as one number each in order, with their multiplicity.

    Every A token meets every B token of its group: A repeated by the B count, B's block once per A token.
    """
    b_count = counts[1]
    repeats = b_count[a_group]
    b_at = np.repeat((np.cumsum(b_count) - b_count)[a_group], repeats) + _within(repeats)
    keys = np.sort((np.repeat(a_ids, repeats) << 32) + b_ids[b_at])
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.diff(starts, append=len(keys))


def align_ids(text: str | None, a_ids: list[int], b_ids: list[int], models) -> tuple:
    """The columns of ``COLUMNS`` of one text's two tokenizations (see the module).

    A null or empty text, or one whose tokens' bytes don't join to space + text, has no tokens: zeros, no pairs and
    an empty ``groups_sha256``.
    """
    _, _, a_bytes, b_bytes, a_len, b_len, table = models
    none = (0, 0, 0, 0, "", NO_IDS, NO_IDS, NO_IDS)
    if not text or not a_ids or not b_ids:
        return none
    whole = (" " + text).encode("utf-8", "surrogatepass")
    if _joined(a_bytes, a_ids) != whole or _joined(b_bytes, b_ids) != whole:
        return none
    a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
    a_group, b_group, n_groups = groups_of(a_len[a_ids], b_len[b_ids])
    counts = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    keys, mult = linked_pairs(a_ids, b_ids, a_group, b_group, counts)
    found = digest(a_ids, b_ids, a_group, b_group, counts, table)
    return len(a_ids), len(b_ids), n_groups, int(counts[0] @ counts[1]), found, keys >> 32, keys & 0xFFFFFFFF, mult


def align_batch(texts: list[str | None], models) -> list[tuple]:
    """``align_ids`` of many texts, encoded in one call of each tokenizer."""
    a, b = models[0], models[1]
    present = [t if t else "" for t in texts]
    a_ids = [a.encode_ordinary(" " + t) for t in present]
    b_ids = b.encode(present, num_threads=1)
    return [align_ids(t, x, y, models) for t, x, y in zip(texts, a_ids, b_ids)]


def _record_batch(rows: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    """Rows of ``align_ids`` as Arrow columns; the lists of all texts are joined once and cut by offsets."""
    *plain, a, b, mult = zip(*found)
    offsets = pa.array(np.cumsum([0, *map(len, a)]), pa.int32())
    lists = [
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(part).astype(kind)))
        for part, kind in ((a, np.int32), (b, np.int32), (mult, np.int64))
    ]
    kinds = [pa.int64()] * 4 + [pa.string()]
    columns = [rows, *(pa.array(part, kind) for part, kind in zip(plain, kinds)), *lists]
    return pa.RecordBatch.from_arrays(columns, names=COLUMNS)


def tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document row, keyed by ``_row``: counts, group digest and distinct linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(a_path, b_path)
        for batch in batches:
            start, held, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size >= CHUNK_CHARS or len(held) == CHUNK_TEXTS or i == batch.num_rows - 1:
                    yield _record_batch(batch.column(0).slice(start, len(held)), align_batch(held, models))
                    start, held, size = i + 1, [], 0

    return docs.select("_row", "text").mapInArrow(run, TOKENS)


def alignment(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of document rows in which it is linked (repeated rows count each time). ``n_best``
    counts links whose pair count is the highest of its A id, ties included; ``count_sum`` sums pair counts over
    links. Columns other than doc_id and text are ignored; a null doc_id stays null.
    """
    from labelweave.llm.shared import stored

    docs = documents.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    docs = stored(docs, "alignment-docs")
    per_doc = stored(tokens(docs, a_path, b_path), "alignment-tokens")
    zipped = F.explode(F.arrays_zip(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("pm").alias("m")))
    pairs = per_doc.select("_row", zipped.alias("p")).select("_row", "p.a", "p.b", F.col("p.m").cast("long").alias("m"))
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))
    best = counts.groupBy("a").agg(F.max("docs").alias("top"))
    scored = stored(
        counts.join(best, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).cast("long").alias("is_best")),
        "alignment-counts",
    )
    sums = pairs.join(small(scored), ["a", "b"]).groupBy("_row").agg(
        F.sum(F.col("m") * F.col("is_best")).alias("n_best"), F.sum(F.col("m") * F.col("docs")).alias("count_sum")
    )
    return (
        docs.join(per_doc.drop("pa", "pb", "pm"), "_row")
        .join(sums, "_row", "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
            "groups_sha256",
        )
    )
