"""Token counts of a byte-level byte-pair vocabulary: merges in a heap over a linked list, no ids made."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.shared import in_worker

#: The pattern by which byte-level vocabularies of this kind split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces longer than this are counted anew each time, and a full cache is emptied, so a worker's memory is bounded.
CACHED_LENGTH, CACHED_PIECES = 64, 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself where printable, else the next free."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the symbols that remain of a piece after all merges."""

    def __init__(self, model: dict):
        letters = byte_letters()
        byte_of = {letter: bytes([b]) for b, letter in enumerate(letters)}

        def raw(symbol: str) -> bytes:
            return b"".join(byte_of[c] for c in symbol)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Initial symbols less merges. The lowest rank goes first, of equal ranks the leftmost."""
        n = len(piece)
        if n < 2:
            return n
        rank, symbols = self.rank, [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b))) is not None
        ]
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:  # one of the two has been merged since
                continue
            merges += 1
            symbols[i], symbols[j] = a + b, b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((a + b, symbols[k]))) is not None:
                    heappush(heap, (r, i, a + b, symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], a + b))) is not None:
                heappush(heap, (r, h, symbols[h], a + b))
        return n - merges

    def _learn(self, piece: str) -> int:
        count = self.merged(piece.encode())
        if len(piece) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_PIECES:
                self.known.clear()
            self.known[piece] = count
        return count

    def plain(self, text: str) -> int:
        known, learn, total = self.known.get, self._learn, 0
        for piece in self.pieces.findall(text):
            count = known(piece)
            total += learn(piece) if count is None else count
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        total, start = 0, 0
        for found in self.special.finditer(text):
            total += self.plain(text[start : found.start()]) + 1
            start = found.end()
        return total + self.plain(text[start:] if start else text)


def counter_of(model: str) -> MergeCounter:
    """One counter per Python worker and vocabulary."""
    return in_worker(("merges", model), lambda: MergeCounter(json.loads(model)))


def n_tokens(text: Column, model: str) -> Column:
    """Column of token counts; ``model`` is the content of a tokenizer's json file. Null texts have no tokens."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(vocabulary.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    from pyspark.sql import SparkSession

    vocabulary = SparkSession.active().sparkContext.broadcast(model)
    return counted(text)


def count_tokens(docs: DataFrame, model: str, limit: int = 512) -> DataFrame:
    """Tokens of every text: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``), one row per row.

    Special tokens inside a text count one each, as the library takes them by default. Null and empty texts have 0 bytes
    and 0 tokens. A piece of any length takes n log n steps. Null ids and repeated rows pass through; other columns are
    ignored.
    """
    counted = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(F.col("text"), model).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
