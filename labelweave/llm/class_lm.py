"""Class-based bigram model: exchange clustering gives words classes; transitions and emissions give smoothed scores.

Every token of the training texts is counted. A first exchange moves the ``CORE`` most frequent words one by one and all
others in bins by their last three bytes, so its table of pair counts has a fixed size whatever the corpus. That is the
start for a second exchange, in which each word outside the core moves on its own: the classes beside it are counted
corpus-wide, the counts of a word meet in one place, and it takes the class of the largest likelihood. Transitions are
then counted anew. Words and their counts stay distributed: a chunk of documents gets the numbers of its own words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.counts import COUNTS, collected, pieces_of
from labelweave.llm.shared import crc_mod, discard, plain_broadcast, stored

#: Words of their own in the first exchange, and bins of the rest; with the end they make OBJECTS.
CORE, BINS = 767, 256
OBJECTS = CORE + BINS + 1
CLASSES, SWEEPS = 40, 6
#: The end of a text; no word can hold white space.
END = b"\n"
#: Added to counts: of a word in its class, and of a transition.
WORD_ADD, STEP_ADD, BASE_ADD = 0.1, 0.5, 0.1
#: Bytes of text in a chunk of documents, unless one text is longer.
CHUNK_BYTES = 12 << 20
#: Tokens that a task counts before it hands its counts on; equal words meet again in the sum.
HELD_TOKENS = 1_000_000
#: Words remembered by a worker while it maps words to objects.
REMEMBERED = 400_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def bin_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BINS


class Objects(dict):
    """Number of the object of a word: core words first, then bins, then the end."""

    def __init__(self, core: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(core))
        self.core = core
        self[END] = OBJECTS - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self.__init__(self.core)
        number = self[word] = CORE + bin_of(word)
        return number


def _word_counts(bounds: np.ndarray):
    """(block, word, training count) of all words of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for block, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), block, np.int32)), pa.array(list(counts), pa.binary()),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    names=["block", "word", "n"],
                )
            held.clear()

        for batch in batches:
            blocks, train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block, learns, text in zip(blocks, train, batch.column(2)):
                words = words_of(text.as_py())
                words.append(END)
                counts = held.setdefault(block, Counter())
                if learns:
                    counts.update(words)
                else:
                    for word in words:
                        counts.setdefault(word, 0)
                size += len(words)
            if size > HELD_TOKENS:
                yield from rows()
                size = 0
        yield from rows()

    return run


class Slots(dict):
    """Number of a word in its chunk, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


CHUNK = (
    "chunk bigint, doc_id array<bigint>, held_out array<boolean>, size array<int>, slots binary, word array<binary>, "
    "n array<bigint>"
)


def _packed(values: np.ndarray) -> bytes:
    """Compressed, byte by byte of the numbers: the high bytes are mostly zero."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, size * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).reshape(-1).view(kind)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, held_out, text) of a task in chunks: a chunk's distinct words with their training counts, and
    the texts as numbers of these words, each text with its end."""
    first, made = TaskContext.get().partitionId() << 32, 0
    number, ids, held, texts, size = Slots(), [], [], [], 0

    def row() -> pa.RecordBatch:
        train = [t for t, out in zip(texts, held) if not out]
        n = np.bincount(np.concatenate(train), minlength=len(number)) if train else np.zeros(len(number), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                pa.array([_packed(np.concatenate(texts))], pa.binary()), pa.array([list(number)], pa.list_(pa.binary())),
                pa.array([n.astype(np.int64)], pa.list_(pa.int64())),
            ],
            names=["chunk", "doc_id", "held_out", "size", "slots", "word", "n"],
        )

    for batch in batches:
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = words_of(text.as_py())
            words.append(END)
            texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            ids.append(doc)
            held.append(out)
            size += sum(map(len, words))
            if size >= CHUNK_BYTES:
                yield row()
                made += 1
                number, ids, held, texts, size = Slots(), [], [], [], 0
    if ids:
        yield row()


def _tokens(chunk: dict, training: bool) -> np.ndarray:
    """Slots of the texts of a chunk, one behind the other; ``training``: without those held out."""
    size = np.array(chunk["size"], np.int64)
    slots = _unpacked(chunk["slots"], np.int32, int(size.sum()))
    return slots[np.repeat(~np.array(chunk["held_out"], bool), size)] if training else slots


def _objects(core: list[bytes], words: list[bytes]) -> np.ndarray:
    number = Objects(core)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _pairs(core: list[bytes]):
    """Counts of neighbouring objects, a text preceded by an end, in pieces at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(OBJECTS * OBJECTS, np.int64)
        for chunk in _each(batches):
            now = _objects(core, chunk["word"])[_tokens(chunk, training=True)]
            # A text ends with its end, which stands before the next.
            total += np.bincount(np.concatenate(([OBJECTS - 1], now[:-1]))[: len(now)] * OBJECTS + now, minlength=len(total))
        yield pieces_of(total)

    return run


def _plog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every object: each in turn moves where the likelihood of the class bigrams is largest, until none moves.

    The last object is the end; it has a class of its own, the last. Objects start in the order of their counts, dealt
    over the classes; ties go to the smallest class.
    """
    n = len(pairs)
    count = pairs.sum(axis=0)
    order = np.lexsort((np.arange(n - 1), -count[:-1]))
    own = np.zeros(n, np.int64)
    own[order] = np.arange(n - 1) % classes
    own[-1] = classes
    member = np.zeros((n, classes + 1))
    member[np.arange(n), own] = 1
    right = pairs @ member  # object x class behind it
    left = (pairs.T @ member)  # object x class before it
    table = member.T @ right
    used = order[count[order] > 0]
    for _ in range(sweeps):
        moved = 0
        for w in used:
            c, self_pair = own[w], float(pairs[w, w])
            r, before = right[w].copy(), left[w].copy()
            r[c] -= self_pair
            before[c] -= self_pair
            table[c] -= r
            table[:, c] -= before
            table[c, c] -= self_pair
            diagonal = table.diagonal()
            gain = (_plog(table + r) - _plog(table)).sum(axis=1) + (_plog(table + before[:, None]) - _plog(table)).sum(axis=0)
            gain += _plog(diagonal + r + before + self_pair) + _plog(diagonal) - _plog(diagonal + r) - _plog(diagonal + before)
            for axis, more in ((1, r.sum() + self_pair), (0, before.sum() + self_pair)):
                margin = table.sum(axis=axis)
                gain -= _plog(margin + more) - _plog(margin)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[c] + 1e-6:
                best = c
            table[best] += r
            table[:, best] += before
            table[best, best] += self_pair
            if best != c:
                moved += 1
                own[w] = best
                right[:, c] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, c] -= pairs[w]
                left[:, best] += pairs[w]
        if not moved:
            break
    return own


#: What stands beside a word: classes behind it, classes before it, the word itself.
BESIDE = 2 * (CLASSES + 1) + 1
#: Entries of a word's neighbours are 16 bits: which, and how often; more often takes several entries.
OFTEN = 511
CONTEXTS = "word binary, chunk bigint, slot int, n bigint, beside binary"


def _contexts(core: list[bytes], own: np.ndarray):
    """A row for each word of a chunk, with what stands beside it in training texts if it is outside the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _each(batches):
            objects = _objects(core, chunk["word"])
            moves = (objects >= CORE) & (objects < OBJECTS - 1)
            at = _tokens(chunk, training=True).astype(np.int64)
            classes = own[objects[at]]
            # The end is no word that moves, so every word that does has a neighbour on both sides.
            here = np.flatnonzero(moves[at])
            before = np.where(here > 0, classes[here - 1], CLASSES)
            same_after = at[here + 1] == at[here]
            same_before = (here > 0) & (at[here - 1] == at[here])
            after = np.where(same_after, BESIDE - 1, classes[here + 1])
            codes = np.concatenate((at[here] * BESIDE + after, (at[here] * BESIDE + CLASSES + 1 + before)[~same_before]))
            codes, often = np.unique(codes, return_counts=True)
            times = -(-often // OFTEN)
            last = np.cumsum(times) - 1
            entries = np.full(int(times.sum()), OFTEN, np.uint16)
            entries[last] = often - (times - 1) * OFTEN
            codes = np.repeat(codes, times)
            entries |= (codes % BESIDE << 9).astype(np.uint16)
            ends = np.searchsorted(codes // BESIDE, np.arange(len(objects) + 1)).astype(np.int32) * 2
            n = len(objects)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk["word"], pa.binary()), pa.array(np.full(n, chunk["chunk"], np.int64)),
                    pa.array(np.arange(n, dtype=np.int32)), pa.array(chunk["n"], pa.int64()),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(entries)]),
                ],
                names=["word", "chunk", "slot", "n", "beside"],
            )

    return run


def best_classes(table: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For words of classes ``own`` the class where the likelihood of the class bigrams is largest, all else as it is.

    ``table`` counts pairs of classes; ``right`` and ``left`` count the classes behind and before each word, without the
    word itself, ``same`` how often it follows itself. A word stays if nothing is better; ties go to the smallest class.
    """
    n, k = len(own), CLASSES
    word = np.arange(n)
    gain = np.zeros((n, k))
    for cells, near, far in ((table, right, left), (table.T, left, right)):
        at, d = np.nonzero(near)
        if not len(at):
            continue
        times = near[at, d]
        rest = cells[:k, d].T.copy()  # without the word: its own class loses what it brought
        rest[np.arange(len(at)), own[at]] -= times
        home = np.flatnonzero(d == own[at])
        rest[home] -= far[at[home], :k]
        rest[home, own[at[home]]] -= same[at[home]]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        gain[at[starts]] += np.add.reduceat(_plog(rest + times[:, None]) - _plog(rest), starts, axis=0)
    diagonal = np.tile(table.diagonal()[:k], (n, 1))
    diagonal[word, own] -= right[word, own] + left[word, own] + same
    r, before = right[:, :k], left[:, :k]
    gain += _plog(diagonal + r + before + same[:, None]) + _plog(diagonal) - _plog(diagonal + r) - _plog(diagonal + before)
    for margin, more in ((table.sum(axis=1), right.sum(axis=1) + same), (table.sum(axis=0), left.sum(axis=1) + same)):
        rest = np.tile(margin[:k], (n, 1))
        rest[word, own] -= more
        gain -= _plog(rest + more[:, None]) - _plog(rest)
    best = gain.argmax(axis=1)
    return np.where(gain[word, best] > gain[word, own] + 1e-6, best, own)


#: Words whose gains are worked out at once.
AT_ONCE = 500
NUMBERS = "chunk bigint, slot int, c bigint, class int, lead boolean"


def _numbered(core: list[bytes], own: np.ndarray, table: np.ndarray):
    """Training count and class of each word for every chunk that holds it, from rows sorted by word. ``lead`` marks one
    row of each word that was learned."""

    def whole(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        k = len(starts)
        of = np.repeat(np.arange(k), np.diff(np.append(starts, rows.num_rows)))
        c = np.add.reduceat(rows.column("n").to_numpy(), starts)
        objects = _objects(core, rows.column("word").take(pa.array(starts)).to_pylist())
        classes = own[objects]
        blobs = rows.column("beside").to_pylist()
        entries = np.frombuffer(b"".join(blobs), np.uint16)
        group = np.repeat(of, [len(b) // 2 for b in blobs])
        moving = np.flatnonzero(np.bincount(group, minlength=k))
        ends = np.searchsorted(group, np.arange(k + 1))
        for i in range(0, len(moving), AT_ONCE):
            some = moving[i : i + AT_ONCE]
            part = slice(ends[some[0]], ends[some[-1] + 1])
            codes = np.searchsorted(some, group[part]) * BESIDE + (entries[part] >> 9)
            beside = np.bincount(codes, entries[part] & OFTEN, len(some) * BESIDE).reshape(-1, BESIDE)
            right, left = beside[:, : CLASSES + 1], beside[:, CLASSES + 1 : -1]
            classes[some] = best_classes(table, classes[some], right, left, beside[:, -1])
        lead = np.zeros(rows.num_rows, bool)
        lead[starts] = (c > 0) & (objects < OBJECTS - 1)
        return pa.RecordBatch.from_arrays(
            [
                rows.column("chunk").combine_chunks(), rows.column("slot").combine_chunks(), pa.array(c[of]),
                pa.array(classes[of].astype(np.int32)), pa.array(lead),
            ],
            names=["chunk", "slot", "c", "class", "lead"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last word's rows, until another word comes
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            words = rows.column("word")
            if held and held[-1].column("word")[0] == words[0] and words[0] == words[-1]:
                held.append(rows)
                continue
            rows = pa.concat_tables([*held, rows]).combine_chunks()
            words = rows.column("word")
            new = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(new) + 1))
            if len(starts) > 1:
                yield whole(rows.slice(0, starts[-1]).combine_chunks(), starts[:-1])
            held = [rows.slice(starts[-1])]
        if held:
            yield whole(pa.concat_tables(held).combine_chunks(), np.zeros(1, np.int64))

    return run


CLASSED = (
    "doc_id array<bigint>, held_out array<boolean>, size array<int>, n_known array<bigint>, base_score array<double>, "
    "emitted array<double>, classes binary, steps array<bigint>, words array<bigint>"
)


def _classed(n_train: int, n_distinct: int) -> Callable:
    """The texts of a chunk as classes, with all that scores need but the transitions and the mass of the classes; and the
    chunk's part in these: counts of neighbouring classes in training texts, and the words that it leads, by class."""
    base_mass = n_train + BASE_ADD * (n_distinct + 1)

    def run(key: tuple, chunks: pa.Table, numbers: pa.Table) -> pa.Table:
        chunk = chunks.select(["held_out", "size", "slots"]).to_pylist()[0]
        slot = numbers.column("slot").to_numpy()
        counts, own = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.uint8)
        counts[slot] = numbers.column("c").to_numpy()
        own[slot] = numbers.column("class").to_numpy()
        base = np.log10((counts + BASE_ADD) / base_mass)
        emitted = np.where(own == CLASSES, 0.0, np.log10(counts + WORD_ADD))
        at = _tokens(chunk, training=False)
        size = np.array(chunk["size"], np.int64)
        known, sums, start = [], [], 0
        for width in size.tolist():
            text = at[start : start + width]
            known.append(int(np.count_nonzero(counts[text])))
            sums.append((float(base[text].sum()), float(emitted[text].sum())))
            start += width
        train = np.repeat(~np.array(chunk["held_out"], bool), size)
        classes = own[at]
        learned = classes[train].astype(np.int64)
        before = np.concatenate(([CLASSES], learned[:-1]))[: len(learned)]
        steps = np.bincount(before * (CLASSES + 1) + learned, minlength=(CLASSES + 1) ** 2)
        lead = numbers.column("class").to_numpy()[numbers.column("lead").to_numpy(zero_copy_only=False)]
        kept = [chunks.column(name).combine_chunks() for name in ("doc_id", "held_out", "size")]
        return pa.table(
            [
                *kept, pa.array([known], pa.list_(pa.int64())), pa.array([[b for b, _ in sums]], pa.list_(pa.float64())),
                pa.array([[e for _, e in sums]], pa.list_(pa.float64())), pa.array([_packed(classes)], pa.binary()),
                pa.array([steps.astype(np.int64)], pa.list_(pa.int64())),
                pa.array([np.bincount(lead, minlength=CLASSES + 1).astype(np.int64)], pa.list_(pa.int64())),
            ],
            names=["doc_id", "held_out", "size", "n_known", "base_score", "emitted", "classes", "steps", "words"],
        )

    return run


def _summed(rows: DataFrame, name: str, size: int) -> np.ndarray:
    """The sum of the arrays of a column, place by place."""
    total = np.zeros(size)
    for row in rows.select(F.posexplode(name).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[row["at"]] = row["n"]
    return total


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value["steps"]
        for chunk in _each(batches):
            size = np.array(chunk["size"], np.int64)
            classes = _unpacked(chunk["classes"], np.uint8, int(size.sum())).astype(np.int64)
            found = steps[np.concatenate(([CLASSES], classes[:-1])), classes]
            ends = np.cumsum(size)
            sums = [float(found[a:b].sum()) for a, b in zip((ends - size).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk["doc_id"], pa.int64()), pa.array(chunk["held_out"], pa.bool_()), pa.array(size),
                    pa.array(chunk["n_known"], pa.int64()), pa.array(chunk["base_score"], pa.float64()),
                    pa.array(np.array(chunk["emitted"], float) + sums),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


class Steps:
    """log10 of transitions, less that of the mass of the class they lead to: its tokens and distinct words."""

    def __init__(self, pairs: np.ndarray, distinct: np.ndarray):
        steps = pairs + STEP_ADD
        mass = pairs.sum(axis=0) + WORD_ADD * (distinct + 1)
        mass[CLASSES] = 1  # the end is certain in its class
        self.steps = np.log10(steps / steps.sum(axis=1, keepdims=True)) - np.log10(mass)


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """Score whole texts by a model of those whose crc32 of the id isn't ``held`` modulo ``folds``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, one row per row. A token is a
    word between ASCII spaces, A-Z lower-cased, or the end of a text. A null or empty text is its end alone. ``base_score``
    is the log10 probability under an add-0.1 unigram model, ``score`` under the class model. A null id is not held out.
    Every learned word outside the core takes the class that is best for it, all of them at once, by the classes beside it
    after the first exchange. Unknown words have the class of their bin. With nothing to learn from, all words are unknown.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held_out.alias("held_out"), "text")
    learning = docs.filter(~F.col("held_out")).select(F.lit(0).alias("block"), F.lit(True).alias("train"), "text")
    counted = learning.mapInArrow(_word_counts(np.zeros(0)), "block int, word binary, n bigint")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("c")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    plain = words.filter(F.col("word") != F.lit(END))
    core = [bytes(r["word"]) for r in plain.orderBy(F.desc("c"), "word").limit(CORE).collect()]
    discard(words)

    chunks = stored(docs.mapInArrow(_chunks, CHUNK), "chunks")
    texts = chunks.select("chunk", "held_out", "size", "slots", "word", "n")
    pairs = collected(texts.mapInArrow(_pairs(core), COUNTS), OBJECTS * OBJECTS).reshape(OBJECTS, OBJECTS).astype(float)
    own = exchange(pairs)
    member = np.eye(CLASSES + 1)[own]
    table = member.T @ pairs @ member
    contexts = texts.mapInArrow(_contexts(core, own), CONTEXTS)
    numbers = contexts.repartition("word").sortWithinPartitions("word").mapInArrow(_numbered(core, own, table), NUMBERS)
    classed = stored(
        chunks.drop("word", "n").groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(_classed(*sums), CLASSED),
        "classed",
    )
    discard(chunks)
    width = CLASSES + 1
    model = Steps(_summed(classed, "steps", width * width).reshape(width, width), _summed(classed, "words", width))
    scored = classed.drop("steps", "words").mapInArrow(_scores(plain_broadcast(spark, model)), SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(sums[0]).cast("long").alias("train_tokens"), "base_score",
        "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
