"""Near duplicates by Jaccard of word shingles: prefix filters under several global token orders, then verification.

If two sets are similar enough, their prefixes share a token, whatever the order that all sets are sorted by. The first
order puts common tokens last, so that a prefix holds the rarest tokens; it finds the candidates. Candidates must then
share a prefix token under each of the other orders too, and only what passes all filters is verified. Parity marks tell
apart sets that differ by too many tokens before a pair is written or a set moves. Short marks can't do that for large
sets, so large sets are cut into parts by bits of the tokens: if two sets are similar, so are their parts of some number,
since the ratio of sums is no more than the largest ratio. Prefixes, sizes and short marks are then those of parts. Sets
that are equal are one set from the start, and documents that a verified link has brought together aren't compared again,
so the pairs of a group of copies are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.components import components
from labelweave.llm.counts import collected, pieces_of
from labelweave.llm.shared import arrow_rows, discard, small, stored

#: Percent of the union that the intersection holds at least, and words of a shingle.
PERCENT, SHINGLE = 80, 5
#: Cells of the table of token counts.
CELLS = 1 << 20
#: Seeds of the token orders behind the first.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles; a shorter sequence of words is one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    code = np.full(n, width, np.uint64)
    for i in range(width):
        code = code * _STEP + hashed[i : i + n]
    return np.unique(mixed(code))


def prefix_length(n: int) -> int:
    """Tokens of a set of ``n`` of which a similar set must hold one."""
    return n - -(-PERCENT * n // 100) + 1


def prefix(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The tokens of the smallest ranks."""
    p = prefix_length(len(tokens))
    return tokens[np.argpartition(rank, p - 1)[:p]] if p < len(tokens) else tokens


#: Tokens of a part, on average, at most; the next depth has four times the parts.
PART = 384


def depths(n: int) -> list[int]:
    """Depths that a set of ``n`` is cut at: its own, and the next if similar sets may be cut at that."""
    own = 0
    while n > PART << 2 * own:
        own += 1
    return [own, own + 1] if 100 * n > PERCENT * PART << 2 * own else [own]


def parts(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The part of each token, of 4 ** ``depth`` parts; numbers differ between depths."""
    cut = (tokens >> np.uint64(20)) & np.uint64((1 << 2 * depth) - 1)
    return cut.astype(np.int32) + np.int32(depth << 24)


def part_prefixes(tokens: np.ndarray, rank: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the smallest ranks of each part, with the part's number and size. Equal tokens differ between depths."""
    part = parts(tokens, depth)
    order = np.lexsort((rank, part))
    names, start, size = np.unique(part[order], return_index=True, return_counts=True)
    length = np.array([prefix_length(n) for n in size.tolist()])
    row = np.repeat(np.arange(len(names)), length)
    at = order[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + start[row]]
    return tokens[at] ^ mixed(np.full(1, depth, np.uint64)), names[row], size[row].astype(np.int32)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Filters under the further orders, then the exact condition, over two sorted sets."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    for seed in ORDERS:
        if not len(np.intersect1d(*(prefix(x, mixed(x ^ np.uint64(seed))) for x in (a, b)), assume_unique=True)):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


#: Bits of a set's parity marks: a power of two, at least 64.
BITS = 2048
#: Numbers of 64 bits in the short marks of a part.
BRIEF = 4
BRIEFS = [f"brief{i}" for i in range(BRIEF)]
PROFILE = (
    "kind int, doc bigint, n int, sig_a bigint, sig_b bigint, marks array<bigint>, part int, "
    + "".join(f"{name} bigint, " for name in BRIEFS) + "piece int, counts binary"
)
_PROFILE = pa.schema(
    [("kind", pa.int32()), ("doc", pa.int64()), ("n", pa.int32()), ("sig_a", pa.int64()), ("sig_b", pa.int64()),
     ("marks", pa.list_(pa.int64())), ("part", pa.int32()), *[(name, pa.int64()) for name in BRIEFS],
     ("piece", pa.int32()), ("counts", pa.binary())]
)


def parity_marks(tokens: np.ndarray) -> np.ndarray:
    """Bits that say of how many tokens each is hit, odd or even. Two sets differ by as many tokens as bits at least."""
    hits = np.bincount((tokens >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(hits.astype(np.uint8)).view(np.int64)


def part_marks(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, size and short parity marks of each part of a set, at all its depths."""
    found = []
    for depth in depths(len(tokens)):
        names, own, size = np.unique(parts(tokens, depth), return_inverse=True, return_counts=True)
        bits = own * (64 * BRIEF) + (tokens >> np.uint64(64 - (64 * BRIEF).bit_length() + 1)).astype(np.int64)
        hits = np.bincount(bits, minlength=len(names) * 64 * BRIEF) & 1
        found.append((names, size, np.packbits(hits.astype(np.uint8)).view(np.int64).reshape(-1, BRIEF)))
    return tuple(map(np.concatenate, zip(*found)))


def _profile_rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(size, kind)
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _PROFILE]
    return pa.RecordBatch.from_arrays(arrays, schema=_PROFILE)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with size and fingerprint of its set (kind 0), a row per part of it (kind 2); at the end of a
    task, its token counts in pieces (kind 1)."""
    total = np.zeros(CELLS, np.int32)
    for batch in batches:
        size, sums, marks, docs, cut = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            tokens = shingles(text.as_py())
            size.append(len(tokens))
            marks.append(parity_marks(tokens))
            sums.append((tokens.sum(dtype=np.uint64), mixed(tokens ^ np.uint64(ORDERS[0])).sum(dtype=np.uint64)))
            np.add.at(total, (tokens & np.uint64(CELLS - 1)).astype(np.int64), 1)
            if doc is not None and len(tokens):
                cut.append(part_marks(tokens))
                docs.append(np.full(len(cut[-1][0]), doc, np.int64))
        sums = _signed(np.array(sums, np.uint64).reshape(-1, 2))
        n = batch.num_rows
        every = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * (BITS // 64)),
            pa.array(np.concatenate(marks) if marks else np.empty(0, np.int64)),
        )
        yield _profile_rows(
            0, n, doc=batch.column(0).cast(pa.int64()), n=size, sig_a=sums[:, 0].copy(), sig_b=sums[:, 1].copy(), marks=every
        )
        if cut:
            part, n_part, short = map(np.concatenate, zip(*cut))
            short = {name: short[:, i].copy() for i, name in enumerate(BRIEFS)}
            yield _profile_rows(2, len(part), doc=np.concatenate(docs), n=n_part, part=part, **short)
    pieces = pieces_of(total)
    yield _profile_rows(1, pieces.num_rows, piece=pieces.column(0), counts=pieces.column(1))


def levels(profile: DataFrame) -> np.ndarray:
    """How common tokens are, by cell of the count table: in steps around the mean load, by log count far above.

    The table has ``CELLS`` cells whatever the corpus, so it may be collected and broadcast. Any level gives right
    results; it decides how rare the tokens of a prefix are. Chance spreads the cells by the root of the mean load;
    levels are steps of an eighth of that, so that a token somewhat more common than the rest already comes late: its
    cell is above the usual ones, and prefixes take the tokens of the least cells.
    """
    total = collected(profile.filter("kind = 1"), CELLS)
    load = total.mean()
    near = 8 * (total - load) / np.sqrt(load + 1)
    far = 64 + 32 * np.log2(np.maximum(near / 64, 1))
    return (4096 + np.where(near <= 64, np.maximum(near, -4096), far)).astype(np.uint16)


#: Prefix tokens in a batch, unless one set has more; texts that a task hands to Python at a time.
HELD_TOKENS, BATCH_ROWS = 1 << 17, 500


def _prefixes(shared):
    def rows(found: list[tuple], docs: list[np.ndarray]) -> pa.RecordBatch:
        tokens, part, size = map(np.concatenate, zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(_signed(tokens)), pa.array(np.concatenate(docs)), pa.array(part), pa.array(size)],
            names=["token", "doc", "part", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            found, docs, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingles(text.as_py())
                if not len(own):
                    continue
                common = level[(own & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
                rank = (common << np.uint64(48)) | (own >> np.uint64(16))
                for depth in depths(len(own)):
                    found.append(part_prefixes(own, rank, depth))
                    docs.append(np.full(len(found[-1][0]), doc, np.int64))
                    held += len(docs[-1])
                if held >= HELD_TOKENS:
                    yield rows(found, docs)
                    found, docs, held = [], [], 0
            if found:
                yield rows(found, docs)

    return run


#: Bytes of sets in a batch, unless one set is longer.
SET_BYTES = 4 << 20


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text, behind the columns before it, in batches of bounded size."""
    for batch in batches:
        *kept, texts = batch.columns
        names = [*batch.schema.names[:-1], "tokens"]
        held, size, start = [], 0, 0
        for i, text in enumerate(texts):
            held.append(shingles(text.as_py()).tobytes())
            size += len(held[-1])
            if size >= SET_BYTES or i == len(texts) - 1:
                part = [c.slice(start, len(held)) for c in kept]
                yield pa.RecordBatch.from_arrays([*part, pa.array(held, pa.binary())], names=names)
                held, size, start = [], 0, i + 1


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = (
            [np.frombuffer(v.as_buffer(), np.uint64) for v in pair] for pair in zip(batch.column(2), batch.column(3))
        )
        good = pa.array([similar(*pair) for pair in sets], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(good)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar.

    Only documents in pairs become sets, in the scan of the texts. The sets of ``a`` go to ``b`` with their pair, so each
    set moves once for a pair; a document with many partners should be ``b``, where Spark splits it if it is hot.
    """
    pairs = stored(pairs, "pairs")
    firsts = texts.join(small(pairs.withColumnRenamed("a", "doc")), "doc").select(F.col("doc").alias("a"), "b", "text")
    seconds = texts.join(small(stored(pairs.select(F.col("b").alias("doc")).distinct(), "ids")), "doc", "left_semi")
    with_sets = (
        firsts.mapInArrow(_sets, "a bigint, b bigint, tokens binary")
        .join(seconds.select(F.col("doc").alias("b"), "text").mapInArrow(_sets, "b bigint, tokens binary").withColumnRenamed("tokens", "others"), "b")
        .select("a", "b", "tokens", "others")
    )
    return stored(with_sets.mapInArrow(_verify, "a bigint, b bigint"), "verified")


def _near_in_size(one: str, other: str):
    return (100 * F.col(one) >= PERCENT * F.col(other)) & (100 * F.col(other) >= PERCENT * F.col(one))


def _few(odd: Column, one: str, other: str) -> Column:
    """Whether sets of these sizes that differ by ``odd`` tokens at least may be similar."""
    return (100 + PERCENT) * odd <= (100 - PERCENT) * (F.col(one) + F.col(other))


def plausible(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be similar by the marks of ``sizes`` (doc, n, marks): similar sets differ by so few tokens."""
    own = lambda side: sizes.select(
        F.col("doc").alias(side), F.col("n").alias(f"{side}_n"), F.col("marks").alias(f"{side}_marks")
    )
    odd = F.aggregate(
        F.zip_with("a_marks", "b_marks", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k
    )
    return pairs.join(own("a"), "a").join(own("b"), "b").filter(_few(odd, "a_n", "b_n")).select("a", "b").distinct()


def linked(docs: DataFrame) -> DataFrame:
    """Size of the shingle set and component of every document: doc_id, n_shingles, component_id, one row per row.

    Words are runs without ASCII space, A-Z lower-cased. Documents link when the intersection of their sets of 5-word
    shingles is 80 percent of their union or more; component_id is the smallest doc_id that links reach. Documents
    without words, null texts included, link with nothing and are their own component. Rows that repeat an id are one
    document if their texts agree, else every text links that document. A null id has no component and links nothing.
    Shingles are compared by 64-bit hashes. Other columns are ignored.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _linked(docs)


def _linked(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    profile = stored(texts.mapInArrow(_profile, PROFILE), "profile")
    sizes = profile.filter("kind = 0").select("doc", "n", "sig_a", "sig_b", "marks")
    worded = sizes.filter("doc is not null and n > 0")
    firsts = stored(worded.groupBy("n", "sig_a", "sig_b").agg(F.min("doc").alias("first"), F.count("*").alias("k")), "sets")
    again = stored(
        worded.join(firsts.filter("k > 1"), ["n", "sig_a", "sig_b"]).select("doc", "first").filter("doc > first").distinct(),
        "copies",
    )
    repeated = stored(worded.groupBy("doc").agg(F.count("*").alias("k")).filter("k > 1").select("doc"), "repeated")
    level = spark.sparkContext.broadcast(levels(profile))
    gone = small(stored(again.select("doc").join(repeated, "doc", "left_anti"), "gone"))
    alone = texts.filter("doc is not null").join(gone, "doc", "left_anti")
    prefixes = alone.mapInArrow(_prefixes(level), "token bigint, doc bigint, part int, n int")
    of_token = Window.partitionBy("token")
    met = prefixes.select(
        "*", F.min(F.struct("doc", "n")).over(of_token).alias("pivot"), F.max("doc").over(of_token).alias("last")
    ).filter("pivot.doc < last")
    held = stored(met.select("token", "doc", "part", "n", F.col("pivot.doc").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "held")

    # Each document against the pivot that it shares the most prefix tokens with.
    counted = held.filter((F.col("doc") > F.col("pivot")) & _near_in_size("n", "pivot_n")).groupBy("doc", "pivot").count()
    best = counted.groupBy("doc").agg(F.max_by("pivot", F.struct("count", -F.col("pivot"))).alias("b"))
    tried = stored(plausible(best.select(F.col("doc").alias("a"), "b"), worded), "tried")
    links = verified(tried, alone)

    # Then what shares a prefix token and isn't together yet. Sizes and short marks of the parts are compared where rows
    # of a token meet, so a pair that they tell apart is never written.
    comps = components(links)
    named = stored(
        held.join(small(comps), "doc", "left").select("token", "doc", "part", F.coalesce("comp", "doc").alias("comp")),
        "named",
    )
    discard(held)
    shares = named.groupBy("token", "comp").count()
    major = (
        shares.groupBy("token")
        .agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.count("*").alias("comps"))
        .filter("comps > 1")
        .drop("comps")
    )
    marked = profile.filter("kind = 2").select("doc", "part", "n", *BRIEFS)
    mixed_tokens = stored(named.join(major, "token").join(marked, ["doc", "part"]).drop("part"), "mixed")
    discard(named)
    minor = mixed_tokens.filter("comp != major").drop("major")
    minor = minor.select("token", *[F.col(c).alias(f"x_{c}") for c in minor.columns if c != "token"])
    odd = sum((F.bit_count(F.col(name).bitwiseXOR(F.col(f"x_{name}"))) for name in BRIEFS), F.lit(0))
    pairs = (
        minor.join(mixed_tokens.drop("major"), "token")
        .filter((F.col("x_comp") != F.col("comp")) & _near_in_size("n", "x_n") & _few(odd, "n", "x_n"))
        .select(F.greatest("x_doc", "doc").alias("a"), F.least("x_doc", "doc").alias("b"))
        .distinct()
    )
    more = verified(plausible(pairs.join(small(tried), ["a", "b"], "left_anti"), worded), alone)
    discard(mixed_tokens)
    copies = again.select(F.col("doc").alias("a"), F.col("first").alias("b"))
    whole = components(links.unionByName(more).unionByName(copies))
    return (
        sizes.join(whole, "doc", "left")
        .select(
            F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("comp", "doc").alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id. Rows that repeat an id stay once; rows
    without id stay."""
    found = linked(docs)
    gone = stored(found.filter("doc_id > component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if repeated.isEmpty():
        return kept
    several = kept.join(repeated, "doc_id", "left_semi").select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(several.dropDuplicates(["doc_id"]))
