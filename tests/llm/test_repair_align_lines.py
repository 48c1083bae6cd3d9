"""Operators 11 to 13 against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from labelweave.llm import conversation_repair as cr
from labelweave.llm import line_dedup, token_alignment

# --- op11 ---

CONV_SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, cost int"
CONVERSATIONS = [
    (1, 0, "system", "Be brief.", "x", 1), (1, 1, "user", "Hi there.", "x", 1), (1, 2, "assistant", "Hello!", "x", 1),
    (1, 3, "user", "Hi there.", "x", 1), (1, 4, "assistant", "cut off", "x", 1),
    (2, 0, "assistant", "Wrong start.", "x", 1), (2, 1, "assistant", "Again.", "x", 1), (2, 2, "user", "   ", "x", 1),
    (3, None, "user", None, "x", 1), (3, 1, None, "Fine.", "x", 1), (3, 1, "user", "Tie one.", "x", 1),
    (4, 5, "user", "Gap?", "x", 1), (4, 9, "assistant", "Yes.", "x", 1), (4, 9, "assistant", "Yes.", "x", 1),
    (None, 0, "user", "Null id.", "x", 1), (None, 1, "assistant", "Ok.", "x", 1),
    (5, 0, "tool", "Odd role.", "x", 1), (5, 1, "", "Empty role.", "x", 1),
    (6, 0, "user", "q" * 5000 + ".", "x", 1), (6, 1, "assistant", "a ", "x", 1),
] + [(7, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.", "x", 1) for t in range(40)] + [
    (8, t, "user", "same.", "x", 1) for t in range(3)
]


def damaged_rows(rows):
    """The contract's damage, in plain Python."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        out.setdefault(conv, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out[conv].extend([(turn, role, text)] * (2 if code == 3 else 1))
    return out


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            faults.append("truncated")
        else:
            faults.append(None)
        seen.add((role, text))

    def step(state, ch):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, ch), state if ch == "" else None)

    def inserted(state):
        return 3 if state == 2 else 2

    @lru_cache(maxsize=None)
    def best(i, state):
        """Least (cost, audit) of the rest from row i in ``state``, whole strings compared."""
        options = []
        s, c, pre = state, 0, ""
        for _ in range(3):
            if i == len(rows):
                if s in (0, 3):
                    options.append((c, pre))
            else:
                role, fault = rows[i][1], faults[i]
                rest = best(i + 1, s)
                options.append((c + 3 + rest[0], pre + "D" + rest[1]))
                if fault not in ("blank", "duplicate"):
                    extra = 1 if fault == "truncated" else 0
                    if (k := step(s, role[:1])) is not None and (r := best(i + 1, k))[0] < 1e9:
                        options.append((c + extra + r[0], pre + "K" + r[1]))
                    if (r := best(i + 1, inserted(s)))[0] < 1e9:
                        options.append((c + 2 + extra + r[0], pre + "R" + r[1]))
            s, c, pre = inserted(s), c + 2, pre + "I"
        return min(options) if options else (1e9, "")

    cost, audit = best(0, 0)
    lines, state, i = [], 0, 0
    for letter in audit:
        if letter == "I":
            state = inserted(state)
            lines.append(("assistant" if state == 3 else "user") + ":")
            continue
        _, role, text = rows[i]
        i += 1
        if letter == "K":
            state = step(state, role[:1])
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state = inserted(state)
            lines.append(("assistant" if state == 3 else "user") + ":" + text)
    initials = [r[1][:1] for r in rows]
    turns = {r[0] for r in rows if r[0] is not None}
    return {
        "gaps": (max(turns) - min(turns) + 1 - len(turns)) if turns else 0,
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def test_repair_equals_brute_force(spark):
    got = {r["conv_id"]: r.asDict() for r in cr.repair(spark.createDataFrame(CONVERSATIONS, CONV_SCHEMA)).collect()}
    expected = {conv: brute_repair(rows) for conv, rows in damaged_rows(CONVERSATIONS).items()}
    assert set(got) == set(expected)
    for conv, want in expected.items():
        assert {k: got[conv][k] for k in want} == want, conv


def test_repair_of_empty_and_fully_dropped(spark):
    assert cr.repair(spark.createDataFrame([], CONV_SCHEMA)).count() == 0
    dropped = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    conv, turn = dropped[0]
    row = cr.repair(spark.createDataFrame([(conv, turn, "user", "x.", "a", 1)], CONV_SCHEMA)).first()
    assert (row["cost"], row["audit"], row["gaps"], row["blank"]) == (0, "", 0, 0)
    assert row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_hirschberg_equals_whole_strings_on_long_runs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        rows = [cr.Row(str(rng.choice(list("suax"))), bool(rng.random() < 0.2), bool(rng.random() < 0.3),
                       int(rng.integers(1, 3))) for _ in range(int(rng.integers(40, 120)))]
        rows = [cr.Row(r.initial, r.forced, r.truncated and not r.forced, r.copies if r.forced else 1) for r in rows]
        split = cr.cheapest_audit(rows)
        whole = cr._direct(rows, 0, len(rows), cr.START, None)
        assert split == whole


# --- op12 ---

DOC_SCHEMA = "doc_id bigint, text string, n_a int, groups_sha256 string"
TEXTS = [
    (1, "Hello world, this is a test.", 0, "x"), (2, "Hello world, this is a test.", 0, "x"), (3, None, 0, "x"),
    (4, "", 0, "x"), (5, "Éa ßo x y <|endoftext|> don't 123", 0, "x"), (6, "  two  spaces\n\nnew", 0, "x"),
    (None, "日本語のテキスト and more", 0, "x"), (7, " ".join(f"w{i % 37}x" for i in range(3000)), 0, "x"),
    (1, "Hello world, this is a test.", 0, "x"),
]


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {c: i for i, c in enumerate(__import__("labelweave.llm.bpe_count", fromlist=["x"]).byte_letters())}
    per_doc = []
    for doc_id, text, *_ in texts:
        if not text:
            per_doc.append((doc_id, [], [], []))
            continue
        ta = a.encode(" " + text, add_special_tokens=False).ids
        tb = b.encode(text)
        ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ta]
        bb = []
        for i in tb:
            p = b.id_to_piece(i)
            bb.append(bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            per_doc.append((doc_id, [], [], []))
            continue
        ends_a = set(np.cumsum([len(x) for x in ba]).tolist())
        cuts = sorted(ends_a & set(np.cumsum([len(x) for x in bb]).tolist()))
        groups, pos_a, pos_b = [], 0, 0
        ia = ib = 0
        for cut in cuts:
            ga, gb = [], []
            while pos_a < cut:
                ga.append(ta[ia])
                pos_a += len(ba[ia])
                ia += 1
            while pos_b < cut:
                gb.append(tb[ib])
                pos_b += len(bb[ib])
                ib += 1
            groups.append((ga, gb))
        per_doc.append((doc_id, ta, tb, groups))
    counts = Counter()
    for _, _, _, groups in per_doc:
        counts.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, ta, tb, groups in per_doc:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        digest = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, len(ta), len(tb), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(digest.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_alignment_equals_brute_force(spark):
    import public_tokenizers

    df = token_alignment.alignment(
        spark.createDataFrame(TEXTS, DOC_SCHEMA), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got == brute_alignment(TEXTS)
    assert token_alignment.alignment(
        spark.createDataFrame([], DOC_SCHEMA), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    ).count() == 0


def test_interval_coalescing_breaks_only_where_both_end():
    a_group, b_group, n = token_alignment.groups_of(np.array([2, 3, 1, 4]), np.array([1, 4, 1, 1, 3]))
    assert n == 3 and a_group.tolist() == [0, 0, 1, 2] and b_group.tolist() == [0, 0, 1, 2, 2]


# --- op13 ---

LINE_SCHEMA = "doc_id bigint, text string, kept_sha256 string, n_lines int"
COMMON = "  Subscribe to our NEWSLETTER \t"


def line_docs():
    rows = [(i, f"Story {i}.\n{COMMON}\nbody {i % 3}\n\n", "x", 0) for i in range(12)]
    rows += [(100, "subscribe to our newsletter\nunique", "x", 0), (101, None, "x", 0), (102, "", "x", 0),
             (None, "a\n" * 3000 + "end", "x", 0), (5, f"Story 5.\n{COMMON}\nbody 2\n\n", "x", 0)]
    return rows


def brute_dedup(rows, min_docs=10):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(
            str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    split = [(d, (t or "").split("\n")) for d, t, *_ in rows]
    docs = Counter(k for _, lines in split for k in {key(x) for x in lines} if len(k) >= 1)
    out = []
    for d, lines in split:
        kept = [x for x in lines if not (len(key(x)) >= 1 and docs[key(x)] >= min_docs)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rows = line_docs()
    got = line_dedup.deduplicate(spark.createDataFrame(rows, LINE_SCHEMA))
    assert sorted((tuple(r[:4]) for r in got.collect()), key=str) == brute_dedup(rows)
    assert line_dedup.deduplicate(spark.createDataFrame([], LINE_SCHEMA)).count() == 0


def test_removing_documents_reverses_adding_them(spark):
    first = spark.createDataFrame(line_docs()[:9], LINE_SCHEMA)
    more = spark.createDataFrame(line_docs()[9:], LINE_SCHEMA)
    base = line_dedup.LineDedup.build(first)
    grown = base.add(more)
    assert grown.frequent().count() > base.frequent().count()
    back = grown.remove(more)
    assert sorted(back.counts.collect()) == sorted(base.counts.collect())
    keys = spark.createDataFrame([("subscribe to our newsletter",)], "key string").selectExpr(
        "key", "xxhash64(key) AS h", "xxhash64('line', key) AS g"
    )
    assert back.maybe_frequent(keys.selectExpr("0L AS _row", "0 AS pos", "key", "h", "g")).count() == 0
    assert grown.maybe_frequent(keys.selectExpr("0L AS _row", "0 AS pos", "key", "h", "g")).count() == 1


def test_cuckoo_filter_inserts_finds_and_deletes():
    rng = np.random.default_rng(0)
    hashes = rng.integers(-(2**63), 2**63 - 1, size=20_000, dtype=np.int64).view(np.uint64)
    table = line_dedup.new_filter(len(hashes))
    assert line_dedup.insert(table, hashes)
    assert line_dedup.contains(table, hashes).all()
    line_dedup.delete(table, hashes[:10_000])
    assert line_dedup.contains(table, hashes[10_000:]).all()
    others = rng.integers(-(2**63), 2**63 - 1, size=20_000, dtype=np.int64).view(np.uint64)
    assert line_dedup.contains(table, others).mean() < 0.01


def test_a_ids_equal_the_tokenizers_library_on_the_corpus(sf_dir):
    import pyarrow.parquet as pq
    import public_tokenizers
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    mine = token_alignment._models(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
    texts = [" " + (t or "") for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += [" <|endoftext|> a b  \t\n\n x's 'll 12345 😀"]
    assert [mine.encode_ordinary(t) for t in texts] == [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]


def test_alignment_columns_are_built_without_a_row_or_an_id_at_a_time(spark):
    """Texts reach Python as Arrow batches, and digests take the decimals of ids from a table."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, "x" * (i % 7) + f" naïve {i} ¼日本") for i in range(150)] + [(150, None), (151, "")]
    found = token_alignment.tokens(spark.createDataFrame(rows, "_row bigint, text string"), *paths)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    models = token_alignment._models(*paths)
    expected = dict(zip((r[0] for r in rows), token_alignment.align_batch([t for _, t in rows], models)))
    for r in found.collect():
        *plain, a, b, mult = expected[r._row]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256] == plain
        assert (r.pa, r.pb, r.pm) == (a.tolist(), b.tolist(), mult.tolist())


def test_digest_marks_groups_of_one_side():
    """A group without tokens of A begins with the mark of a group; ids of A come before those of B."""
    group = [np.array(x) for x in ([0, 0, 2], [0, 1, 1, 2])]
    counts = tuple(np.bincount(g, minlength=3) for g in group)
    got = token_alignment.digest(np.array([5, 7, 12]), np.array([1, 2, 3, 4]), *group, counts, token_alignment.digest_table(13))
    assert got == hashlib.sha256(b"5,7|1;2,3;12|4").hexdigest()
