"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelweave.llm import (
    bpe_count, byte_cnn, class_lm, line_quality, nb_linear, order_join, phrase_index, raking, url_reputation, warc,
)
from labelweave.llm.components import components
from labelweave.llm.counts import pieces_of
from labelweave.llm.shared import arrow_rows, stored

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENGLISH = "the cat sat on the mat and the dog ran to the park with a red ball that it had found."
LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(30_000))
TEXTS = {
    1: ENGLISH, 2: ENGLISH, 3: ENGLISH + " Then it slept.", 4: None, 5: "", 6: " \n\t ", 7: "short text", 8: LONG,
    9: LONG + " tail", 10: "a b c d e a b c d e a b c d e", 11: "Éa ßo\u00a0x\u2003y <|endoftext|> don't 123", 12: "!!! ??? 42",
}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, word string, kept string, block int"


def rows(texts):
    return [(i, t, "en", "s", 0, 7, "w", "k", 3) for i, t in texts.items()]


@pytest.fixture(scope="module")
def docs(spark):
    """Clashing names, a null id and a repeated row included."""
    return spark.createDataFrame(rows(TEXTS) + rows({None: ENGLISH, 7: "short text"}), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(text):
    return SPACE_WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# WARC


def test_archives_round_trip(spark):
    big = "ä" * 9_000_000  # more than 16 MiB in UTF-8
    html = {1: "<p>a</p>", 2: "<p>b</p>\r\n\r\nWARC/1.1\r\n", 3: "<p>a</p>", 4: None, 5: "", 6: big, 7: big, 8: "<p>a</p>"}
    pages = spark.createDataFrame(
        [(i, None if i == 3 else f"http://x.y/{i} z\n", h, "clash") for i, h in html.items()],
        "page_id bigint, url string, html string, payload_digest string",
    )
    found = by_id(warc.deduplicated(pages), "page_id")
    first = {}
    for i, h in html.items():
        payload = (h or "").encode()
        original = first.setdefault(payload, i)
        row = found[i]
        assert row.payload_bytes == len(payload)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert row.record_type == ("response" if original == i else "revisit")
        assert row.refers_to == (None if original == i else original)
    assert {r.record_type for r in warc.deduplicated(pages, min_bytes=10**9).collect()} == {"response"}


def test_archives_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.deduplicated(none).count() == 0


# Lines


def window_words(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:]))
    seen = Counter(windows)
    return len({i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(3)})


def test_line_figures(docs, empty):
    for row in line_quality.score_lines(docs).collect():
        text = TEXTS[row.doc_id] if row.doc_id else ENGLISH
        w = words(text)
        full = [x for x in (text or "").split("\n") if words(x)]
        assert (row.n_words, row.word_chars) == (len(w), sum(map(len, w)))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert row.n_dup_lines == len(full) - len(set(full))
        assert row.n_repeat_words == window_words(text)
        assert row.base_failed == (len(w) < 50 or 100 * row.n_repeat_words > 50 * len(w))
        assert not (row.kept and row.base_failed)
    assert line_quality.score_lines(empty).count() == 0


def test_line_rules(spark):
    lines = {
        "A sentence.": True, "three words here": True, "two words": False, "Home | About | Contact": False,
        "We say: all rights reserved.": False, "a### b### c### d.": False, "He said \"yes!\"": True, "": False,
        "Home is where the heart is.": True,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    got = {r.line: r.ok for r in df.select("line", line_quality.line_passes(F.col("line")).alias("ok")).collect()}
    assert got == lines


def test_cleaned_documents_keep_columns(spark):
    good = " ".join(f"w{i}" for i in range(60)) + "."
    texts = {1: good + "\nHome | Menu\n" + good[::-1], 2: "x | y | z |\n" * 40, 3: None}
    df = spark.createDataFrame(rows(texts), SCHEMA)
    out = line_quality.clean_documents(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    kept = out.collect()
    assert [r.doc_id for r in kept] == [1]
    assert "Menu" not in kept[0].text and kept[0].n_chars == len(kept[0].text)


# Class model


def test_base_scores_and_counts(docs, empty):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in TEXTS} | {None: False}
    every = [(i, t) for i, t in TEXTS.items()] + [(None, ENGLISH), (7, "short text")]
    tokens = lambda t: words(low(t)) + ["\n"]
    counts = Counter(w for i, t in every if not held[i] for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    found = class_lm.score_texts(docs).collect()
    assert len(found) == len(every)
    for row in found:
        own = tokens(TEXTS[row.doc_id] if row.doc_id else ENGLISH)
        want = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (row.n_tokens, row.train_tokens, row.held_out) == (len(own), total, held[row.doc_id])
        assert row.n_known == sum(counts[w] > 0 for w in own)
        assert row.base_score == pytest.approx(want, abs=1e-6)
        assert row.score < 0 and row.perplexity > 1
    assert class_lm.score_texts(empty).count() == 0


def test_word_counts_leave_a_task_in_bounded_parts():
    texts = [" ".join(f"w{i % 7}x{k}" for k in range(20_000)) for i in range(70)]
    schema = {"block": pa.array([0] * 10, pa.int32()), "train": pa.array([True] * 10)}
    batches = [pa.RecordBatch.from_pydict(schema | {"text": texts[i : i + 10]}) for i in range(0, 70, 10)]
    parts = list(class_lm._word_counts(np.zeros(0))(iter(batches)))
    assert len(parts) > 1
    total = Counter()
    for part in parts:
        for word, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            total[word] += n
    assert total == Counter(w for t in texts for w in t.encode().split() + [b"\n"])


def likelihood(pairs, own):
    member = np.eye(own.max() + 1)[own]
    table = member.T @ pairs @ member
    f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def test_exchange_climbs_to_a_local_optimum():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 6, (13, 13)).astype(float)
    own = class_lm.exchange(pairs, classes=3, sweeps=50)
    best = likelihood(pairs, own)
    for w in range(12):
        for c in range(3):
            other = own.copy()
            other[w] = c
            assert likelihood(pairs, other) <= best + 1e-6
    assert own[-1] == 3 and (own[:-1] < 3).all()


def test_best_class_of_a_word_is_that_of_the_largest_likelihood():
    rng = np.random.default_rng(1)
    n, end = 60, class_lm.CLASSES
    pairs = rng.integers(0, 4, (n, n)).astype(float)
    own = np.append(rng.integers(0, end, n - 1), end)
    member, word = np.eye(end + 1)[own], np.arange(n - 1)
    right, left, same = pairs[word] @ member, pairs[:, word].T @ member, pairs[word, word]
    right[word, own[word]] -= same
    left[word, own[word]] -= same
    best = class_lm.best_classes(member.T @ pairs @ member, own[word], right, left, same)
    assert (best != own[word]).any()
    for w in word:
        every = []
        for c in range(end):
            other = own.copy()
            other[w] = c
            every.append(likelihood(pairs, other))
        assert every[best[w]] == pytest.approx(max(every), abs=1e-5)


def test_words_of_one_bin_take_classes_of_their_own(spark):
    """The whole model, counted by word; words of the tail end alike, so all of them are one object of the first exchange."""
    rng = np.random.default_rng(2)
    tail = [f"t{i}ing" for i in range(60)]
    texts = {}
    for i in range(60):  # even and odd words take turns; six words of the tail are used like odd ones
        odd = [f"f{k * 2 + 1}" for k in rng.permutation(400)] + tail[:6]
        texts[i] = " ".join(f"f{a * 2} {odd[k]}" for a, k in zip(rng.permutation(400), rng.permutation(406)))
    for i in range(60, 140):
        texts[i] = " ".join(f"f0 {w} {f'{w} ' if i % 5 == 0 else ''}f2" for w in rng.choice(tail[6:], 8))
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(7)
    learns = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    tokens = {i: texts[i].encode().split() + [class_lm.END] for i in texts}
    counts = Counter(w for i in learns for w in tokens[i])
    core = sorted(set(counts) - {class_lm.END}, key=lambda w: (-counts[w], w))[: class_lm.CORE]
    names = [class_lm.END, *sorted(set(counts) - {class_lm.END})]
    number = {w: k for k, w in enumerate(names)}
    by_word = np.zeros((len(names), len(names)))
    for i in learns:
        for a, b in zip([class_lm.END, *tokens[i]], tokens[i]):
            by_word[number[a], number[b]] += 1
    objects = np.eye(class_lm.OBJECTS)[class_lm._objects(core, names)]
    start = class_lm.exchange(objects.T @ by_word @ objects)
    own = start[class_lm._objects(core, names)]
    member = np.eye(class_lm.CLASSES + 1)[own]
    rest = np.array([k for k, w in enumerate(names) if w not in core and w != class_lm.END])
    same = by_word[rest, rest]
    right, left = by_word[rest] @ member, by_word[:, rest].T @ member
    right[np.arange(len(rest)), own[rest]] -= same
    left[np.arange(len(rest)), own[rest]] -= same
    learned = [number[w.encode()] for w in tail if w.encode() in number and w.encode() not in core]
    assert set(learned) <= set(rest.tolist()) and same.any() and len(set(own[learned].tolist())) == 1
    own[rest] = class_lm.best_classes(member.T @ by_word @ member, own[rest], right, left, same)
    assert len(set(own[learned].tolist())) > 1
    member = np.eye(class_lm.CLASSES + 1)[own]
    pairs = member.T @ by_word @ member
    steps = np.log10((pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True))
    mass = pairs.sum(axis=0) + 0.1 * (member.sum(axis=0) + 1)
    model = dict(zip(names, own.tolist()))
    unknown = lambda w: start[class_lm._objects(core, [w])[0]]
    for row in class_lm.score_texts(df).collect():
        want, before = 0.0, class_lm.CLASSES
        for w in tokens[row.doc_id]:
            c = model[w] if w in model else unknown(w)
            want += steps[before, c] + (0 if w == class_lm.END else np.log10((counts[w] + 0.1) / mass[c]))
            before = c
        assert row.score == pytest.approx(want, abs=1e-6)


def test_rows_of_a_word_meet_across_batches_and_chunks():
    often = class_lm.OFTEN * 2 + 5
    chunks = [
        {"chunk": i, "held_out": [False, True], "size": [2 * often + 1, 2], "word": [b"core", b"tail", class_lm.END],
         "n": [often, often, 1], "slots": class_lm._packed(np.array([0, 1] * often + [2, 1, 2], np.int32))}
        for i in range(5)
    ]
    batch = pa.RecordBatch.from_pylist(chunks)
    own = np.zeros(class_lm.OBJECTS, np.int64)
    own[-1] = class_lm.CLASSES
    found = pa.Table.from_batches(class_lm._contexts([b"core"], own)(iter([batch]))).sort_by("word")
    table = np.zeros((class_lm.CLASSES + 1,) * 2)
    table[0, 0], table[-1, 0], table[0, -1] = 5 * (2 * often - 1), 5, 5
    counted = [(w, n) for w, n in ((b"core", 5 * often), (b"tail", 5 * often), (class_lm.END, 5)) for _ in range(5)]
    for rows_at_once in (1, 2, 4, 100):
        done = list(class_lm._numbered([b"core"], own, table)(iter(found.to_batches(max_chunksize=rows_at_once))))
        done = pa.Table.from_batches(done).to_pylist()
        words = [chunks[0]["word"][r["slot"]] for r in done]
        assert sorted((w, r["c"]) for w, r in zip(words, done)) == sorted(counted)
        assert {w: r["class"] for w, r in zip(words, done)} == {b"core": 0, b"tail": 1, class_lm.END: class_lm.CLASSES}
        assert sorted(w for w, r in zip(words, done) if r["lead"]) == [b"core", b"tail"]


# URLs


def test_rules_and_hosts(spark):
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    urls = {
        "http://A.Example.net/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.net/": ("a.net", "/", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"),
        "http://xnet/": ("xnet", "/", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "x://b.org/fr/#z": ("b.org", "/fr/", "org/fr/", "allow"), "s://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([], "page_id bigint, bad boolean")
    found = by_id(url_reputation.judge_urls(pages, labels, rules), "page_id")
    for i, want in enumerate(urls.values()):
        assert tuple(found[i])[1:5] == want


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame(
        [(i, f"http://{'bad' if i < 60 else 'h%d' % (i % 20)}.co.uk/", None) for i in range(400)] + [(None, None, None)],
        "page_id bigint, url string, html string",
    )
    labels = spark.createDataFrame([(i, i < 60 or i % 7 == 0) for i in range(300)] + [(None, True), (5, None)], "page_id bigint, bad boolean")
    found = url_reputation.judge_urls(pages, labels).collect()
    assert {r.host for r in found if r.verdict == "block"} == {"bad.co.uk"}
    bounds = {r.host: r.bad_bound for r in found}
    assert 0 < bounds["bad.co.uk"] < 1 and len(found) == 401


# Language


def test_language_is_learned_and_held_out(spark):
    english, german = "the and of to in that it is was for on with as be at by this had not", "der die und das nicht ist ein ich zu sie mit für auf über schön"
    rng = np.random.default_rng(0)
    data = [(i, " ".join(rng.choice((english if i % 2 else german).split(), 60)), "en" if i % 2 else "de", "s") for i in range(240)]
    data += [(900, None, "en", "s"), (901, "12 !", "de", "s"), (None, data[1][1], None, "s")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, score string")
    found = {r.doc_id: r for r in byte_cnn.identify(df).collect()}
    held = [i for i, *_ in data[:240] if found[i].held_out]
    assert held and np.mean([found[i].lang_pred == ("en" if i % 2 else "de") for i in held]) > 0.95
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[None].lang_pred == "en"
    assert byte_cnn.identify(df.limit(0)).count() == 0


# Tokens


def test_counts_are_those_of_the_library(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        model = file.read()
    library = Tokenizer.from_file(path)
    counter = bpe_count.counter_of(model)
    for text in ["aaaaaaaaaaaa", "x" * 5000, "<|endoftext|>a<|endoftext|>", "a  b \n\n c", "🙂🙃", "don't'S"]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    for row in bpe_count.count_tokens(docs, model).collect():
        text = (TEXTS[row.doc_id] if row.doc_id else ENGLISH) or ""
        assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert row.n_bytes == len(text.encode()) and row.over_limit == (row.n_tokens > 512)
    assert bpe_count.count_tokens(empty, model).count() == 0


# Toxicity


def test_toxicity_is_learned_and_held_out(spark):
    rng = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(200)]
    data, labels = [], []
    for i in range(300):
        text = list(rng.choice(plain, 80))
        if i % 4 == 0:
            text[5] = text[40] = rng.choice(["nastyone", "awfulest"])
        data.append((i, " ".join(text), "x"))
        labels.append((i, int(i % 4 == 0), None))
    data += [(1000, None, "x"), (1001, "", "x"), (None, "nastyone", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, predicted string")
    marks = spark.createDataFrame(labels + [(2000, 1, 1), (None, 1, 1)], "doc_id bigint, toxic int, quality int")
    found = {r.doc_id: r for r in nb_linear.score_toxicity(df, marks).collect()}
    held = [i for i in range(300) if found[i].held_out]
    assert held and all(found[i].predicted == (i % 4 == 0) for i in held)
    assert found[1000].score == found[1001].score and found[1000].predicted == 0
    kept = nb_linear.without_toxic(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.predicted}
    assert nb_linear.score_toxicity(df.limit(0), marks.limit(0)).count() == 0


# Benchmark passages


def phrase_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


@pytest.mark.parametrize("pass_words", [2_000_000, 15])
def test_passages(spark, monkeypatch, pass_words):
    monkeypatch.setattr(phrase_index, "PASS_WORDS", pass_words)
    item = " ".join(f"t{i}" for i in range(14))
    items = {10: item, 9: "One, two THREE", 8: None, 7: "", 100: "the cat sat on the mat and the dog ran to"}
    texts = {
        1: "x " + item + " y", 2: item.replace("t7", "other"), 3: "one two three one-two_three", 4: None, 5: "", 6: ENGLISH,
        7: "t0 t1 t2 t3 t4 t5 t6 t7 t8", 8: item + " " + item, 9: " ".join(reversed(item.split())),
    }
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    df = spark.createDataFrame(rows(texts), SCHEMA)
    windows = {}
    for i, t in items.items():
        w = phrase_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    found = by_id(phrase_index.contamination(df, bench))
    for i, t in texts.items():
        w, hit, own = phrase_words(t), set(), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    own |= owners
        digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        assert tuple(found[i])[:6] == (i, len(w), len(hit), len(own), digest, bool(hit))
    assert found[9].n_near_items == 1 and not found[9].contaminated  # all words near, but in another order
    left = phrase_index.without_contaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {2, 4, 5, 7, 9}
    assert phrase_index.contamination(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in phrase_index.contamination(df, bench.limit(0)).collect())


# Near duplicates


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sets, label


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    texts = dict(TEXTS)
    common = [f"shared{i}" for i in range(50)]
    for g in range(8):
        base = [f"g{g}w{rng.integers(40)}" for _ in range(60)] + common
        for k in range(7):
            copy = list(base)
            for at in rng.integers(0, len(base), k):
                copy[at] = f"new{rng.integers(10**6)}"
            texts[100 + 10 * g + k] = " ".join(copy)
    chain = [f"c{i}" for i in range(120)]
    for k in range(12):  # neighbours are similar, ends are not
        texts[300 + k] = " ".join(chain[k * 4 : k * 4 + 64])
    df = spark.createDataFrame(rows(texts) + rows({7: "short text", None: ENGLISH}), SCHEMA)
    sets, label = brute_components(texts)
    found = order_join.linked(df).collect()
    assert len(found) == len(texts) + 2
    for row in found:
        if row.doc_id is not None:
            assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), label[row.doc_id])
    kept = order_join.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(label.values())) and ids.count(None) == 1
    assert order_join.linked(df.limit(0)).count() == 0


def test_somewhat_common_tokens_come_late(spark):
    total = np.random.default_rng(1).poisson(20, order_join.CELLS)
    total[77] = 45  # a token of 25 documents, within chance of the mean load
    pieces = pieces_of(total).to_pylist()
    profile = spark.createDataFrame([(1, r["piece"], bytearray(r["counts"])) for r in pieces], "kind int, piece int, counts binary")
    level = order_join.levels(profile)
    assert level[77] > np.quantile(level, 0.999)


def test_prefixes_leave_in_bounded_batches_and_texts_come_in_few_at_a_time(spark, monkeypatch):
    class Level:
        value = np.zeros(order_join.CELLS, np.uint16)

    texts = [" ".join(f"d{i}w{k}" for k in range(1_000)) for i in range(1_500)]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(texts)), pa.int64()), "text": texts})
    made = list(order_join._prefixes(Level)(iter([batch])))
    assert len(made) > 1 and max(b.num_rows for b in made) < order_join.HELD_TOKENS + 2 * 1_000
    assert sorted(set(d for b in made for d in b.column(1).to_pylist())) == list(range(len(texts)))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, inner = [], order_join._linked
    monkeypatch.setattr(order_join, "_linked", lambda docs: seen.append(spark.conf.get(key)) or inner(docs))
    before = spark.conf.get(key)
    order_join.linked(spark.createDataFrame(rows(TEXTS), SCHEMA))
    assert seen == [str(order_join.BATCH_ROWS)] and spark.conf.get(key) == before
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)
    with arrow_rows(spark, 300):
        assert max(r.n for r in spark.range(2_000).mapInArrow(sizes, "n bigint").collect()) <= 300


def test_a_group_of_unlike_documents_writes_no_pairs(spark, monkeypatch):
    passage = [f"shared{i}" for i in range(100)]
    texts = {i: " ".join(passage + [f"own{i}x{k}" for k in range(18)]) for i in range(1, 61)}
    texts |= {1000 + i: texts[i] + " tail" for i in range(1, 6)}
    met = []
    plausible = order_join.plausible
    monkeypatch.setattr(order_join, "plausible", lambda pairs, sizes: met.append(pairs.count()) or plausible(pairs, sizes))
    found = order_join.linked(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(texts)[1]
    assert sum(met) <= 3 * len(texts)


def test_large_unlike_documents_write_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    passages = [" ".join(f"p{i}w{k}" for k in range(300)) for i in range(12)]
    texts = {i: " ".join(passages[p] for p in rng.choice(12, 5, replace=False)) for i in range(1, 61)}
    for i, size in enumerate((310, 380, 386, 470, 1230, 1500, 1533, 1545, 1840)):  # near the sizes where depths change
        words = [f"s{i}w{k}" for k in range(size + 4)]
        texts[2000 + 10 * i] = " ".join(words)
        texts[2001 + 10 * i] = " ".join(words + [f"t{i}w{k}" for k in range(size // 4)])  # 80 percent exactly or a little more
        texts[2002 + 10 * i] = " ".join(words + [f"u{i}w{k}" for k in range(size // 4 + 1)])  # a little less
    met = []
    plausible = order_join.plausible
    monkeypatch.setattr(order_join, "plausible", lambda pairs, sizes: met.append(pairs.count()) or plausible(pairs, sizes))
    found = order_join.linked(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    label = brute_components(texts)[1]
    assert {r.doc_id: r.component_id for r in found} == label
    assert label[2001] == 2000 and label[2002] == 2002
    assert sum(met) <= 2 * len(texts), met


def test_parts_keep_marks_and_prefixes_of_similar_sets():
    rng = np.random.default_rng(9)
    for n in (1, 5, 300, 384, 385, 1537, 7000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a, rng.integers(0, 2**64, n // 4, dtype=np.uint64))))
        for x, y in ((a, b), (a, a[len(a) // 5 :])):
            if not order_join.similar(x, y):
                continue
            both = [{(t, p): s for t, p, s in zip(*map(np.ndarray.tolist, order_join.part_prefixes(v, v, d)))}
                    for v in (x, y) for d in order_join.depths(len(v))]
            met = [set(p) & set(q) for p in both[: len(order_join.depths(len(x)))] for q in both[len(order_join.depths(len(x))) :]]
            marks = [{p: (n, m) for p, n, m in zip(c[0].tolist(), c[1].tolist(), c[2])} for c in map(order_join.part_marks, (x, y))]
            odd = lambda p: sum(int(i).bit_count() for i in (marks[0][p][1] ^ marks[1][p][1]).view(np.uint64))
            assert any(180 * odd(p) <= 20 * (marks[0][p][0] + marks[1][p][0]) for shared in met for _, p in shared)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (102, 101)], "a bigint, b bigint")
    assert {r.doc: r.comp for r in components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# Mixture


def test_margins_are_met_either_way(spark):
    rng = np.random.default_rng(2)
    data = [
        (i, " ".join(["w"] * int(rng.integers(1, 50))), f"s{min(rng.integers(6), 2)}", None if i % 9 == 0 else f"l{i % 3}", "x")
        for i in range(300)
    ] + [(900, None, "s0", "l1", "x"), (None, "a b", "s1", "l1", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string, weight string")
    topics = spark.createDataFrame([(i, i % 4) for i in range(200)] + [(3, 9), (None, 1)], "doc_id bigint, topic int")
    here = raking.mixture(df, topics).toPandas()
    there = raking.mixture(df, topics, local_cells=0).toPandas()
    for column in ("weight", "probability"):
        a, b = (x.sort_values("doc_id")[column].to_numpy() for x in (here, there))
        assert np.allclose(a, b, atol=1e-8)
    here["mass"] = here.weight * here.n_tokens
    for margin in raking.MARGINS:
        sums = here.groupby(margin)[["n_tokens", "mass"]].sum()
        want = sums.n_tokens**0.7 / (sums.n_tokens**0.7).sum() * sums.n_tokens.sum()
        assert np.allclose(sums.mass, want, rtol=1e-3)
    assert not here[here.doc_id.isna()].sampled.any()
    assert set(here[here.probability == 1].sampled) <= {True, False}
    assert {r.doc_id for r in raking.sampled(df, topics).collect()} == set(here[here.sampled].doc_id.astype(int))
    assert raking.mixture(df.limit(0), topics).count() == 0


def test_few_taken_ids_leave_texts_unshuffled(spark):
    df = spark.createDataFrame([(i, f"a b {i}", "s", "l") for i in range(40)], "doc_id bigint, text string, source string, lang string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = raking.sampled(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_expected_tokens_meet_margins_under_the_bound(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(1200):
        source, lang = f"s{min(int(rng.geometric(0.6)), 4)}", f"l{min(int(rng.geometric(0.7)), 3)}"
        data.append((i, " ".join(["w"] * int(rng.integers(1, 40))), source, lang))
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string")
    mixed = stored(raking.mixture(df), "mixed")
    cells = mixed.select(*raking.MARGINS, "weight").distinct()
    assert cells.filter("weight * 0.5 > 1").count() > 0  # the bound binds
    sums = raking.reached(mixed).toPandas()
    assert mixed.filter("probability > 1").isEmpty()
    assert (sums.aim <= sums.tokens).all() and np.allclose(sums.expected, sums.aim, rtol=1e-3)
    table_fit = stored(raking.mixture(df, local_cells=0), "mixed").toPandas().sort_values("doc_id")
    assert np.allclose(table_fit.probability, mixed.toPandas().sort_values("doc_id").probability, atol=1e-8)


def test_what_a_rare_value_lacks_goes_to_the_others(spark):
    data = [(i, " ".join(["w"] * 20), "rare" if i < 2 else f"s{i % 2}", "l") for i in range(2000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string")
    sums = raking.reached(raking.mixture(df)).filter("margin = 'source'").toPandas().set_index("value")
    assert sums.aim["rare"] > sums.tokens["rare"] == sums.expected["rare"]
    assert np.isclose(sums.expected.sum(), 0.5 * sums.tokens.sum(), rtol=1e-6)


def test_rare_toxic_words_are_learned(spark):
    """Words of a few toxic documents each, fewer than stand out by four standard errors."""
    rng = np.random.default_rng(6)
    plain, insults = [f"word{i}" for i in range(200)], ["nastyone", "awfulest", "rottenly", "vilemost", "horridly", "grimmish"]
    data, labels = [], []
    for i in range(400):
        text = list(rng.choice(plain, 40))
        if i % 5 == 0:
            text[5] = text[20] = insults[i // 5 % len(insults)]
        data.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    found = nb_linear.score_toxicity(
        spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    ).filter("held_out").collect()
    toxic = [r.predicted for r in found if r.doc_id % 5 == 0]
    assert len(toxic) > 10 and np.mean(toxic) > 0.8
    assert not any(r.predicted for r in found if r.doc_id % 5)


def test_warc_repeated_page_ids_keep_their_own_payloads(spark):
    rows = [(1, "u", "AAAA"), (2, "u", "BB"), (5, "u", "AAAA"), (5, "u", "BB"), (6, "u", "unique"), (6, "u", "AAAA"),
            (None, "u", "AAAA")]
    got = sorted(
        (r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to)
        for r in warc.deduplicated(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    )
    assert got == [
        (False, 1, 4, "response", None), (False, 2, 2, "response", None), (False, 5, 2, "revisit", 2),
        (False, 5, 4, "revisit", 1), (False, 6, 4, "revisit", 1), (False, 6, 6, "response", None),
        (True, 0, 4, "response", None),
    ]


@pytest.mark.parametrize("pass_words", [2_000_000, 12])
def test_passages_keep_rows_with_repeated_or_null_ids(spark, monkeypatch, pass_words):
    monkeypatch.setattr(phrase_index, "PASS_WORDS", pass_words)
    item = " ".join(f"t{i}" for i in range(10))
    other = " ".join(f"u{i}" for i in range(10))
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, item), (1, other + " " + item), (None, item), (None, "clean text"), (3, "nothing")], "doc_id bigint, text string"
    )
    got = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_items) for r in phrase_index.contamination(docs, bench).collect()
    )
    assert got == [(False, 1, 1), (False, 1, 2), (False, 3, 0), (True, 0, 0), (True, 0, 1)]


def test_languages_beyond_the_bound_teach_nothing(spark, monkeypatch):
    monkeypatch.setattr(byte_cnn, "LANGUAGES", 2)
    words = {"en": "the cat and the dog ", "de": "der hund und die katze ", "fr": "le chat et le chien "}
    rows = [(i, (words[lang] * 5).strip(), lang, "s", 0) for i, lang in enumerate(["en"] * 30 + ["de"] * 20 + ["fr"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r.lang_pred for r in byte_cnn.identify(docs).collect()}
    assert found <= {"en", "de"}


def test_fitted_cells_start_no_python_workers(spark):
    """Weights fitted on the driver come back as an Arrow table, not by an RDD of pickled rows."""
    docs = spark.createDataFrame(
        [(i, "a b c", f"s{i % 3}", "en") for i in range(9)], "doc_id bigint, text string, source string, lang string"
    )
    cells = docs.groupBy("source", "lang").agg(F.count("*").alias("tokens")).withColumn("topic", F.lit("none"))
    targets = {m: raking.tempered(cells, m, 0.7) for m in raking.MARGINS}
    for found in (raking.raked_here(cells, targets), raking.bounded_here(cells, raking.reachable(cells, targets, 4.0))):
        assert "RDD" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.columns[:3] == list(raking.MARGINS) and found.count() == 3


def test_toxicity_scores_hold_one_text_at_a_time():
    """A batch of texts isn't held as Python strings beside its Arrow buffer."""
    import tracemalloc

    model = nb_linear.NaiveBayesLinear(np.zeros(1 << nb_linear.BITS, np.float32), 0.0)
    texts = pa.array(["word " * 800 + str(i) for i in range(600)] + [None, ""])
    tracemalloc.start()
    scores = model.scores(text.as_py() for text in texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scores.tolist() == [0.5] * len(texts) and peak < 1 << 20
