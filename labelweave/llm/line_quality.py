"""Line-first cleaning: judge every line, drop the failures, then reject documents that lose too much text.

Everything is built-in column functions; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.shared import let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Line rules.
#: A line of prose ends in one of these, closing quotes and brackets aside.
TERMINAL = ".!?:;…。！？"
CLOSING = "\"')]}»”’"
#: Words that lead from page to page; a short line of nothing else is navigation.
NAVIGATION = (
    "home", "menu", "login", "logout", "sign in", "sign up", "register", "search", "contact", "contact us", "about",
    "about us", "help", "faq", "next", "previous", "back", "top", "share", "tweet", "print", "subscribe", "sitemap",
    "read more", "skip to content",
)
#: Phrases that mark a line as boilerplate wherever they stand.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "uses cookies", "accept cookies", "privacy policy", "terms of service",
    "terms of use", "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "powered by",
    "subscribe to our newsletter",
)


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII space; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def prose_end(line: Column) -> Column:
    """Does the line end in terminal punctuation, closing marks and spaces aside?"""
    bare = F.rtrim(line, F.lit(CLOSING + " \t\r\f\u000b"))
    return (bare != "") & (F.instr(F.lit(TERMINAL), F.right(bare, F.lit(1))) > 0)


def line_passes(line: Column, min_words: int = 3) -> Column:
    """Punctuation, navigation and boilerplate rules over one line that holds a word.

    A line ends as prose does, or has ``min_words`` words at least; symbols and exclamation marks, but one, number no more than
    three for ten words; it isn't made of navigation words between bars, arrows or bullets; and it holds no boilerplate
    phrase.
    """
    entry = "(?:" + "|".join(NAVIGATION) + ")"
    bar = r"[\s|>»•·/-]+"
    low = F.lower(line)
    navigation = low.rlike(f"^[\\s|>»•·/-]*{entry}(?:{bar}{entry})*[\\s|>»•·/-]*$")
    boilerplate = low.rlike("|".join(BOILERPLATE))
    long_enough = line.rlike(r"[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){%d}" % (min_words - 1))
    marks = F.length(line) - F.length(F.translate(line, SYMBOLS + "!", ""))
    spaces = F.length(line) - F.length(F.translate(line, " ", ""))
    quiet = 10 * (marks - 1) <= 3 * (spaces + 1)
    return (F.length(line) > 0) & (prose_end(line) | long_enough) & quiet & ~navigation & ~boilerplate


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def kept_lines(lines: Column) -> Column:
    """Lines that pass, in order. Blank lines go with them: they carry no text."""
    return F.filter(lines, lambda line: line_passes(line))


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the list, the first window included.

    A window's number is its hash with its position in the low bits, so one sort of longs brings equal windows together.
    Windows whose hashes meet are compared by their words, so a hash that two windows share by chance counts nothing.
    The list is bound once: each position looks into it, and would otherwise make it anew where a filter is pushed down.
    """
    return let(words, _repeated_window_words)


def _repeated_window_words(words: Column) -> Column:
    def window(p: Column) -> Column:
        return F.array(F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda p: F.xxhash64(F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)))

    def suspects(hashed: Column) -> Column:
        """Positions whose hash, but for the bits that the position takes, occurs twice."""
        bits = F.length(F.bin(F.size(hashed).cast("long")))
        return let(
            bits,
            lambda b: let(
                F.array_sort(
                    F.transform(
                        hashed,
                        lambda h, i: F.call_function("shiftleft", h, b).bitwiseOR(i.cast("long")),
                    )
                ),
                lambda keys: F.transform(
                    F.filter(
                        keys,
                        lambda k, i: (
                            F.call_function("shiftright", k, b) == F.call_function("shiftright", F.get(keys, i - 1), b)
                        )
                        | (F.call_function("shiftright", k, b) == F.call_function("shiftright", F.get(keys, i + 1), b)),
                    ),
                    lambda k: (k - F.call_function("shiftleft", F.call_function("shiftright", k, b), b)).cast("int"),
                ),
            ),
        )

    def confirmed(positions: Column) -> Column:
        return let(
            F.array_sort(F.transform(positions, lambda p: F.struct(window(p).alias("w"), p.alias("p")))),
            lambda rows: F.transform(
                F.filter(
                    rows,
                    lambda r, i: F.coalesce(r["w"] == F.get(rows, i - 1)["w"], F.lit(False))
                    | F.coalesce(r["w"] == F.get(rows, i + 1)["w"], F.lit(False)),
                ),
                lambda r: r["p"],
            ),
        )

    def covered(positions: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))

    counted = let(
        hashes,
        lambda hashed: F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), 0).otherwise(
            covered(confirmed(suspects(hashed)))
        ),
    )
    return F.when(F.size(words) < 4, 0).otherwise(counted).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as ``row`` with a struct ``q`` of figures and the cleaned text; one row per row, no name can clash."""
    start = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[text].alias("text"), words_of(docs[text]).alias("words"), lines_of(docs[text]).alias("lines"),
    )
    worded = start.withColumn("full", F.filter("lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).withColumn(
        "passed", kept_lines(F.col("lines"))
    )

    def chars(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda total, line: total + F.length(line))

    clean = F.array_join("passed", "\n")
    text = F.coalesce(F.col("text"), F.lit(""))
    return worded.select(
        "row",
        F.struct(
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
            repeated_window_words(F.col("words")).alias("n_repeat_words"),
            F.size("full").cast("long").alias("n_lines"),
            F.size("passed").cast("long").alias("n_lines_kept"),
            chars(F.col("full")).alias("line_chars"),
            chars(F.col("passed")).alias("kept_chars"),
            clean.alias("clean_text"),
        ).alias("q"),
    )


def judged(docs: DataFrame, min_kept: int = 50, text: str = "text") -> DataFrame:
    """``measured`` with base_failed and kept added to the struct."""
    q = F.col("q")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    enough = 100 * q["kept_chars"] >= min_kept * q["line_chars"]
    return measured(docs, text).withColumn(
        "q", q.withField("base_failed", failed).withField("kept", ~failed & enough)
    )


def score_lines(docs: DataFrame, min_kept: int = 50) -> DataFrame:
    """Figures and verdict of every document, one row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines, n_lines_kept, line_chars, kept_chars.

    A document is kept if it has 50 words or more, no more than half of its words lie in repeated 3-word windows, and
    the lines that pass hold at least ``min_kept`` percent of the characters of its lines. Null and empty texts have no
    words and are rejected. Texts of any length are judged whole. Null ids and repeated rows pass through.
    """
    names = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_lines_kept", "line_chars", "kept_chars",
    )
    return judged(docs, min_kept).select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"q.{n}") for n in names])


def clean_documents(docs: DataFrame, min_kept: int = 50) -> DataFrame:
    """Documents that are kept, with the columns of ``docs``: failing lines are gone from ``text``, ``n_chars`` follows.

    Rules as in ``score_lines``. An ``n_chars`` column is optional.
    """
    # Not a filter on the verdict, which would be pushed down and evaluate the rules once more: a generator of one row or
    # none, in its outer form, because the inner one adds such a filter as well.
    found = F.filter(F.array(F.struct("row", "q")), lambda r: r["q"]["kept"])
    kept = judged(docs, min_kept).select(F.explode_outer(found).alias("found")).filter("found is not null")
    fresh = {"text": F.col("found.q.clean_text"), "n_chars": F.length("found.q.clean_text")}
    types = dict(docs.dtypes)
    return kept.select(
        *[(fresh[c].cast(types[c]) if c in fresh else F.col("found.row")[c]).alias(c) for c in docs.columns]
    )
