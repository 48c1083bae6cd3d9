"""Text cleaning and text scalars as Column expressions (no Python in the executors)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelweave.functions.vocab import KEEP_WORDS, MAX_WORDS, NOISE_WORDS

# Every code point that counts as white space, as a regular-expression class that the JVM and RE2 both accept.
SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same set as plain characters, for trimming.
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

RUN = SPACE.replace("[", "[^", 1)
URL_RUN = rf"http{RUN}+|www{RUN}+"
# Tied to the start of a run, so that a long run without "@" is scanned once and not once per character.
EMAIL_RUN = rf"(^|{SPACE}){RUN}+@{RUN}+"
# One character of a word. The plain letters are listed first because they are the quickest to test.
WORD = r"[a-z0-9_\p{L}\p{N}-]"
# Decimal digits plus the superscripts, subscripts and enclosed figures that count as digits.
DIGIT = (
    r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)


def without_addresses(text: Column) -> Column:
    """Lower case, without URLs and e-mail-like runs.

    The two patterns are only tried on texts that hold their first characters.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    may_have_url = F.contains(lower, F.lit("http")) | F.contains(lower, F.lit("www"))
    no_urls = F.when(may_have_url, F.regexp_replace(lower, URL_RUN, "")).otherwise(lower)
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(no_urls, EMAIL_RUN, "$1")).otherwise(no_urls)


def raw_words(text: Column) -> Column:
    """All words, nothing filtered; white space and symbols separate them."""
    return F.regexp_extract_all(without_addresses(text), F.lit(f"{WORD}+"), F.lit(0))


def _word_pattern(keep: Sequence[str], min_length: int) -> str:
    """Whole words that are long enough and hold a digit or letters only, and the kept words those rules would miss."""
    general = re.compile(rf"[^\W\d_]{{{min_length},}}")
    others = [re.escape(word) for word in keep if not general.fullmatch(word)]
    shapes = [rf"[a-z\p{{L}}]{{{min_length},}}", rf"(?={WORD}*{DIGIT}){WORD}{{{min_length},}}", *others]
    return rf"(?<!{WORD})(?:{'|'.join(shapes)})(?!{WORD})"


def clean_words(
    text: Column,
    max_words: int | None = MAX_WORDS,
    keep: Sequence[str] = KEEP_WORDS,
    noise: Sequence[str] = NOISE_WORDS,
    min_length: int = 4,
) -> Column:
    """Meaningful words of a text in order.

    A word stays when it is in ``keep``, or when it is not in ``noise``, has at least ``min_length`` characters and
    either holds a digit or consists of letters only. ``max_words=None`` keeps all of them. One pattern finds the
    words of the right shape between symbols and white space, so only those are looked up among the noise words.
    """
    shaped = F.regexp_extract_all(without_addresses(text), F.lit(_word_pattern(keep, min_length)), F.lit(0))
    dropped = sorted(set(noise) - set(keep))
    words = F.filter(shaped, lambda word: ~word.isin(*dropped)) if dropped else shaped
    return words if max_words is None else F.slice(words, 1, max_words)


def clean_text(text: Column, max_words: int | None = MAX_WORDS, **vocabularies) -> Column:
    """Cleaned text, words joined by one blank."""
    return F.array_join(clean_words(text, max_words, **vocabularies), " ")


def join_non_empty(*parts: Column) -> Column:
    """Blank-join of the parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda part: part != ""), " ")


def enrich(combined_text: Column, page_text: Column) -> Column:
    """``combined_text + ' ' + page_text``; the blank stays when the page text is empty (C14, H8)."""
    return F.concat_ws(" ", F.coalesce(combined_text, F.lit("")), F.coalesce(page_text, F.lit("")))


def text_length(text: Column) -> Column:
    """Length in characters."""
    return F.length(text)


def preview(text: Column, n_chars: int = 200) -> Column:
    """First characters, for display."""
    return F.substring(text, 1, n_chars)
