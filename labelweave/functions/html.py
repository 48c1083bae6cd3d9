"""Readable text of an HTML page as one Column expression."""

from __future__ import annotations

from collections.abc import Mapping
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelweave.functions.text import SPACE_CHARS

# One pass in document order: comments, script and style with their content, declarations, tags. Attribute values in
# quotes may hold ">". The loop over attributes is possessive: it runs without recursion and never backtracks, so a tag
# may have any number of them; the last branch takes tags whose last quote isn't closed.
MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|<[!?][^>]*>"
    r"|</?[a-z](?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>"
    r"|</?[a-z][^>]*>"
)
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?"
# A line end or two blanks separate phrases.
PHRASE_END = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]|  "

_FIRST = ["amp", "quot", "lt", "gt", "nbsp", "copy", "middot"]
#: Named character references, the frequent ones first.
ENTITIES: dict[str, str] = {
    name: chr(name2codepoint[name]) for name in [*_FIRST, *sorted(set(name2codepoint) - set(_FIRST))]
} | {"apos": "'"}

# Numeric references 128-159 mean the Windows-1252 character of that byte.
_C1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]


def _code_point(reference: Column) -> Column:
    digits = F.regexp_extract(reference, r"([0-9a-fA-F]+);?$", 1)
    is_hex = F.lower(F.substring(reference, 3, 1)) == "x"
    code = F.when(is_hex, F.conv(digits, 16, 16)).otherwise(F.conv(digits, 10, 16))
    padded = F.lpad(code, 8, "0")
    valid = (
        (F.length(code) <= 6) & (padded <= "0010FFFF") & ~padded.between("0000D800", "0000DFFF")
        & (padded != "00000000")
    )
    char = F.decode(F.unhex(padded), "UTF-32")
    return F.when(valid, F.translate(char, "".join(map(chr, range(128, 160))), "".join(_C1))).otherwise("�")


def decode_references(text: Column, entities: Mapping[str, str] = ENTITIES) -> Column:
    """Replace character references once, so ``&amp;lt;`` becomes ``&lt;``; unknown names stay as written (H5)."""
    # One literal, folded to a map once per query. No name or character holds a tab or a line end.
    table = F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in entities.items())), F.lit("\n"), F.lit("\t"))

    def char(reference: Column) -> Column:
        named = F.try_element_at(table, F.translate(reference, "&;", ""))
        return F.when(reference.startswith("&#"), _code_point(reference)).otherwise(F.coalesce(named, reference))

    decoded = F.array_join(
        F.zip_with(
            F.split(text, REFERENCE, -1),
            F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)),
            lambda before, reference: F.concat(
                before, F.when(reference.isNull(), F.lit("")).otherwise(char(reference))
            ),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


#: Stands where markup was until references are read: a noncharacter, so no text holds it.
_NODE_END = "\uffff"


def text_nodes(html: Column) -> Column:
    """Drop scripts, styles, comments and tags, leaving a mark between the texts they part (H4, H5)."""
    return F.regexp_replace(html, MARKUP, _NODE_END)


def squeeze_phrases(text: Column) -> Column:
    """Split at line ends and double blanks, strip, drop empties, join by one blank (H6, H7)."""
    phrases = F.transform(F.split(text, PHRASE_END), lambda p: F.btrim(p, F.lit(SPACE_CHARS)))
    return F.array_join(F.filter(phrases, lambda p: p != ""), " ")


def page_text(html: Column, entities: Mapping[str, str] = ENTITIES) -> Column:
    """Readable text of a page, '' for null (H4-H7).

    References end with their text node, so they are read before the texts are joined without a separator.
    """
    joined = F.replace(decode_references(text_nodes(html), entities), F.lit(_NODE_END), F.lit(""))
    return F.coalesce(squeeze_phrases(joined), F.lit(""))
