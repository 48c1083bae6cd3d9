import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelweave.functions import labels as L
from labelweave.functions.html import page_text
from labelweave.functions.text import (
    DIGIT, SPACE, SPACE_CHARS, clean_text, enrich, join_non_empty, preview, raw_words, text_length,
)
from labelweave.functions.vocab import KEEP_WORDS, NOISE_WORDS
from tests.conftest import plan_of


def apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    return [r.out for r in df.select("i", expression(F.col("t")).alias("out")).orderBy("i").collect()]


def brute_clean(text, max_words=150, keep=frozenset(KEEP_WORDS), noise=frozenset(NOISE_WORDS)):
    """The rule in words of its own: run by run, then piece by piece."""
    pieces = []
    for run in (text or "").lower().split():
        cut = min((m.start() for m in re.finditer("http.|www.", run)), default=len(run))
        run = run[:cut]
        if not re.search(".@.", run):
            pieces += "".join(c if c.isalnum() or c in "_-" else " " for c in run).split()
    kept = []
    for piece in pieces:
        shaped = len(piece) > 3 and (piece.isalpha() or any(map(str.isdigit, piece)))
        if piece in keep or (piece not in noise and shaped):
            kept.append(piece)
    return " ".join(kept if max_words is None else kept[:max_words])


EDGES = [
    "see foohttp://x.y/z bar", "http alone", "www", "www.a.b rest", "mail me@host.org http://h/a@b now",
    "a@b@ tail", "@start word", "end@ word", "don't stop", "y-intercept slope", "snake_case x_12 a1b2", "2024 8ee 12",
    "add sum the area", "x² m²22 ½abc", "École ÉTÉ été", "", None, "   ", "tab\tnew\nline nbsp wide",
    " ".join(f"word{i}" for i in range(149)), " ".join(f"word{i}" for i in range(151)), "naïve coöperate Ünïcode",
    "section chapter figure formula", "(parenthesised) [brackets] {braces}", "a\x1cb sixth\x1cseven", "-dash- --- ____",
    "x" * 5000 + "@", "well-known 3-dimensional -1234-",
]


def test_cleaning_edges(spark):
    assert apply(spark, clean_text, EDGES) == [brute_clean(t) for t in EDGES]


def characters(pattern):
    """All characters a class matches; the class is written for the JVM."""
    import regex

    written = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U%08x" % int(m[1], 16), pattern)
    return set(regex.findall(written, "".join(map(chr, range(0x110000)))))


def test_classes_hold_the_characters_of_the_rule():
    digits = {c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal()}
    assert characters(DIGIT.replace(r"\p{Nd}", "")) == digits
    spaces = {c for c in map(chr, range(0x110000)) if c.isspace()}
    assert spaces == set(SPACE_CHARS) == characters(SPACE)


def test_known_outcomes(spark):
    assert apply(spark, clean_text, ["Add the sum; see 2024 8ee y-intercept snake_case at http://a.b"]) == ["add sum 2024"]


def test_vocabularies_are_parameters(spark):
    got = apply(spark, lambda t: clean_text(t, None, keep=["an", "y-axis"], noise=["word"]), ["an Y-axis word words the"])
    assert got == ["an y-axis words"]
    assert apply(spark, lambda t: clean_text(t, None, keep=["word"], noise=["word"]), ["word"]) == ["word"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("abÉé12²_-@./: \t hwtp'"), max_size=40), min_size=20, max_size=40))
def test_cleaning_equals_brute_force(spark, texts):
    texts = texts + ["http" + t for t in texts]
    assert apply(spark, clean_text, texts) == [brute_clean(t) for t in texts]


def test_cleaning_is_idempotent(spark):
    once = apply(spark, lambda t: clean_text(t, None), EDGES)
    assert apply(spark, lambda t: clean_text(t, None), once) == once


def test_raw_words(spark):
    assert apply(spark, raw_words, ["The y-axis: 3 a@b.c http://u", None]) == [["the", "y-axis", "3"], []]


def test_join_and_enrich(spark):
    df = spark.createDataFrame([("a", "", None, "b")], "a string, b string, c string, d string")
    row = df.select(
        join_non_empty(*map(F.col, "abcd")).alias("joined"), enrich(F.col("a"), F.col("b")).alias("one"),
        enrich(F.col("c"), F.col("d")).alias("two"), text_length(F.col("a")).alias("n"), preview(F.lit("abcdef"), 3).alias("p"),
    ).first()
    assert tuple(row) == ("a b", "a ", " b", 1, "abc")


@pytest.mark.parametrize(
    "label, category",
    [("8.EE.A.4", "8.EE"), ("8", "8"), ("8.", "8."), ("", ""), (None, None), ("8.G.A.1.B", "8.G"), ("HSG.GMD.A.3", "HSG.GMD")],
)
def test_category(spark, label, category):
    assert apply(spark, L.category_of, [label]) == [category]


def test_tiers_and_verdicts(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (0.49,), (0.56,), (0.61,), (0.553,)], "a double")
    rows = df.select(L.accuracy_tier(F.col("a")).alias("t"), L.verdict(F.col("a")).alias("v")).collect()
    assert [r.t for r in rows] == [L.PERFECT, L.GOOD, L.FAILED, L.GOOD, L.GOOD, L.GOOD]
    assert [r.v for r in rows] == ["excellent", "below", "below", "improved", "excellent", "below"]


PAGES = {
    "<p>a</p><p>b</p>": "ab",
    "x<SCRIPT type='a>b'>1<2</script >y<STYLE>p{}</STYLE>z": "xyz",
    "a<!-- x > y --><!DOCTYPE html>b": "ab",
    "a<script>never closed": "a",
    'a<a title="x > y">b</a><img alt=\'>\'>c': "abc",
    "AT&amp;T &copy &middot; &amp;lt; &unknown; &amp": "AT&T © · &lt; &unknown; &",
    "<h1>cut&amp</h1>off &lt;p&gt; R&ampD": "cut&off <p> R&ampD",
    "&#65;&#x42;&#128;&#0;&#xD800;&#x110000;&#1234567890123;": "AB€����",
    "a   b    c": "a b c",
    "tab\tstays  here": "tab\tstays here",
    " one \r\n two three\x85four ": "one two three four",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<script>if (a < b) '<!--'</script>shown": "shown",
    "": "",
}


def test_page_text(spark):
    assert apply(spark, page_text, [*PAGES, None]) == [*PAGES.values(), ""]


def test_broken_pages_finish(spark):
    pages = ["<a " + "x=y " * 3000 + "no end", "<a " + 'q="v" ' * 3000 + ">shown", "<!--" + "-" * 50000, "&" * 5000]
    got = apply(spark, page_text, pages)
    assert got[1] == "shown" and got[2] == "" and got[3] == "&" * 5000


def test_tags_may_have_any_number_of_attributes(spark):
    double, single = "".join(f' a{i}="x > {i}"' for i in range(5000)), "".join(f" b{i}='<y> {i}'" for i in range(5000))
    pages = [f"<p{double}>shown</p>", f"<p{single}>shown</p>", f"<p{double}{single} c = 'z>' d>shown</p>", "<p a='open>shown</p>"]
    assert apply(spark, page_text, pages) == ["shown"] * 4


def test_no_python_in_text_plans(spark):
    df = spark.createDataFrame([("x",)], "t string")
    plan = plan_of(df.select(clean_text(F.col("t")), page_text(F.col("t"))))
    assert "EvalPython" not in plan and "Exchange" not in plan
