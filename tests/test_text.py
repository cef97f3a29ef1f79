import html

import pytest
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.functions.unicode import ascii_fold, nfc


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("r")).first()[0]


@pytest.mark.parametrize("text", [None, "", "a\r\nb\rc", "x \t\n\n\n\n\n\ny", "  a b  ", "a\x00b", "😀\n\n\n\n😀"])
def test_newlines(spark, text):
    import re

    want = None
    if text is not None:
        want = re.sub("\r\n?", "\n", text).replace("\x00", "")
        want = re.sub("[   ]", " ", want)
        want = re.sub("\n{4,}", "\n\n\n", re.sub("[ \t]+\n", "\n", want)).strip()
    assert one(spark, text, T.normalize_newlines("t")) == want


@pytest.mark.parametrize("text", ["&amp;lt;", "&#945;&#x3B2;&#X1F600;", "&nope; &#99999999; &#55296;", "a &lt;b&gt; &quot;c&quot;", "no entity", "&#8364;5 &euro;6", "100 &#38; 7"])
def test_entities(spark, text):
    got = one(spark, text, T.decode_entities("t"))
    want = {"&nope; &#99999999; &#55296;": "&nope; &#99999999; &#55296;"}.get(text, html.unescape(text))
    assert got == want


def test_html_to_text(spark):
    page = "<html><script>var a='</p>';</script><p>One&nbsp;&amp; two</p><ul><li>x<li>y</ul><br>z"
    assert one(spark, page, T.html_to_text("t")) == "One & two\n\n• x• y\nz"


def test_numbers_and_ratios(spark):
    assert [one(spark, t, T.paragraph_number("t")) for t in ("[12] a", "(3) b", "4. c", "5) d", "12345. e", "x 6.", "")] == ["12", "3", "4", "5", "", "", ""]
    assert one(spark, "ΆΒγδ", T.uppercase_ratio("t")) == 0.5
    assert one(spark, "123", T.uppercase_ratio("t")) == 0.0
    assert one(spark, "ab\ncd\nef", T.line_at("t", F.lit(4))) == 2


def test_clauses_paths_and_bounds(spark):
    assert one(spark, "keep this. drop 1.1.2020; and this.", T.without_clauses("t", r"20\d\d")) == "keep this. drop 1. 1. and this"
    assert one(spark, "a[3]..b[0].", T.field_path("t")) == "a.b"
    assert [one(spark, v, T.clamp01("t", 0.5), "double") for v in (None, float("nan"), -1.0, 0.3, 7.0)] == [0.5, 0.5, 0.0, 0.3, 1.0]
    assert one(spark, [" a", "A", "", None, "b", "B "], T.distinct_folded(F.col("t")), "array<string>") == ["a", "b"]
    assert one(spark, 3725, T.clock(F.col("t")), "int") == "62:05" and one(spark, -4, T.clock(F.col("t")), "int") == "00:00"


def test_unicode(spark):
    assert one(spark, "é·", nfc("t")) == "é·"
    assert one(spark, "Ölmezkaya ﬁ", ascii_fold("t")) == "Olmezkaya fi"
    assert one(spark, None, nfc("t")) is None
