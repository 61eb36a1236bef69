"""Content type of a page from its text layer and what the page reader saw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import trunc2

LOST = "&#xfffd"  # fixed value: how a text layer writes characters it lost


def html_text(html: Column | str) -> Column:
    """Text of the html: tags out, the common entities resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&#xa0;", " "), (" ", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def word_count(text: Column) -> Column:
    """Words between blanks and line ends."""
    return F.size(F.filter(F.split(text, r"[ \n\r\t]"), lambda x: F.trim(x) != ""))


def char_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[ \n\r]", ""))


def image_count(html: Column | str) -> Column:
    """Images with a source, counted only on pages that have a paragraph."""
    return F.when(F.lower(html).rlike(r"<p[\s>]"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)(<img\b[^>]*src=[^>]*>)"), F.lit(1)))).otherwise(0)


def content_type(html: Column | str, words: Column) -> Column:
    """struct(content_type, confidence) from the html of a page and the words read on it (array, null as empty).

    E empty, X text layer in an unknown encoding, S scanned, C and B bad and perhaps bad reading, R readable.
    """
    html = F.col(html) if isinstance(html, str) else html
    n_ocr = F.size(F.coalesce(words, F.expr("cast(array() as array<string>)")))
    n_html = word_count(html_text(html))
    r = n_html / n_ocr
    back = F.when(n_html > 0, n_ocr / n_html).otherwise(F.lit(0.0))
    plain = html_text(F.replace(F.replace(html, F.lit(LOST), F.lit("")), F.lit(";"), F.lit(" ")))
    p_words, p_chars = word_count(plain), char_count(plain)
    o_chars = F.aggregate(words, F.lit(0), lambda a, x: a + F.length(x))
    pieces = F.size(F.split(html, LOST))
    by_chars = trunc2((o_chars - p_chars) / o_chars)
    x_conf = F.when(p_words > n_ocr, F.when(F.floor(by_chars * 100) == 0, F.floor(pieces / o_chars * 10000) / 10000).otherwise(by_chars)).otherwise(trunc2((n_ocr - p_words) / n_ocr))
    low = trunc2(F.least(r, back))
    out = lambda t, c: F.struct(F.lit(t).alias("content_type"), c.cast("double").alias("confidence"))
    return (
        F.when(n_ocr == 0, out("E", F.when(n_html > 0, 0.5).otherwise(1.0)))
        .when(html.contains(LOST + ";" + LOST + ";" + LOST), out("X", x_conf))
        .when(r < 0.5, out("S", trunc2((n_ocr - n_html) / n_ocr)))
        .when((r < 0.6) | (back < 0.6), out("C", low))
        .when((r < 0.75) | (back < 0.75), out("B", low))
        .otherwise(out("R", F.least(low, F.lit(1.0))))
    )
