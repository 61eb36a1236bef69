"""Fingerprint of a document: page, layout and text features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.norm import feature_key, strip
from ..functions.text import NOT_ENUMERATORS, before_colon, enumerator, enumerator_type, first_tokens, fold_vowels, has_text, strip_dates, strip_numbers
from .ingest import layout_scope, skip_statement_pages
from .similarity import code

WEIGHTS = {"title": 1, "subtitle": 2, "text": 1, "page": 1, "enumerator": 4}  # fixed values; others 1
COLUMNS = ["file_name", "feature", "type", "level", "value", "frequency"]


def weight(kind: Column) -> Column:
    out = F.lit(1)
    for k, w in WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def _as(df: DataFrame, name: Column, kind: str, level: str, value: Column | None = None, frequency: Column | None = None) -> DataFrame:
    return df.select(
        "file_name", name.alias("feature"), F.lit(kind).alias("type"), F.lit(level).alias("level"),
        (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(1) if frequency is None else frequency).cast("int").alias("frequency"),
    )


def page_features(lines: DataFrame) -> DataFrame:
    """Language and orientation of every page."""
    p = lines.select("file_name", "page_number", "language", "orientation").distinct()
    a = _as(p.where("language is not null"), F.concat(F.lit("language_"), "page_number", F.lit("_"), "language"), "page", "cluster")
    b = _as(p.where("orientation is not null"), F.concat(F.lit("orientation_"), "page_number", F.lit("_"), "orientation"), "page", "cluster")
    return a.unionByName(b).distinct()


def position_features(lines: DataFrame) -> DataFrame:
    """Left edges of the text rows (least x of each y, below 500) and how often each occurs."""
    rows = layout_scope(lines).groupBy("file_name", "page_number", "y").agg(F.min("x").alias("x")).where("x < 500")
    g = rows.groupBy("file_name", "x").agg(F.count("*").alias("n"))
    return _as(g, F.concat(F.lit("xPos_"), "x"), "position", "subcluster", F.col("x"), F.col("n"))


def size_features(lines: DataFrame) -> DataFrame:
    """Widths that come back on a page, and heights, with their numbers."""
    scope = layout_scope(lines)

    def of(c: str, name: str, least: int) -> DataFrame:
        g = scope.groupBy("file_name", "page_number", c).agg(F.count("*").alias("n")).where(F.col("n") > least)
        g = g.groupBy("file_name", c).agg(F.sum("n").alias("n"))
        return _as(g, F.concat(F.lit(f"{name}_"), F.col(c).cast("double")), "size", "subcluster", F.col(c), F.col("n"))

    return of("w", "wSize", 1).unionByName(of("h", "hSize", 0))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines that start with an enumerator and go on with text: adds enum, rest, subtitle (null where none)."""
    low = fold_vowels(strip(F.lower("text")))
    t = lines.withColumn("low", low).withColumn("enum", enumerator(F.col("low"), F.col("language")))
    t = t.where(F.col("enum").isNotNull() & ~F.trim("enum").isin(NOT_ENUMERATORS))
    t = t.withColumn("rest", strip(F.replace("low", F.col("enum"), F.lit("")))).where(has_text("rest"))
    s = strip_numbers(strip_dates("rest"))
    t = t.withColumn("_s", s)
    ok = (F.length(strip("_s")) > 5) & (F.right("_s", F.lit(1)) != ".") & (F.substring("text", 1, 1) == F.upper(F.substring("text", 1, 1)))
    return t.withColumn("subtitle", F.when(ok, F.col("_s"))).drop("_s")


def enumerator_features(lines: DataFrame) -> DataFrame:
    return _as(numbered_lines(lines), F.concat(F.lit("enum_"), enumerator_type("enum")), "enumerator", "cluster").distinct()


def subtitle_features(lines: DataFrame) -> DataFrame:
    return _as(numbered_lines(lines).where("subtitle is not null"), F.concat(F.lit("subtitle_"), "subtitle"), "subtitle", "cluster").distinct()


def text_features(lines: DataFrame) -> DataFrame:
    """First ten words of the line after a subtitle, unless that line is numbered itself."""
    nxt = F.lead("text").over(W.partitionBy("file_name", "page_number").orderBy("line_number"))
    t = numbered_lines(lines.withColumn("next_text", nxt)).where("subtitle is not null and next_text is not null")
    t = t.withColumn("n_low", strip(F.lower("next_text"))).where(enumerator(F.col("n_low"), F.col("language")).isNull())
    t = t.withColumn("t", first_tokens(strip_numbers(strip_dates("n_low")))).where((F.length("t") > 4) & has_text("t"))
    name = F.when(F.col("t").contains(":"), strip(before_colon("t"))).otherwise(F.col("t"))
    return _as(t, F.concat(F.lit("text_"), name), "text", "subcluster").distinct()


def title_features(lines: DataFrame) -> DataFrame:
    """Short lines at the left as titles, for documents with fewer than three subtitles."""
    few = subtitle_features(lines).groupBy("file_name").agg(F.count_distinct("feature").alias("n")).where("n >= 3")
    t = lines.join(few, "file_name", "left_anti").where((F.col("x") < F.col("page_width") / 3) & (F.col("w") < F.col("page_width") / 3))
    t = t.withColumn("t", strip_numbers(strip_dates(fold_vowels(strip(F.lower("text"))))))
    t = t.where((F.length("t") > 4) & has_text("t") & (F.right("t", F.lit(1)) != ".") & (F.substring("text", 1, 1) == F.upper(F.substring("text", 1, 1))))
    return _as(t, F.concat(F.lit("title_"), before_colon("t")), "title", "cluster").distinct()


def extract_features(lines: DataFrame) -> DataFrame:
    """All features of the documents behind the lines, one row for each (file_name, feature)."""
    kept = skip_statement_pages(lines)
    parts = [f(kept) for f in (page_features, position_features, size_features, enumerator_features, subtitle_features, text_features, title_features)]
    return reduce(DataFrame.unionByName, parts)


def clean_features(features: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, feature, type, level, value, frequency, weight): spellings united, repeats and null features dropped."""
    f = features.select(F.col(id_).alias("id"), feature_key("feature").alias("feature"), "type", "level", "value", "frequency").where("id is not null and feature is not null")
    g = f.groupBy("id", "feature").agg(F.min("type").alias("type"), F.min("level").alias("level"), F.max("value").alias("value"), F.max("frequency").alias("frequency"))
    return g.withColumn("weight", weight(F.col("type")))


def coded_features(features: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, feature, level, weight): clean_features with whole numbers for names.

    Names become numbers before rows meet, so no shuffle holds a name, and the shuffle by id serves all that is grouped by id.
    """
    f = features.select(F.col(id_).alias("id"), feature_key("feature").alias("feature"), "type", "level").where("id is not null and feature is not null")
    f = f.select("id", code(f), "type", "level").repartition("id")
    g = f.groupBy("id", "feature").agg(F.min("type").alias("type"), F.min("level").alias("level"))
    return g.select("id", "feature", "level", weight(F.col("type")).alias("weight"))
