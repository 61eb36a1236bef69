"""Reading files page by page: an interface for page readers (rasteriser, text recognition, text layer).

The libraries behind it are a matter of the installation; any object with the two methods below will do. A reader
runs inside the tasks, one file and page window at a time.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import content_type, image_count
from ..functions.layout import orientation

WORDS = "file_name string, page_number int, block_num int, line_num int, word_num int, text string, left_px double, top_px double, width_px double, height_px double, level int, conf double"
PAGES = "file_name string, page_number int, page_width double, page_height double, angle int, language string, lang_confidence double, encrypted string, html string"


class PageReader(Protocol):
    def pages(self, content: bytes, password: str | None = None) -> int:
        """Number of pages; raises for files that can't be read."""

    def read(self, content: bytes, first: int, last: int) -> Iterator[tuple[dict[str, Any], list[dict[str, Any]]]]:
        """(page, words) for the pages first..last: dicts with the columns of PAGES and WORDS, file_name aside."""


def read_files(files: DataFrame, make: Callable[[], PageReader], window: int = 200) -> DataFrame:
    """(file_name, kind, error, page, word): all pages and words of files (file_name, content).

    Each file is cut into page windows, each read by a task of its own; every page is read once. A file that can't be
    read gives one row of kind 'error' and no others.
    """
    out = f"file_name string, kind string, error string, page struct<{_struct(PAGES)}>, word struct<{_struct(WORDS)}>"

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for pdf in batches:
            rows = []
            for f, c in zip(pdf["file_name"], pdf["content"]):
                try:
                    rows.append((f, reader.pages(bytes(c)), None))
                except Exception:  # noqa: BLE001 - one bad file must not stop the others
                    rows.append((f, 0, traceback.format_exc(limit=1)))
            yield pd.DataFrame(rows, columns=["file_name", "total", "error"])

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for pdf in batches:
            for f, c, a, b in zip(pdf["file_name"], pdf["content"], pdf["a"], pdf["b"]):
                rows = []
                try:
                    for page, words in reader.read(bytes(c), int(a), int(b)):
                        rows.append((f, "page", None, {"file_name": f, **page}, None))
                        rows += [(f, "word", None, None, {"file_name": f, **w}) for w in words]
                except Exception:  # noqa: BLE001
                    rows.append((f, "error", traceback.format_exc(limit=1), None, None))
                yield pd.DataFrame(rows, columns=["file_name", "kind", "error", "page", "word"])

    totals = files.select("file_name", "content").mapInPandas(count, "file_name string, total int, error string")
    bad = totals.where("total <= 0").select("file_name", F.lit("error").alias("kind"), F.coalesce("error", F.lit("no pages")).alias("error"), F.lit(None).cast(f"struct<{_struct(PAGES)}>").alias("page"), F.lit(None).cast(f"struct<{_struct(WORDS)}>").alias("word"))
    windows = totals.where("total > 0").select("file_name", "total", F.explode(F.expr(f"sequence(1, total, {window})")).alias("a"))
    windows = windows.withColumn("b", F.least(F.col("a") + window - 1, F.col("total")))
    got = windows.join(files.select("file_name", "content"), "file_name").repartition("file_name", "a").mapInPandas(read, out)
    return got.unionByName(bad)


def _struct(columns: str) -> str:
    return ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in columns.split(", "))


def tidy_words(words: DataFrame) -> DataFrame:
    """Word rows without blanks and nulls, boxes rounded to whole pixels."""
    cols = ["left_px", "top_px", "width_px", "height_px", "conf"]
    w = words.where("text is not null and trim(text) <> ''").dropna(subset=["block_num", "line_num", *cols])
    return w.withColumns({c: F.round(c).cast("int") for c in cols})


def page_records(pages: DataFrame, words: DataFrame) -> DataFrame:
    """One row for each page: size, orientation, language, content type with confidence, encryption, images."""
    seen = words.groupBy("file_name", "page_number").agg(F.collect_list("text").alias("words"))
    p = pages.join(seen, ["file_name", "page_number"], "left").withColumn("words", F.coalesce("words", F.expr("cast(array() as array<string>)")))
    c = content_type(F.coalesce("html", F.lit("")), F.col("words"))
    return p.select(
        "file_name", "page_number", "page_width", "page_height", orientation(F.col("page_width"), F.col("page_height"), F.col("angle")).alias("orientation"), "angle", "language", "lang_confidence",
        c["content_type"].alias("content_type"), c["confidence"].alias("read_confidence"), "encrypted", image_count(F.coalesce("html", F.lit(""))).alias("number_images"),
    )


def read_vocabulary(spark: SparkSession, path: str, lang: str, json: bool = False) -> DataFrame:
    """(lang, token) of a word list: the keys of a JSON object up to a '<', or the lines of a text file."""
    raw = spark.read.text(path, wholetext=json)
    if json:
        words = F.explode(F.map_keys(F.from_json("value", "map<string, string>")))
        t = raw.select(words.alias("w")).select(F.trim(F.substring_index("w", "<", 1)).alias("token"))
    else:
        t = raw.select(F.trim("value").alias("token"))
    return t.where("token <> ''").select(F.lit(lang).alias("lang"), F.lower("token").alias("token")).distinct()


def output_paths(folder: str) -> dict[str, str]:
    """One folder for each table of a dataset."""
    return {t: f"{folder.rstrip('/')}/{t}" for t in ("text", "bbox", "format", "page_info", "doc_info")}
