"""Geometry of pages, lines and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def trunc2(c: Column) -> Column:
    """Cut to two decimals, towards zero."""
    return F.when(c < 0, F.ceil(c * 100)).otherwise(F.floor(c * 100)) / 100


def normalize_box(v: Column, size: Column) -> Column:
    """Thousandths of the page, cut towards zero; null for a page without size."""
    return F.when(size > 0, (1000 * v / size).cast("int"))


def orientation(width: Column, height: Column, rotation: Column | None = None) -> Column:
    """P if higher than wide, else L; a page turned by 90 or 270 degrees is L."""
    o = F.when(height > width, "P").otherwise("L")
    return o if rotation is None else F.when(rotation.isin(90, 270), "L").otherwise(o)


def renumber_lines(lines: DataFrame) -> DataFrame:
    """line_index: place of the line's y among all of its page, the last place for equal ones, from 0."""
    w = W.partitionBy("file_name", "page_number").orderBy("y").rangeBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("line_index", F.count("*").over(w) - 1)


def assemble_lines(words: DataFrame, mode: str = "line") -> DataFrame:
    """Word boxes to lines: (file_name, page_number, block_num, line_num, line_index, text, x, y, x2, y2, w, h, avg_h).

    Words of a block's line are sorted by their top (then word number). The first opens a line; each next one whose top lies
    above the bottom of the opening word belongs to it, the first that does not opens another. Within a line words
    go from left to right. mode='word': one row for each word. Words without text are left out, repeats count once.
    """
    box = ["file_name", "page_number", "block_num", "line_num"]
    w = words.where(F.trim("text") != "").select(
        *box, "word_num", "text", F.round("left_px").cast("int").alias("x"), F.round("top_px").cast("int").alias("y"),
        F.round(F.col("left_px") + F.col("width_px")).cast("int").alias("x2"), F.round(F.col("top_px") + F.col("height_px")).cast("int").alias("y2"),
        F.round("height_px").cast("int").alias("hh"),
    ).distinct()
    if mode == "word":
        i = F.row_number().over(W.partitionBy(*box).orderBy("y", "word_num", "x", "text")) - 1
        return w.select(*box, i.alias("line_index"), "text", "x", "y", "x2", "y2", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), F.col("hh").cast("long").alias("avg_h"))
    packed = w.groupBy(*box).agg(F.array_sort(F.collect_list(F.struct("y", "word_num", "x", "text", "x2", "y2", "hh"))).alias("ws"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("int").alias("bottom"), F.expr("cast(array() as array<int>)").alias("of"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["bottom"].isNull() | (x["y"] >= acc["bottom"])
        line = F.when(new, acc["line"] + 1).otherwise(acc["line"])
        return F.struct(line.alias("line"), F.when(new, x["y2"]).otherwise(acc["bottom"]).alias("bottom"), F.concat(acc["of"], F.array(line)).alias("of"))

    of = F.aggregate("ws", start, step, lambda acc: acc["of"])
    each = packed.select(*box, F.explode(F.arrays_zip("ws", of.alias("of"))).alias("z")).select(*box, F.col("z.of").alias("line_index"), "z.ws.*")
    return (
        each.groupBy(*box, "line_index")
        .agg(
            F.array_join(F.expr("transform(array_sort(collect_list(struct(x, y, word_num, text))), s -> s.text)"), " ").alias("text"),
            F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.rint(F.avg("hh")).cast("long").alias("avg_h"),
        )
        .select(*box, "line_index", "text", "x", "y", "x2", "y2", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "avg_h")
    )
