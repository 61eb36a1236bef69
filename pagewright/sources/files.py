"""Text sources and sinks: tab-separated tables, wide columns, JSON, models, reports, file discovery."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {
    "text": "file_name string, page_number int, line_number int, text string, x int, y int, x2 int, y2 int, w double, h double, avg_h double",
    "page_info": "file_name string, page_number int, page_width double, page_height double, orientation string, angle int, language string, lang_confidence double, content_type string, read_confidence double, encrypted string, number_images int",
    "bbox": "file_name string, page_number int, line_number int, n_x int, n_y int, n_x2 int, n_y2 int, page_width double, page_height double",
    "format": "file_name string, page_number int, line_number int, format string",
    "doc": "file_name string, company_id string, document_year int, document_type string, document_link string",
    "cia": "company_id string, company_name string, company_industry string",
}  # fixed values: tables of a dataset folder and their columns


def column_name(header: str) -> str:
    return header.strip().lower().replace(" ", "_")


def read_tsv(spark: SparkSession, path: str, types: str) -> DataFrame:
    """A tab-separated table with a header, without quoting. Columns get the types by position, further ones are strings.

    Names are the header's in lower case with _ for blanks. Values that don't fit their type are null.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("inferSchema", False).csv(path)
    kinds = [t.strip().rsplit(" ", 1)[1] for t in types.split(",")]
    out = [F.expr(f"try_cast(`{c}` as {kinds[i] if i < len(kinds) else 'string'})").alias(column_name(c)) for i, c in enumerate(raw.columns)]
    return raw.select(*out)


def expand_wide(df: DataFrame, column: str, kind: str = "double") -> DataFrame:
    """A column whose name lists several names by commas becomes one column for each, null where the cell has fewer."""
    names = [n.strip() for n in column.split(",")]
    cell = F.split(F.col(f"`{column}`"), ",")
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, *[F.get(cell, F.lit(i)).try_cast(kind).alias(n) for i, n in enumerate(names)])


def read_folder(spark: SparkSession, folder: str, tasks: tuple[str, ...] = (), pages_only: bool = False) -> dict[str, DataFrame]:
    """The tables of a dataset folder by naming convention; bbox and format only if asked for."""
    names = ["page_info"] if pages_only else ["text", "page_info", "doc", "cia", *[t for t in ("bbox", "format") if t in tasks]]
    glob = {"text": "text_*.txt"} | {n: f"*_{n}.txt" for n in ("page_info", "bbox", "format", "doc", "cia")}
    return {n: read_tsv(spark, f"{folder}/{glob[n]}", TYPES[n]) for n in names}


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg")) -> DataFrame:
    """(path, file_name, length) of the files below the folder with one of the endings; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*suffixes, *map(str.upper, suffixes)]) + "}").load(folder)
    return f.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("file_name"), "length")


def write_tsv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_model(path: str, assigned: DataFrame, clusters: DataFrame, features: DataFrame, args: dict) -> None:
    """Clusters, documents and features as tables, arguments as JSON in one text file."""
    assigned.write.mode("overwrite").parquet(f"{path}/assigned")
    clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    features.write.mode("overwrite").parquet(f"{path}/features")
    spark = assigned.sparkSession
    spark.createDataFrame([(json.dumps(args, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/args")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    args = json.loads(spark.read.text(f"{path}/args").first()["value"])
    return spark.read.parquet(f"{path}/assigned"), spark.read.parquet(f"{path}/clusters"), spark.read.parquet(f"{path}/features"), args


def report(df: DataFrame, path: str) -> None:
    """A report for spreadsheets: CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


