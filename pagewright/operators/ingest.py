"""Joins and filters that make one line table out of lines, pages, documents and companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.norm import strip
from ..session import cut

# Sentences that mark a page as a financial statement.
STATEMENT_SENTENCES = [
    "Les notes figurant en annexe font partie intégrante des comptes annuels",
    "Die Anhänge sind integraler Bestandteil der Jahresabschlüsse",
    "The notes in the annex form an integral part of the annual accounts",
]


def last_version(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one latest by `order` (ties: greatest row); a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(key, F.col(f"_r.{order}").alias(order), *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def one_page(pages: DataFrame) -> DataFrame:
    """One row for each (file_name, page_number): the greatest of differing repeats."""
    keys = ["file_name", "page_number"]
    rest = [c for c in pages.columns if c not in keys]
    return pages.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


def lines_with_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines with their box columns by position key; unmatched lines keep nulls."""
    return lines.join(boxes, ["file_name", "page_number", "line_number"], "left")


def lines_with_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    return lines.join(one_page(pages), ["file_name", "page_number"], "left")


def lines_with_docs(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Lines with the latest delivery of their file's document row."""
    return lines.join(last_version(docs, "file_name", "received_at"), "file_name", "left")


def docs_with_company(docs: DataFrame, companies: DataFrame) -> DataFrame:
    """Documents with name and industry of their company; unknown or null ids keep nulls."""
    one = companies.where("company_id is not null").groupBy("company_id").agg(F.max(F.struct("company_name", "company_industry")).alias("_c"))
    return docs.join(one.select("company_id", "_c.*"), "company_id", "left")


def unmatched_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of left without partner in right; null keys are among them."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def filter_language(df: DataFrame, lang: str) -> DataFrame:
    return df.where(F.col("language") == lang)


def filter_type(df: DataFrame, part: str) -> DataFrame:
    """Document types that contain the text; null types are dropped."""
    return df.where(F.col("document_type").contains(part))


def filter_industry(df: DataFrame, industry: str) -> DataFrame:
    return df.where(F.col("company_industry") == industry)


def last_document(docs: DataFrame) -> DataFrame:
    """All documents of each company's latest year (ties kept). Companies or years unknown are dropped.

    The latest year is a small aggregate joined back, so a company with very many files needs no window in one task.
    """
    known = docs.where("company_id is not null and document_year is not null")
    last = known.groupBy("company_id").agg(F.max("document_year").alias("document_year"))
    return known.join(last, ["company_id", "document_year"], "left_semi")


def dataset_prefix(docs: DataFrame, share: float, key: str = "doc_id") -> DataFrame:
    """The first int(n * share) documents in the order of the key, with all their rows.

    Keys are sorted in ranges and numbered by their place in the range and the sizes of those before it, so no task holds
    more than a range.
    """
    keys = docs.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)
    # written, so that the numbers stay as they are
    keys = cut(keys.select(key, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "sorted")
    part = keys.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    k = int(keys.count() * min(1.0, share))
    first = keys.join(F.broadcast(part.withColumn("_before", before)), "_part").where(F.col("_at") - F.col("_first") + F.col("_before") < k)
    return docs.join(first.select(key), key, "left_semi")


def with_company(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with a company, one row with the number of those without)."""
    return docs.where("company_id is not null"), docs.agg(F.count(F.when(F.col("company_id").isNull(), 1)).alias("skipped"))


def skip_statement_pages(lines: DataFrame) -> DataFrame:
    """Lines of pages that hold none of the statement sentences as a whole line."""
    bad = lines.where(F.col("text").isin(STATEMENT_SENTENCES)).select("file_name", "page_number").distinct()
    return lines.join(bad, ["file_name", "page_number"], "left_anti")


def layout_scope(lines: DataFrame) -> DataFrame:
    """Lines of the pages whose layout counts: the first two kept ones, and the last but one of the file."""
    pages = lines.select("file_name", "page_number").distinct()
    w = W.partitionBy("file_name")
    scope = pages.withColumn("_r", F.dense_rank().over(w.orderBy("page_number"))).withColumn("_n", F.count("*").over(w))
    scope = scope.where((F.col("_r") <= 2) | (F.col("page_number") == F.col("_n") - 1)).select("file_name", "page_number")
    return lines.join(scope, ["file_name", "page_number"], "left_semi")


def new_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that were not read yet."""
    return files.select("file_name").distinct().join(done.select("file_name").distinct(), "file_name", "left_anti")


def page_windows(jobs: DataFrame, max_pages: int = 200) -> DataFrame:
    """(job_id, window, page_from, page_to): plain windows of max_pages from page_start on to the last page."""
    j = jobs.where("page_start < total_pages")
    w = j.select("job_id", "total_pages", F.explode(F.sequence("page_start", F.col("total_pages") - 1, F.lit(max_pages))).alias("a"), "page_start")
    return w.select("job_id", ((F.col("a") - F.col("page_start")) / max_pages).cast("int").alias("window"), (F.col("a") + 1).alias("page_from"), F.least(F.col("a") + max_pages, F.col("total_pages")).alias("page_to"))


def industry_key(c: str = "company_industry"):
    return F.lower(strip(c))


def load_dataset(lines: DataFrame, pages: DataFrame, docs: DataFrame, companies: DataFrame, language: str | None = None, doc_type: str | None = None, industry: str | None = None, last_doc: bool = False) -> DataFrame:
    """The line table with page, document and company columns, filtered. Filters on documents go before the joins."""
    d = docs_with_company(last_version(docs, "file_name", "received_at"), companies)
    if doc_type is not None:
        d = filter_type(d, doc_type)
    if industry is not None:
        d = filter_industry(d, industry)
    if last_doc:
        d = last_document(d)
    how = "left" if doc_type is None and industry is None and not last_doc else "inner"
    out = lines_with_pages(lines, pages).join(d, "file_name", how)
    return out if language is None else filter_language(out, language)
