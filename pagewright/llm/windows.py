"""Problem 1: cut oversized page requests into windows at natural boundaries."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Pages one run may read, and the pages two consecutive windows share.
LIMIT, OVERLAP = 200, 5
#: Windows handed on at once.
ROWS = 50_000


def merge_segments(n: int, strength: dict[int, float], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Cut units 1..n into windows of at most limit units that overlap by overlap units.

    Agglomerative: every unit starts as a segment; the boundaries between neighbours lie in a heap and the
    weakest goes first while the merged segment still fits. A segment that is not the first carries the
    overlap in front of it, so it may hold limit - overlap units of its own. strength[i] is the weight of the
    boundary after unit i (0 where absent, not below 0). Equal boundaries merge from the left, and a boundary whose
    merge does not fit now never fits later, as segments only grow. All boundaries of weight 0 go before the others, from
    the left, so what they give is known without listing the units: full segments and a rest between one change and the
    next. Only the changes are put in the heap; the memory is that of the windows and the changes.
    """
    if n <= 0:
        return []
    if n <= limit:
        return [(1, n)]
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    room = lambda a: limit - (overlap if a > 1 else 0)
    heap = [(w, i) for i, w in strength.items() if 1 <= i < n and w > 0]
    right: dict[int, int] = {}  # first unit of a segment -> its last
    left: dict[int, int] = {}  # and the other way round
    a = 1
    for end in [*sorted(i for _, i in heap), n]:
        while a <= end:
            b = min(end, a + room(a) - 1)
            right[a], left[b] = b, a
            a = b + 1
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)
        a, b = left[i], right[i + 1]
        if b - a + 1 <= room(a):
            del left[i], right[i + 1]
            right[a], left[b] = b, a
    return [(max(1, a - overlap) if a > 1 else 1, right[a]) for a in sorted(right)]


def requested_pages(jobs: DataFrame, page_info: DataFrame) -> DataFrame:
    """(job_id, file_name, first_page, last_page, requested): the pages each job asks for.

    Of rows under one job_id the latest submitted_at counts (a null one is oldest; ties by the rest of the
    row). Null page_start: 0; null page_end: end of the file; exchanged bounds are put right; pages outside
    1..end of the file don't count. End of the file: total_pages, or where that is null or not positive the
    number of the file's different pages in page_info; unknown in both: 0 pages. Null job_ids are dropped.
    """
    cols = ["file_name", "page_start", "page_end", "total_pages"]
    # arg-max as an aggregate: a job_id sent again very often is combined before the shuffle
    latest = (
        jobs.where("job_id is not null")
        .groupBy("job_id")
        .agg(F.max(F.struct("submitted_at", *cols)).alias("r"))
        .select("job_id", *[F.col(f"r.{c}").alias(c) for c in cols])
    )
    pages = (
        page_info.where("file_name is not null and page_number is not null")
        .select("file_name", "page_number").distinct()
        .groupBy("file_name").agg(F.count("*").alias("pages"))
    )
    end = F.when(F.col("total_pages") > 0, F.col("total_pages").cast("long")).otherwise(F.coalesce("pages", F.lit(0)))
    a, b = F.coalesce(F.col("page_start").cast("long"), F.lit(0)), F.coalesce(F.col("page_end").cast("long"), F.col("eof"))
    return (
        latest.join(pages, "file_name", "left")
        .withColumn("eof", end)
        .withColumn("lo", F.greatest(F.least(a, b), F.lit(0)))
        .withColumn("hi", F.least(F.greatest(a, b), F.col("eof")))
        .select(
            "job_id", "file_name", (F.col("lo") + 1).alias("first_page"), F.col("hi").alias("last_page"),
            F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).alias("requested"),
        )
    )


def page_changes(page_info: DataFrame) -> DataFrame:
    """(file_name, after_page, strength): between which pages the file changes character, and how much.

    Only changes are kept, so the table is far smaller than page_info. A language counts when two known ones
    differ; blank pages (content type E) take over the character of the page before.
    """
    one = page_info.where("file_name is not null and page_number is not null").groupBy("file_name", "page_number").agg(
        F.max(F.struct("orientation", "language", "content_type", "encrypted", "page_width", "page_height")).alias("r")
    ).select("file_name", "page_number", "r.*")
    w = W.partitionBy("file_name").orderBy("page_number")
    known: dict[str, Column] = {
        "orientation": F.col("orientation"),
        "language": F.when(F.coalesce(F.col("content_type"), F.lit("")) != "E", F.col("language")),
        "encrypted": F.col("encrypted"),
        "shape": F.when(F.col("page_height") > 0, F.round(F.col("page_width") / F.col("page_height"), 1)),
    }
    weight = {"orientation": 3.0, "language": 4.0, "encrypted": 2.0, "shape": 1.0}
    for c, e in known.items():
        one = one.withColumn(f"_{c}", e).withColumn(f"_{c}_before", F.last(e, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    strength = sum((F.when(F.col(f"_{c}") != F.col(f"_{c}_before"), F.lit(weight[c])).otherwise(0.0) for c in known), F.lit(0.0))
    return (
        one.select("file_name", (F.col("page_number") - 1).cast("long").alias("after_page"), strength.alias("strength"))
        .where("strength > 0")
    )


def split_requests(jobs: DataFrame, page_info: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(job_id, window_no, page_from, page_to, requested): windows of at most limit pages that cover each request.

    Jobs within the limit come out as one window, jobs that ask for no page as none. Each job travels as one
    row with the changes of its file; the pages themselves are never listed outside the task that cuts them.
    """
    ask = requested_pages(jobs, page_info).where("requested > 0")
    long = ask.where(F.col("requested") > limit)
    changes = page_changes(page_info).join(long.select("file_name").distinct(), "file_name", "left_semi")
    changes = changes.groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("after_page", "strength"))).alias("changes"))
    rows = long.join(changes, "file_name", "left").select("job_id", "first_page", "last_page", "requested", "changes")

    cols = ["job_id", "window_no", "page_from", "page_to", "requested"]

    def cut_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                changes = r.changes if r.changes is not None else []
                strength = {c["after_page"] - r.first_page + 1: c["strength"] for c in changes}
                for i, (a, b) in enumerate(merge_segments(int(r.requested), strength, limit, overlap)):
                    out.append((r.job_id, i, r.first_page + a - 1, r.first_page + b - 1, r.requested))
                    if len(out) == ROWS:
                        yield pd.DataFrame(out, columns=cols)
                        out = []
            yield pd.DataFrame(out, columns=cols)

    schema = "job_id long, window_no int, page_from long, page_to long, requested long"
    short = ask.where(F.col("requested") <= limit).select("job_id", F.lit(0).alias("window_no"), F.col("first_page").alias("page_from"), F.col("last_page").alias("page_to"), "requested")
    return rows.mapInPandas(cut_up, schema).unionByName(short)


def found(jobs: DataFrame, page_info: DataFrame) -> DataFrame:
    """Jobs that had to be cut: those that request more than LIMIT pages."""
    return split_requests(jobs, page_info).where(F.col("requested") > LIMIT).select("job_id").distinct()
