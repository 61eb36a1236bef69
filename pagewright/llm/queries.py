"""Queries of the training-data operators: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import cuts, density, groups, langid, leaks, packing, scans, setjoin, subset, windows

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def on(f: Callable[..., DataFrame], *tables: str) -> Query:
        return lambda spark, folder: f(*[table(spark, folder, t) for t in tables])

    return {
        "p1_found": on(windows.found, "ocr_jobs", "page_info"),
        "p1_windows": on(windows.split_requests, "ocr_jobs", "page_info"),
        "p2_found": on(langid.found, "documents", "ocr_jobs", "text_lines"),
        "p2_documents": on(langid.document_languages, "documents"),
        "p2_jobs": on(langid.jobs_report, "documents", "ocr_jobs", "text_lines"),
        "p3_found": on(density.found, "doc_features"),
        "p3_clusters": on(density.report, "doc_features"),
        "p4_found": on(groups.found, "cluster_pairs"),
        "p5_found": on(setjoin.found, "doc_features", "clusters"),
        "p5_links": on(setjoin.summary, "doc_features", "clusters"),
        "p6_subset": on(subset.subset, "doc_features", "clusters"),
        "p7_found": on(scans.found, "text_lines", "page_info", "documents"),
        "p7_paragraphs": on(scans.paragraphs, "text_lines", "page_info", "documents"),
        "p8_packing": on(packing.packing, "documents"),
        "p8_report": on(packing.report, "documents"),
        "p8_limits": on(packing.limits, "documents"),
        "p9_found": on(leaks.found, "documents", "eval_items"),
        "p9_cleaned": on(leaks.cleaned, "documents", "eval_items"),
        "p10_found": on(cuts.found, "documents"),
        "p10_sources": on(cuts.sources, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express over whole tables; the others are tested against brute force or held-out truth."""
    strip = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
    doc = f"select doc_id id, false c, {strip.format('feature')} f from doc_features where doc_id is not null and feature is not null"
    clu = f"select cluster_id id, true c, {strip.format('feature')} f from (select cluster_id, unnest(features) feature from clusters) where feature is not null"
    sets = "f as materialized (select distinct * from ({})), k as (select id, count(*) k from f group by 1 having count(*) > 5), fk as materialized (select * from f join k using (id))"
    sim = "sh as (select x.id a, y.id b, count(*) o, any_value(x.k) ka, any_value(y.k) kb from fk x join fk y on x.f = y.f and x.id < y.id and not (x.c and y.c) group by 1, 2)"
    p5 = f"{sets.format(f'{doc} union all {clu}')}, {sim}, p as materialized (select a, b from sh where 4 * o >= 3 * (ka + kb - o))"
    job = "(select distinct on (job_id) * from ocr_jobs where job_id is not null order by job_id, submitted_at desc nulls last)"
    return {
        "p1_found": f"""with p as (select file_name, count(distinct page_number) n from page_info group by 1),
x as (select job_id, coalesce(page_start, 0) s, case when total_pages > 0 then total_pages else coalesce(n, 0) end eof, page_end from {job} j left join p using (file_name)),
y as (select job_id, greatest(least(s, coalesce(page_end, eof)), 0) lo, least(greatest(s, coalesce(page_end, eof)), eof) hi from x) select job_id from y where hi - lo > 200""",
        "p3_found": f"""with recursive {sets.format(doc)}, {sim}, e as materialized (select a, b from sh where 2 * o >= ka + kb - o), bo as (select a, b from e union select b, a from e),
r(v, w) as (select a, a from bo union select r.v, bo.b from r join bo on bo.a = r.w) select v doc_id, min(w) group_id from r group by 1""",
        "p4_found": """with recursive s as (select least(cluster_a, cluster_b) a, greatest(cluster_a, cluster_b) b, arg_max(coalesce(case when isnan(score) then -1 else score end, -1), scored_at) s from cluster_pairs where cluster_a <> cluster_b group by 1, 2),
e as materialized (select a, b from s where s >= 0.8), bo as (select a, b from e union select b, a from e), r(v, w) as (select a, a from bo union select r.v, bo.b from r join bo on bo.a = r.w) select v cluster_id, min(w) group_id from r group by 1""",
        "p5_found": f"with {p5} select a id_a, b id_b from p",
        "p8_limits": r"select count(*) documents, 0::bigint over_tokens, 0::bigint over_documents, 0::bigint over_attention, 0::bigint broken from documents where regexp_matches(text, '\S')",
        "p5_links": f"""with {sets.format(f'{doc} union all {clu}')}, h as materialized (select id, any_value(c) c, md5(string_agg(f, chr(31) order by f)) h from fk group by 1), cl as materialized (select id, min(id) over (partition by h) class_id, count(*) over (partition by h) w from h),
rep as (select distinct class_id from cl), sh as (select x.id a, y.id b, count(*) o, any_value(x.k) ka, any_value(y.k) kb from (select * from fk where id in (select class_id from rep)) x join (select * from fk where id in (select class_id from rep)) y on x.f = y.f and x.id <> y.id group by 1, 2),
n as (select a class_id, sum(w)::bigint s from (select a, b from sh where 4 * o >= 3 * (ka + kb - o)) p join (select distinct class_id b, w from cl) c using (b) group by 1)
select id, class_id, w - 1 copies, coalesce(s, 0) "similar" from cl left join n using (class_id)""",
    }
