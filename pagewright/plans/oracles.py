"""The core queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..functions import text
from ..functions.language import LANGS, STOP_WORDS
from ..operators.features import WEIGHTS
from ..operators.ingest import STATEMENT_SENTENCES
from .queries import PAGES, SAMPLES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def fold(x: str) -> str:
    return f"replace(translate({x}, {lit(text.VOWELS[0])}, {lit(text.VOWELS[1])}), 'œ', 'oe')"


def enumerator(x: str, word: str = "") -> str:
    low = strip(f"lower({x})")
    found = [f"nullif(regexp_extract({low}, {lit(p)}, {g}), '')" for p, g in text.enumerator_patterns(word)]
    odd = f"case when left({x}, 1) in (chr(65533), chr(61623)) then left({x}, 1) end"
    return f"coalesce({', '.join([*found, odd])})"


def enumerator_by_language(x: str, lang: str) -> str:
    de, one = enumerator(x, text.note_word("deu")), enumerator(x, text.note_word("fra"))
    return f"case when {lang} in ('de', 'deu') then {de} when {lang} in ('fr', 'fra', 'en', 'eng') then {one} else {enumerator(x)} end"


def signs(x: str) -> str:
    for a, b in text.SIGN_WORDS:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def enumerator_type(x: str) -> str:
    """x: a simple column; the steps are columns of nested selects, so this returns a scalar subquery."""
    return (
        f"(select {signs('t3')} from (select case when length(regexp_extract(t2, '^([a-z]*)', 1)) = 1 then replace(t2, regexp_extract(t2, '^([a-z]*)', 1), ' lettre ') else t2 end t3 "
        f"from (select list_reduce(regexp_extract_all(t1, '([0-9]+)', 1), lambda acc, y: replace(acc, y, ' cardinal '), t1) t2 "
        f"from (select list_reduce(regexp_extract_all(t0, '([ivxl]+)', 1), lambda acc, y: replace(acc, y, ' romain '), t0) t1 from (select {strip(f'lower({x})')} t0)))))"
    )


def strip_dates(x: str) -> str:
    m = lambda t, p: strip(f"regexp_extract(' ' || {t} || ' ', {lit(p)}, 1)")
    step = lambda t, p: f"case when {m(t, p)} <> '' then {strip(f'replace({t}, {m(t, p)}, {lit(str())})')} else {t} end"
    return f"(select {step('d1', text.DATE_2)} from (select {step('d0', text.DATE_4)} d1 from (select {x} d0)))"


def strip_numbers(x: str) -> str:
    one = f"regexp_replace(' ' || {x} || ' ', {lit(text.NUMBER_1)}, '', 'g')"
    return strip(f"regexp_replace(' ' || {one} || ' ', {lit(text.NUMBER_2)}, '', 'g')")


TEXTS = "select distinct text from (select text from text_lines union all select * from (values " + ", ".join(f"({lit(s)})" for s in SAMPLES) + ") s(text)) where text is not null"
PAGE = "(select distinct * from page_info)"
LINES = f"(select distinct l.*, p.page_width, p.page_height, p.orientation, p.language from (select distinct * from text_lines) l left join {PAGE} p using (file_name, page_number))"
DOC = "(select distinct on (file_name) * from docs where file_name is not null order by file_name, received_at desc nulls last)"
DOC_BY_ID = "(select distinct on (doc_id) * from docs where doc_id is not null order by doc_id, received_at desc nulls last)"
COMPANY = "(select company_id, max(company_name) company_name, max(company_industry) company_industry from (select distinct on (company_id) * from companies where company_id is not null order by company_id, company_name desc nulls last, company_industry desc nulls last) group by 1)"
KEPT = f"(select * from {LINES} k where not exists (select 1 from text_lines b where b.file_name = k.file_name and b.page_number = k.page_number and b.text in ({', '.join(map(lit, STATEMENT_SENTENCES))})))"
KEY = strip("lower(feature)")
WEIGHT = "case type " + " ".join(f"when '{k}' then {w}" for k, w in WEIGHTS.items()) + " else 1 end"
CLEAN = f"(select *, {WEIGHT} weight from (select doc_id id, {KEY} feature, min(type) type, min(level) level, max(value) value, max(frequency) frequency from doc_features where doc_id is not null and feature is not null group by 1, 2))"
TOP = f"(select id, feature, weight from {CLEAN} where level = 'cluster')"
ASSIGNED = "(select id, min(cluster_id) cluster_id from (select cluster_id, unnest(documents) id from clusters) where id is not null group by 1)"
BASE = f"""top as materialized (select * from {TOP}), asg as materialized (select * from {ASSIGNED}),
size as (select cluster_id, count(distinct id) n from asg where cluster_id <> 0 group by 1),
parts as materialized (select cluster_id, feature, max(weight) weight, count(distinct id) df, any_value(n) n from top join asg using (id) join size using (cluster_id) group by 1, 2)"""
SCORES = f"""{BASE}, wc as (select cluster_id, sum(weight) wc from parts group by 1), wd as (select id, sum(weight) wd, count(*) k from top group by 1),
s as materialized (select id, cluster_id, any_value(n) n, sum(parts.weight * df) s from top join parts using (feature) group by 1, 2),
sc as materialized (select id, cluster_id, 2 * s / (n * (wc + wd)) score from s join wc using (cluster_id) join wd using (id) where 200 * s >= 83 * n * (wc + wd))"""
LINKS = "e as materialized (select distinct cluster_a a, cluster_b b from cluster_pairs where score >= 0.8 and not isnan(score) and cluster_a <> cluster_b)"
COMP = f"{LINKS}, both_ as (select a, b from e union select b, a from e), r(v, w) as (select a, a from both_ union select r.v, both_.b from r join both_ on both_.a = r.w), comp as (select v, min(w) label from r group by 1)"
SURVIVE = f"{COMP}, sv as (select label, min(v) survivor from comp where v in (select greatest(a, b) from e) group by 1), survive as (select v cluster_id, survivor from comp join sv using (label))"
NUMBERED = f"""low as materialized (select *, {fold(strip('lower(text)'))} low from {KEPT}),
en as materialized (select *, {enumerator_by_language('low', 'language')} enum from low),
ru as materialized (select *, {strip("replace(low, enum, '')")} rest from en where enum is not null and trim(enum) not in ({', '.join(map(lit, text.NOT_ENUMERATORS))})),
nu as materialized (select * from ru where regexp_matches(lower(rest), '[a-z''\\-]+')),
st as materialized (select *, {strip_numbers(strip_dates('rest'))} s from nu),
sub as materialized (select *, length({strip('s')}) > 5 and right(s, 1) <> '.' and left(text, 1) = upper(left(text, 1)) ok from st)"""
HTML = """h as materialized (select doc_id, '<p>' || regexp_replace(text, '[<>&]', ' ', 'g') || '</p>' || case when contains(text, '2015') then '<img src="a.png"><img alt="x">' else '' end html,
 list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]'), lambda x: trim(x) <> '') words from documents where text is not null
 union all select -i, page, list_filter(string_split(repeat('w ', n), ' '), lambda x: x <> '') from (values """ + ", ".join(f"({i}::bigint, {n}, {lit(h)})" for i, (n, h) in enumerate(PAGES, 1)) + """) v(i, n, page))"""


def plain(html: str) -> str:
    t = f"regexp_replace({html}, '(?s)<[^>]*>', '', 'g')"
    for a, b in (("&nbsp;", " "), ("&#xa0;", " "), (" ", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = f"replace({t}, {lit(a)}, {lit(b)})"
    return t


def words(t: str) -> str:
    return f"len(list_filter(regexp_split_to_array({t}, '[ \\n\\r\\t]'), lambda x: trim(x) <> ''))"


def chars(t: str) -> str:
    return f"length(regexp_replace({t}, '[ \\n\\r]', '', 'g'))"


def trunc2(x: str) -> str:
    return f"(trunc(({x}) * 100) / 100)"


TOKENS = "tok as materialized (select doc_id id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-zà-ÿ]+', ' ', 'g'), ' ')) token from documents where text is not null), tk as materialized (select * from tok where token <> '')"
VOCAB = f"""{TOKENS}, lg as (select doc_id id, case when c in ('fr', 'fra', 'fre', 'french') then 'fra' when c in ('en', 'eng', 'english') then 'eng' when c in ('de', 'deu', 'ger', 'german') then 'deu' end lang
 from (select doc_id, regexp_replace(lower({strip('lang')}), '[-_].*$', '') c from documents where text is not null)),
vocab as materialized (select lang, token from (select distinct * from tk) join lg using (id) where lang is not null group by 1, 2 having count(*) >= 20)"""
STOP = "stop as (select * from (values " + ", ".join(f"('{k}', {lit(t)})" for k, v in STOP_WORDS.items() for t in v) + ") s(lang, token))"


def page_language(name: str, vocab: str) -> str:
    counts = ", ".join(f"count(case when x.lang = '{k}' then 1 end) {k}" for k in LANGS)
    best, total = f"greatest({', '.join(LANGS)})", " + ".join(LANGS)
    which = " ".join(f"when {k} = {best} then '{k}'" for k in LANGS)
    return (
        f"{name}_x as (select token, min(lang) lang from (select distinct * from {vocab}) group by 1 having count(*) = 1), "
        f"{name}_c as (select id, {counts} from tk left join {name}_x x using (token) group by 1), "
        f"{name} as (select id, case when {total} = 0 then '{LANGS[0]}' {which} end \"language\", case when {total} = 0 then 0.0 else floor({best} * 100 / ({total})) / 100 end confidence from {name}_c)"
    )


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["parse_wide_column"] = "select * from (values (1::bigint, 1.0::double, 2.0::double), (2, 3.5, null), (3, 7.0, null), (4, null, null)) t(id, a, b)"
    o["lines_with_pages"] = f"select file_name, page_number, line_number, text, \"language\", orientation, page_width from {LINES}"
    o["lines_with_docs"] = f"select l.file_name, page_number, line_number, doc_id, company_id, document_year from (select distinct * from text_lines) l left join {DOC} d using (file_name)"
    o["docs_with_company"] = f"select distinct doc_id, file_name, d.company_id, company_name, company_industry, document_year from docs d left join {COMPANY} c using (company_id)"
    o["unmatched_keys"] = "select distinct company_id from docs d where not exists (select 1 from companies c where c.company_id = d.company_id)"
    o["filter_lang"] = f"select file_name, page_number, line_number from {LINES} where \"language\" = 'fra'"
    o["filter_type_contains"] = "select distinct doc_id, file_name, document_type from docs where contains(document_type, 'eCDF')"
    o["filter_industry"] = f"select distinct doc_id, company_id from docs join {COMPANY} c using (company_id) where company_industry = 'holding'"
    o["last_doc_per_company"] = "select distinct company_id, document_year, doc_id from (select *, max(document_year) over (partition by company_id) m from docs where company_id is not null) where document_year = m"
    o["dataset_prefix"] = "select doc_id, count(*) n from docs where doc_id in (select doc_id from (select distinct doc_id from docs where doc_id is not null) order by doc_id limit (select floor(count(distinct doc_id) * 0.25)::bigint from docs)) group by 1"
    o["documents_without_company"] = "select count(*) filter (company_id is null) skipped from docs"
    o["skip_statement_pages"] = f"""with x as (select distinct * from text_lines), bad as (select file_name, page_number from x where line_number = 1 and page_number % 2 = 0 union select file_name, page_number from x where text in ({', '.join(map(lit, STATEMENT_SENTENCES))}))
select file_name, count(*) "lines", count(distinct page_number) pages from x where (file_name, page_number) not in (select * from bad) group by 1"""
    o["layout_page_scope"] = "select file_name, page_number from (select *, dense_rank() over (partition by file_name order by page_number) r, count(*) over (partition by file_name) n from (select distinct file_name, page_number from text_lines)) where r <= 2 or page_number = n - 1"
    o["new_files_only"] = "select distinct file_name from docs where file_name not in (select file_name from page_info where file_name is not null)"
    job = "(select distinct on (job_id) * from ocr_jobs where job_id is not null order by job_id, submitted_at desc nulls last)"
    o["latest_jobs"] = f"select job_id, file_name, page_start, page_end, total_pages from {job}"
    o["page_windows"] = f"select job_id, w::int \"window\", page_start + w * 200 + 1 page_from, least(page_start + w * 200 + 200, total_pages) page_to from (select job_id, page_start, total_pages, unnest(range(0, ((total_pages - page_start - 1) // 200) + 1))::int w from {job} where page_start < total_pages)"
    o["load_dataset"] = f"""with d as (select f.*, company_name from {DOC} f left join {COMPANY} c using (company_id) where contains(document_type, 'eCDF')), k as (select * from (select *, max(document_year) over (partition by company_id) m from d where company_id is not null) where document_year = m)
select file_name, company_id, company_name, count(*) "lines" from {LINES} join k using (file_name) where "language" = 'eng' group by 1, 2, 3"""

    def scalar(name: str, e: str) -> None:
        o[name] = f"select text, {e} \"value\" from ({TEXTS})"

    scalar("vowel_fold", fold("lower(text)"))
    scalar("enumerator_match", enumerator("text"))
    scalar("enumerator_match_note", enumerator("text", text.note_word("fra")))
    scalar("enumerator_type", enumerator_type("text"))
    scalar("strip_dates", strip_dates("lower(text)"))
    scalar("strip_numbers", strip_numbers("lower(text)"))
    scalar("find_numbers", "array_to_string(list_concat(" + ", ".join(f"regexp_extract_all(' ' || lower(text) || ' ', {lit(p)}, 1)" for p in (text.NUMBER_1, text.NUMBER_2)) + "), '|')")
    scalar("has_text", "regexp_matches(lower(text), '[a-z''\\-]+')")
    scalar("special_chars", signs("text"))
    scalar("plain_quotes", "translate(text, '‘’—', '''''-')")
    scalar("first_ten_tokens", "array_to_string(list_slice(string_split(text, ' '), 1, 10), ' ')")
    scalar("cut_colon", "split_part(text, ':', 1)")
    o["next_line"] = "select *, lead(text) over (partition by file_name, page_number order by line_number) next_text from (select distinct file_name, page_number, line_number, text from text_lines)"
    o["line_renumber"] = "select file_name, page_number, line_number, count(*) over (partition by file_name, page_number order by y range between unbounded preceding and current row) - 1 line_index from (select distinct file_name, page_number, line_number, y from text_lines)"
    box = lambda v, s: f"case when {s} > 0 then trunc(1000 * {v} / {s})::int end n_{v}"
    o["normalize_bbox"] = f"select file_name, page_number, line_number, {box('x', 'page_width')}, {box('y', 'page_height')}, {box('x2', 'page_width')}, {box('y2', 'page_height')} from {LINES}"
    o["orientation"] = f"select file_name, page_number, case when angle in (90, 270) then 'L' when page_height > page_width then 'P' else 'L' end \"value\" from {PAGE}"
    o["word_mode"] = "select file_name, page_number, block_num, line_num, (row_number() over (partition by file_name, page_number, block_num, line_num order by top_px, word_num, left_px, text) - 1)::int line_index, text, left_px x, top_px y, width_px w, height_px h from (select distinct file_name, page_number, block_num, line_num, word_num, text, left_px, top_px, width_px, height_px from words where trim(text) <> '')"
    o["page_record"] = f"select file_name, page_number, orientation, \"language\", content_type, encrypted, number_images from {PAGE}"
    o["exclusive_vocab"] = f"with {VOCAB} select min(lang) lang, token from (select distinct * from vocab) group by token having count(*) = 1"
    o["language_id"] = f"with {TOKENS}, {STOP}, {page_language('p', 'stop')} select * from p"
    o["language_id_two_stage"] = f"with {VOCAB}, {STOP}, {page_language('p', 'stop')}, {page_language('v', 'vocab')} select id, case when p.confidence < 0.4 then v.\"language\" else p.\"language\" end \"language\", case when p.confidence < 0.4 then v.confidence else p.confidence end confidence from p join v using (id)"
    lost = plain("replace(replace(html, '&#xfffd', ''), ';', ' ')")
    o["content_type"] = f"""with {HTML}, c as (select doc_id, html, len(words) o, {words(plain('html'))} n, {words(lost)} pw, {chars(lost)} pc, list_reduce(list_transform(words, lambda x: length(x)), lambda a, b: a + b, 0) oc, len(string_split(html, '&#xfffd')) pieces from h),
r as (select *, n / o r, case when n > 0 then o / n else 0.0 end k from c)
select doc_id, case when o = 0 then 'E' when contains(html, '&#xfffd;&#xfffd;&#xfffd') then 'X' when r < 0.5 then 'S' when r < 0.6 or k < 0.6 then 'C' when r < 0.75 or k < 0.75 then 'B' else 'R' end content_type,
round(case when o = 0 then case when n > 0 then 0.5 else 1.0 end when contains(html, '&#xfffd;&#xfffd;&#xfffd') then case when pw > o then case when floor({trunc2('(oc - pc) / oc')} * 100) = 0 then floor(pieces / oc * 10000) / 10000 else {trunc2('(oc - pc) / oc')} end else {trunc2('(o - pw) / o')} end
when r < 0.5 then {trunc2('(o - n) / o')} else {trunc2('least(r, k)')} end, 4) confidence from r"""
    o["html_word_count"] = f"with {HTML} select doc_id, {words(plain('html'))}::int words, {chars(plain('html'))}::int chars from h"
    o["image_count"] = f"with {HTML} select doc_id, case when regexp_matches(lower(html), '<p[\\s>]') then len(regexp_extract_all(html, '(?i)(<img\\b[^>]*src=[^>]*>)', 1)) else 0 end::int images from h"

    out = lambda name, value="null::double", freq="1::int": f"file_name, {name} feature, {value} \"value\", {freq} frequency"
    o["feature_page"] = f"select distinct {out(chr(39) + 'language_' + chr(39) + ' || page_number || ' + chr(39) + '_' + chr(39) + ' || \"language\"')} from {KEPT} where \"language\" is not null union all select distinct {out(chr(39) + 'orientation_' + chr(39) + ' || page_number || ' + chr(39) + '_' + chr(39) + ' || orientation')} from {KEPT} where orientation is not null"
    scope = f"kept as materialized (select * from {KEPT}), sc as (select * from (select *, dense_rank() over (partition by file_name order by page_number) r, count(*) over (partition by file_name) n from (select distinct file_name, page_number from kept)) where r <= 2 or page_number = n - 1), ls as materialized (select kept.* from kept join sc using (file_name, page_number))"
    o["feature_position"] = f"with {scope} select {out(chr(39) + 'xPos_' + chr(39) + ' || x', 'x::double', 'count(*)::int')} from (select file_name, page_number, y, min(x) x from ls group by 1, 2, 3) where x < 500 group by file_name, x"
    size = lambda c, n, least: f"select {out(chr(39) + n + '_' + chr(39) + f' || {c}::double', f'{c}::double', 'sum(k)::int')} from (select file_name, page_number, {c}, count(*) k from ls group by 1, 2, 3 having count(*) > {least}) group by file_name, {c}"
    o["feature_size"] = f"with {scope} {size('w', 'wSize', 1)} union all {size('h', 'hSize', 0)}"
    o["feature_enumerator"] = f"with {NUMBERED} select distinct {out(chr(39) + 'enum_' + chr(39) + ' || ' + enumerator_type('enum'))} from nu"
    o["feature_subtitle"] = f"with {NUMBERED} select distinct {out(chr(39) + 'subtitle_' + chr(39) + ' || s')} from sub where ok"
    o["feature_text"] = f"""with {NUMBERED}, nx as (select file_name, page_number, line_number, lead(text) over (partition by file_name, page_number order by line_number) next_text from {KEPT}),
tx as materialized (select file_name, "language", {strip('lower(next_text)')} n_low from sub join nx using (file_name, page_number, line_number) where ok and next_text is not null),
ty as materialized (select file_name, array_to_string(list_slice(string_split({strip_numbers(strip_dates('n_low'))}, ' '), 1, 10), ' ') t from tx where ({enumerator_by_language('n_low', '"language"')}) is null)
select distinct {out(chr(39) + 'text_' + chr(39) + f" || case when contains(t, ':') then {strip('split_part(t, chr(58), 1)')} else t end")} from ty where length(t) > 4 and regexp_matches(lower(t), '[a-z''\\-]+')"""
    o["feature_title"] = f"""with {NUMBERED}, few as (select file_name from sub where ok group by 1 having count(distinct s) >= 3),
ti as materialized (select file_name, text, {strip_numbers(strip_dates('low'))} t from low where x < page_width / 3 and w < page_width / 3 and file_name not in (select file_name from few))
select distinct {out(chr(39) + 'title_' + chr(39) + " || split_part(t, ':', 1)")} from ti where length(t) > 4 and regexp_matches(lower(t), '[a-z''\\-]+') and right(t, 1) <> '.' and left(text, 1) = upper(left(text, 1))"""
    kinds = {"page": "cluster", "position": "subcluster", "size": "subcluster", "enumerator": "cluster", "subtitle": "cluster", "text": "subcluster", "title": "cluster"}
    every = " union all ".join(f"select file_name, '{k}' \"type\", '{v}' \"level\" from ({o['feature_' + k]})" for k, v in kinds.items())
    o["extract_features"] = f"select file_name, \"type\", \"level\", count(*) n from ({every}) group by 1, 2, 3"
    o["clean_features"] = f"select id, feature, type, level, frequency, weight::int weight from {CLEAN}"

    pairs = f"top as materialized (select * from {TOP}), tot as (select id, sum(weight) w from top group by 1), sh as (select x.id a, y.id b, sum(x.weight) s from top x join top y on x.feature = y.feature and x.id < y.id group by 1, 2), pr as materialized (select a, b, 2 * s / (p.w + q.w) score from sh join tot p on p.id = a join tot q on q.id = b where 200 * s >= 83 * (p.w + q.w))"
    o["similarity_pairs"] = f"with {pairs} select a, b, round(score, 6) score from pr"
    o["document_groups"] = f"with recursive {pairs}, bo as (select a, b from pr union select b, a from pr), r(v, w) as (select a, a from bo union select r.v, bo.b from r join bo on bo.a = r.w), c as (select v, min(w) label from r group by 1) select v id, label, count(*) over (partition by label) size from c"
    o["soft_value_similarity"] = f"with f as materialized (select id, feature, value from {CLEAN} where type in ('position', 'size') and value is not null) select x.id a, count(distinct y.id) others, count(*) matches from f x join f y on x.id <> y.id and abs(x.value - y.value) <= 5 and contains(y.feature, split_part(x.feature, '_', 1)) group by 1"
    o["size_ratio_filter"] = "with n as (select cluster_id, max(len(list_distinct(features)) + (list_contains(list_transform(features, lambda x: x is null), true))::int) n from clusters group by 1) select a, b, x.n na, y.n nb from (select distinct cluster_a a, cluster_b b from cluster_pairs) p join n x on x.cluster_id = a join n y on y.cluster_id = b where least(x.n, y.n) * 10 >= greatest(x.n, y.n) * 8"
    o["assign_first_match"] = f"with {SCORES} select id, cluster_id, round(score, 6) score from (select *, row_number() over (partition by id order by cluster_id) r from sc) where r = 1"
    o["assign_best_match"] = f"with {SCORES} select id, cluster_id, round(score, 6) score from (select *, row_number() over (partition by id order by score desc, cluster_id desc) r from sc) where r = 1"
    o["append_assignment"] = f"with {SCORES}, b as (select id, cluster_id, score from (select *, row_number() over (partition by id order by score desc, cluster_id desc) r from sc) where r = 1) select id, case when k <= 5 then 0 else coalesce(cluster_id, -id) end cluster_id, round(case when k <= 5 then 0.0 else coalesce(score, 1.0) end, 6) score from wd left join b using (id)"
    o["cluster_contribution"] = f"with {BASE} select cluster_id, feature, df, n, round(df / n, 6) contribution from parts"
    o["cluster_affinity"] = f"with {BASE} select cluster_id, max(n) n, count(*) features, round(sum(df) / (max(n) * count(*)), 6) affinity from parts group by 1"
    o["prune_features"] = f"with {BASE} select cluster_id, feature, df, n from parts where n <= 4 or df > 2"
    o["pruned_affinity"] = f"""with {BASE}, k as (select * from parts where n <= 4 or df > 2), cv as (select cluster_id, count(distinct id) covered from top join asg using (id) join k using (cluster_id, feature) group by 1), s as (select cluster_id, count(*) f, sum(df) s from k group by 1)
select cluster_id, coalesce(f, 0) features, coalesce(covered, 0) covered, round(case when covered > 0 then s / (b * covered) else 0.0 end, 6) affinity from (select cluster_id, count(*) b from parts group by 1) left join s using (cluster_id) left join cv using (cluster_id)"""
    o["merge_edges"] = f"""with {BASE}, t as (select cluster_id c, sum(weight) w, count(*) k from parts group by 1), sh as (select x.cluster_id a, y.cluster_id b, sum(y.weight * y.df) / any_value(y.n) s from parts x join parts y on x.feature = y.feature and x.cluster_id > y.cluster_id group by 1, 2)
select a, b, round(score, 6) score from (select a, b, 2 * s / (p.w + q.w) score, least(p.k, q.k) k from sh join t p on p.c = a join t q on q.c = b) where score >= (case when k < 10 then 0.84 else 0.8 end) - 1e-12"""
    o["components"] = f"with recursive {COMP} select v cluster_id, label from comp"
    o["merge_survivor"] = f"with recursive {SURVIVE} select cluster_id, survivor from survive"
    o["merged_clusters"] = f"with recursive {SURVIVE}, {BASE}, p as (select coalesce(survivor, cluster_id) to_, parts.* from parts left join survive using (cluster_id)), sz as (select to_, sum(n)::bigint n from (select distinct to_, cluster_id, n from p) group by 1) select to_ cluster_id, feature, sum(df)::bigint df, any_value(sz.n) n from p join sz using (to_) group by 1, 2"
    o["merged_average"] = f"with recursive {SURVIVE}, {BASE}, p as (select cluster_id, max(n) n, count(*) k from parts group by 1) select coalesce(survivor, cluster_id) cluster_id, sum(n)::bigint n, round(sum(n * k) / sum(n), 6) average_features from p left join survive using (cluster_id) group by 1"
    o["high_confidence_clusters"] = f"with {BASE}, a as (select cluster_id, max(n) n, sum(df) / (max(n) * count(*)) affinity from parts group by 1) select cluster_id, n, round(affinity, 6) affinity from a where affinity >= 0.83 and n > 1 and cluster_id > 0"
    o["company_accuracy"] = f"""with x as (select a.id, cluster_id, company_id, document_year from {ASSIGNED} a join {DOC_BY_ID} d on d.doc_id = a.id where company_id is not null), g as (select company_id, count(*) documents, count(distinct case when cluster_id > 0 then cluster_id end) clusters, count(distinct case when cluster_id > 0 then cluster_id || '/' || coalesce(document_year::varchar, '') end) subclusters from x group by 1)
select *, round(documents / nullif(clusters, 0), 6) per_cluster, round(documents / nullif(subclusters, 0), 6) per_subcluster from g"""
    o["pair_index"] = f"""with p as (select id, cluster_id p from {ASSIGNED}), t as (select doc_id id, company_id t from {DOC_BY_ID} where company_id is not null), b as materialized (select id, p, t from p full join t using (id)), np as (select p, count(*) n_p from b where p is not null group by 1), nt as (select t, count(*) n_t from b where t is not null group by 1), c as (select p, t, count(*) k from b where p is not null and t is not null group by 1, 2)
select id, round(coalesce(k / (n_p + n_t - k), 0.0), 6) "value" from b left join c using (p, t) left join np using (p) left join nt using (t)"""
    o["labelled_evaluation"] = f"select round(avg(\"value\"), 6) pair_index from ({o['pair_index'].replace('round(coalesce(k / (n_p + n_t - k), 0.0), 6)', 'coalesce(k / (n_p + n_t - k), 0.0)')})"
    o["high_confidence_detail"] = f"""with {BASE}, a as (select cluster_id, max(n) n, count(*) k, sum(df) / (max(n) * count(*)) affinity from parts group by 1)
select doc_id, cluster_id, a.n number_documents, k total_features_cluster, round(affinity, 6) affinity, file_name, company_id, document_year, document_type, document_link from a join asg using (cluster_id) left join {DOC_BY_ID} d on d.doc_id = asg.id where affinity >= 0.83 and a.n > 1 and cluster_id > 0"""
    o["prune_report"] = f"with {BASE} select count(distinct cluster_id) clusters, count(*) features, count(*) filter (df <= 2) cleaned, round(count(*) filter (df <= 2) / count(*), 6) ratio from parts where n > 4"
    o["working_data"] = "select count(distinct doc_id) documents, count(distinct company_id) companies from docs where contains(document_type, 'eCDF')"
    o["run_metrics"] = f"""with n as (select cluster_id c, count(*) n from {ASSIGNED} group by 1) select coalesce(sum(n), 0)::bigint documents, coalesce(sum(n) filter (c = 0), 0)::bigint noise, count(*) filter (c > 0) clusters, count(*) filter (c > 0 and n > 1) clusters_many, coalesce(sum(n) filter (c > 0 and n > 1), 0)::bigint documents_many, count(*) filter (c > 0 and n = 1) singles, round(coalesce(sum(n) filter (c > 0 and n > 1), 0) / sum(n), 6) share from n"""
    o["cluster_size_report"] = f"with a as materialized (select * from {ASSIGNED}) select cluster_id, count(*) n, floor(100 * count(*) / (select count(*) from a))::int percent from a where cluster_id > 0 group by 1 having count(*) > 1"
    o["member_report"] = f"select doc_id, cluster_id, file_name, company_id, document_type from {ASSIGNED} a join {DOC_BY_ID} d on d.doc_id = a.id where cluster_id > 0"
    o["label_headings"] = f"""with f as (select distinct id, feature from {CLEAN} where type in ('title', 'subtitle')), a as materialized (select * from {ASSIGNED} where cluster_id > 0), big as (select cluster_id from a group by 1 having count(*) >= 2), h as materialized (select cluster_id, id, feature from f join a using (id) join big using (cluster_id))
select cluster_id, feature, id from h join (select cluster_id, feature from h group by 1, 2 having count(*) >= 2) using (cluster_id, feature)"""
    return o
