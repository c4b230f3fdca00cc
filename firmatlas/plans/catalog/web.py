"""Queries over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmatlas.functions import html as H
from firmatlas.functions import names as N
from firmatlas.functions import phone as P
from firmatlas.functions import urls
from firmatlas.functions.text import each
from firmatlas.operators import contacts as C
from firmatlas.operators import frontier as FR
from firmatlas.operators import pages as PG
from firmatlas.operators import phones as PH
from firmatlas.operators.guard import suppress
from firmatlas.operators.resolve import clusters
from firmatlas.operators.skew import chunk_window, chunked, running_total
from firmatlas.plans.catalog.base import SQL_LINKS, SUFFIXES, query, sql_domain, sql_host, sql_page_key, sql_path, sql_query, sql_text, table
from firmatlas.plans.catalog.sql_names import names_in
from firmatlas.rules import vocab
from firmatlas.session import spread
from firmatlas.sinks.tables import reachability

_MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"


def _pages(spark, sf):
    return table(spark, sf, "pages")


@query("site_profile", f"""
with {SQL_LINKS.strip()},
 texts as (select page_id, {sql_domain('url')} as domain, {sql_text('html')} as text from pages),
 a as (select domain, count(*) as pages, sum(case when text = '' then 0 else len(string_split(text, chr(10))) end) as lines,
         count(*) filter (regexp_matches(text, '{_MAIL}')) as pages_with_email from texts group by 1),
 b as (select {sql_domain('url')} as domain, count(*) as links, count(distinct href) as targets from links group by 1)
select a.domain, a.pages, cast(a.lines as bigint) as lines, coalesce(b.links, 0) as links, coalesce(b.targets, 0) as targets,
   a.pages_with_email from a left join b using (domain)""")
def site_profile(spark, sf):
    return PG.site_profile(_pages(spark, sf), SUFFIXES)


@query("url_registrable_domain", f"select page_id, {sql_domain('url')} as domain, {sql_host('url')} as host from pages")
def url_registrable_domain(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.registrable_domain(u, SUFFIXES).alias("domain"), urls.host(u).alias("host"))


@query("url_page_key", f"select {sql_page_key('url')} as page_key, count(*) as n, min(page_id) as first_page from pages group by 1")
def url_page_key(spark, sf):
    keyed = table(spark, sf, "pages").select("page_id", urls.page_key(F.col("url")).alias("page_key"))
    return keyed.groupBy("page_key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


_NOSCHEME = "upper(regexp_replace(url, '^https?://', ''))"


@query("url_start_normalise", f"""
with s as (select page_id, 'https://' || lower(regexp_extract({_NOSCHEME}, '^([^/?#]*)', 1)) as head,
   regexp_extract({_NOSCHEME}, '^[^/?#]*([^?#]*)', 1) as p, regexp_extract({_NOSCHEME}, '^[^?#]*\\?([^#]*)', 1) as q from pages)
select page_id, head || case when p = '' then '/' else p end || case when q = '' then '' else '?' || q end as start_url,
   'http' || substr(head, 6) || case when p = '' then '/' else p end || case when q = '' then '' else '?' || q end as fallback from s""")
def url_start_normalise(spark, sf):
    bare = F.concat(F.lit("  "), F.upper(F.regexp_replace("url", "^https?://", "")), F.lit(" "))
    start = table(spark, sf, "pages").select("page_id", urls.start_url(bare).alias("start_url"))
    return start.withColumn("fallback", urls.http_fallback(F.col("start_url")))


def _sql_kind(text: str, path: str) -> str:
    late = f"case when regexp_matches({path}, '(?i)^/(?:en|fr|nl|es|it|pl|tr|ru|cs|da|sv|pt)(?:/|$)') then 1 else 0 end"
    whens_p = " ".join(f"when regexp_matches({text}, '{vocab.any_of(r.words, '(?i)')}') then {r.priority} + {late}" for r in vocab.PAGE_KIND_RULES)
    return f"cast(case {whens_p} else 9 end as integer)"


def _sql_kind_name(text: str) -> str:
    whens = " ".join(f"when regexp_matches({text}, '{vocab.any_of(r.words, '(?i)')}') then '{r.kind}'" for r in vocab.PAGE_KIND_RULES)
    return f"case {whens} else 'sonstige' end"


_P = f"(case when {sql_path('url')} = '' then '/' else {sql_path('url')} end)"


@query("page_kind_priority", f"""
with t as (select page_id, {_P} as p, {_P} || ' ' || regexp_extract(html, '<title>([^<]*)', 1) as t from pages)
select page_id, {_sql_kind('t', 'p')} as priority, {_sql_kind_name('t')} as kind from t""")
def page_kind_priority(spark, sf):
    rows = table(spark, sf, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)", 1))
    return PG.page_kinds(rows, F.col("title")).select("page_id", "priority", "kind")


@query("page_links", f"with {SQL_LINKS.strip()} select page_id, link_no, href, text, kind from links")
def page_links(spark, sf):
    return PG.page_links(_pages(spark, sf), SUFFIXES).select("page_id", "link_no", "href", "text", "kind")


@query("link_kind_counts", f"""with {SQL_LINKS.strip()}
select {sql_domain('url')} as domain, kind, count(*) as links, count(distinct href) as targets from links group by 1, 2""")
def link_kind_counts(spark, sf):
    links = PG.page_links(_pages(spark, sf), SUFFIXES).select(
        urls.registrable_domain(F.col("url"), SUFFIXES).alias("domain"), "kind", "href"
    )
    # (domain, kind, href) first: distinct counting of a hot site stays spread
    per_target = links.groupBy("domain", "kind", "href").agg(F.count("*").alias("n"))
    return per_target.groupBy("domain", "kind").agg(F.sum("n").alias("links"), F.count("*").alias("targets"))


_SKIP = f"""(regexp_matches(href, '{vocab.SKIP_EXTENSION}') or regexp_matches({sql_path('href')} || '?' || {sql_query('href')}, '{vocab.SKIP_PATH}')
   or ({sql_query('href')} <> '' and priority > 3))"""


@query("link_skip_filter", f"""
with {SQL_LINKS.strip()}, every as (select page_id, 'link' as origin, href, text from links union all select page_id, 'page', url, '' from pages),
 k as (select *, {_sql_kind("(case when " + sql_path('href') + " = '' then '/' else " + sql_path('href') + " end) || ' ' || text", sql_path('href'))} as priority from every)
select origin, priority, {_SKIP} as skipped, count(*) as n from k group by 1, 2, 3""")
def link_skip_filter(spark, sf):
    pages = _pages(spark, sf)
    links = PG.page_links(pages, SUFFIXES).select(F.lit("link").alias("origin"), "href", "text")
    every = links.unionByName(pages.select(F.lit("page").alias("origin"), F.col("url").alias("href"), F.lit("").alias("text")))
    kinds = every.withColumn("priority", urls.page_kind(F.col("href"), F.col("text"))["priority"])
    return kinds.groupBy("origin", "priority", urls.is_skipped_link(F.col("href"), F.col("priority")).alias("skipped")).agg(F.count("*").alias("n"))


@query("page_lines", f"""
with t as (select page_id, {sql_text('html')} as text from pages),
 s as (select page_id, [x for x in string_split(text, chr(10)) if x <> ''] as l from t)
select page_id, cast(generate_subscripts(l, 1) - 1 as integer) as line_no, unnest(l) as line from s""")
def page_lines(spark, sf):
    return PG.page_lines(_pages(spark, sf)).select("page_id", "line_no", "line")


@query("low_text_flag", f"""
with t as (select {sql_domain('url')} as domain, {sql_text('html')} as text from pages)
select domain, count(*) as pages, cast(sum(case when text = '' then 0 else len(string_split(text, chr(10))) end) as bigint) as lines,
   count(*) = 1 and sum(case when text = '' then 0 else len(string_split(text, chr(10))) end) < 15 as low_text from t group by 1""")
def low_text_flag(spark, sf):
    rows = _pages(spark, sf).withColumn("domain", urls.registrable_domain(F.col("url"), SUFFIXES))
    return PG.low_text_sites(rows, "domain")


def _site_links(spark, sf):
    base = urls.registrable_domain(F.col("url"), SUFFIXES)
    links = PG.page_links(_pages(spark, sf), SUFFIXES)
    return links.withColumn("site", base).withColumn("base_domain", base).withColumn("page_ord", F.col("page_id"))


_CANDIDATES = f"""
 c0 as (select {sql_domain('url')} as site, page_id, link_no, href, text, {_sql_kind("(case when " + sql_path('href') + " = '' then '/' else " + sql_path('href') + " end) || ' ' || text", sql_path('href'))} as priority
        from links where kind = 'internal'),
 c1 as (select *, {sql_page_key('href')} as page_key from c0 where not {_SKIP}),
 c2 as (select *, row_number() over (partition by site, page_key order by page_id, link_no) as rn from c1),
 c3 as (select site, page_key, href, page_id, link_no,
           case when regexp_matches({sql_path('href')}, '{vocab.PERSON_PATH}') then 5
                when priority = 9 and regexp_matches(text, '(?i)whatsapp|mobil|handy') then 5 else priority end as priority
        from c2 where rn = 1)"""


@query("frontier_topk", f"""
with {SQL_LINKS.strip()}, {_CANDIDATES.strip()},
 r as (select *, row_number() over (partition by site order by priority, page_id, link_no, page_key) as rank from c3)
select site, href, priority, cast(rank as integer) as rank from r where rank <= 7 and (priority < 9 or rank <= 5)""")
def frontier_topk(spark, sf):
    rows = FR.candidates(_site_links(spark, sf), site="site", suffixes=SUFFIXES)
    return FR.plan(rows, budget=8, loaded=1, site="site").select("site", "href", "priority", "rank")


@query("crawl_policy", f"""
with {SQL_LINKS.strip()},
 rules as (select distinct {sql_host('url')} as host, substr({sql_path('href')}, 1, 3) as prefix from links where link_no = 1)
select {sql_host('href')} as host, count(*) as permitted, count(distinct href) as targets from links l
where kind = 'internal' and not exists (select 1 from rules r where r.host = {sql_host('l.href')} and {sql_path('l.href')} like replace(r.prefix, '%', '\\%') || '%' escape '\\')
group by 1""")
def crawl_policy(spark, sf):
    links = PG.page_links(_pages(spark, sf), SUFFIXES)
    # robots rules derived from the pages: each page forbids everyone the area of its second link
    rules = (
        links.where(F.col("link_no") == 1)
        .groupBy(urls.host(F.col("url")).alias("host"), F.left(urls.path(F.col("href")), F.lit(3)).alias("path_prefix"))
        .agg(F.min("page_id").alias("rule_no"), F.lit("*").alias("agent"), F.lit(False).alias("allow"))
    )
    ok = FR.allowed(links.where(F.col("kind") == "internal"), rules, "firmatlas")
    per_target = ok.groupBy("host", "href").agg(F.count("*").alias("n"))
    return per_target.groupBy("host").agg(F.sum("n").alias("permitted"), F.count("*").alias("targets"))


@query("name_hints", f"""
with {SQL_LINKS.strip()}, {_CANDIDATES.strip()},
 hints as (select distinct {sql_domain('url')} as site, lower(regexp_extract({sql_host('url')}, '([^.]{{3,}})\\.example', 1)) as hint from pages)
select c3.site, count(*) as candidates, count(*) filter (hit) as hinted, cast(min(case when hit then least(priority, 4) else priority end) as integer) as best
from (select c3.*, coalesce((select bool_or(hint <> '' and contains(lower(c3.href), hint)) from hints h where h.site = c3.site), false) as hit from c3) c3 group by 1""")
def name_hints(spark, sf):
    rows = FR.candidates(_site_links(spark, sf), site="site", suffixes=SUFFIXES)
    hints = (
        table(spark, sf, "pages")
        .select(urls.registrable_domain(F.col("url"), SUFFIXES).alias("site"), F.regexp_extract(urls.host(F.col("url")), r"([^.]{3,})\.example", 1).alias("h"))
        .groupBy("site").agg(F.array(F.max("h")).alias("names"))
    )
    promoted = FR.promote_hints(rows.withColumn("text", F.lit("")), hints, "site")
    return promoted.groupBy("site").agg(
        F.count("*").alias("candidates"), F.count_if("hinted").alias("hinted"), F.min("priority").alias("best")
    )


def _texts(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id").select(F.col("source").alias("company_id"), F.col("doc_id").alias("page_id"), "text", F.lit("").alias("url"))
    pages = spread(_pages(spark, sf), "page_id").select(F.lit("pages").alias("company_id"), "page_id", H.visible_text(F.col("html")).alias("text"), "url")
    return docs.unionByName(pages).withColumn("page_ord", F.col("page_id"))


_TEXTS = f"texts as (select source as company_id, doc_id as page_id, text from documents union all select 'pages', page_id, {sql_text('html')} from pages)"
_W = r"[\p{L}\p{N}_-]"
_HIDDEN = (
    r"(?i)([\p{L}\p{N}_.+-]+)\s*(?:" + vocab.EMAIL_AT + r")\s*(" + _W + r"+(?:\s*(?:" + vocab.EMAIL_DOT + r"|\.)\s*" + _W + "+)+)"
)
_REBUILT = (
    f"replace(lower(regexp_extract(x, '{_HIDDEN}', 1) || '@' || regexp_replace(regexp_extract(x, '{_HIDDEN}', 2), "
    rf"'(?i)\s*(?:{vocab.EMAIL_DOT})\s*', '.', 'g')), ' ', '')"
)
_FOUND = f"""{_TEXTS}, m as (select company_id, page_id, [lower(x) for x in regexp_extract_all(text, '{_MAIL}')] || [{_REBUILT} for x in regexp_extract_all(text, '{_HIDDEN}')] as l from texts),
 e as (select company_id, page_id, unnest(l) as email, generate_subscripts(l, 1) as pos from m),
 f as (select * from e where not regexp_matches(email, '{vocab.IMAGE_SUFFIX}'))"""


@query("emails_found", f"with {_FOUND} select company_id, page_id, email, count(*) as n from f group by 1, 2, 3")
def emails_found(spark, sf):
    found = C.page_emails(_texts(spark, sf))
    return found.groupBy("company_id", "page_id", "email").agg(F.count("*").alias("n"))


@query("emails_first_seen", f"with {_FOUND} select company_id, email, min(page_id) as first_page from f group by 1, 2")
def emails_first_seen(spark, sf):
    return C.emails_first_seen(C.page_emails(_texts(spark, sf))).select("company_id", "email", F.col("first_at.page_id").alias("first_page"))


_US = r"\+1[\s\-.]*\(?\d{3}\)?[\s\-.]*\d{3}[\s\-.]*\d{4}"
# matches with the text since the previous match, as the sentinel split gives them
_US_SQL = f"""
 li as (select company_id, page_id, [trim(x) for x in string_split(text, chr(10)) if trim(x) <> ''] as lines from texts),
 ln as (select company_id, page_id, generate_subscripts(lines, 1) - 1 as line_no, unnest(lines) as line, lines from li),
 pc as (select company_id, page_id, line_no, line, case when line_no > 0 then lines[line_no] else '' end as previous,
          string_split(regexp_replace(line, '({_US})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as p from ln where regexp_matches(line, '{_US}')),
 hit as (select company_id, page_id, line_no, previous, unnest(list_slice(p, 2, len(p))) as piece, generate_subscripts(list_slice(p, 2, len(p)), 1) as no, p from pc),
 us as (select company_id, page_id, line_no, no - 1 as match_no, split_part(piece, chr(2), 1) as raw, previous,
          case when no = 1 then p[1] else split_part(p[no], chr(2), 2) end as gap,
          replace(array_to_string(list_slice(p, 1, no), ''), chr(2), '') as before from hit)"""
_LABEL_RE2 = f"(?i){vocab.phrases(vocab.PHONE_LABELS)}"
_NOT_RE2 = f"(?i){vocab.phrases(vocab.NOT_A_PHONE)}"


def _sql_label(word: str) -> str:
    w = f"replace(lower({word}), ' ', '')"
    return f"""case when regexp_matches({w}, '^(?:mobil|handy|cell)') then 'Mobil' when {w} like 'whats%' then 'WhatsApp' when contains({w}, 'fax') then 'Fax'
      when regexp_matches({w}, '^(?:notdienst|notruf|bereitschaft)') then 'Notdienst'
      when regexp_matches({w}, '^(?:tel|fon|phone|zentrale|festnetz|büro|durchwahl|hotline)') then 'Tel' else {word} end"""


_US_NUMBERS = f"""{_US_SQL},
 lab as (select *, coalesce(regexp_extract_all(right(gap, 30), '{_LABEL_RE2}')[-1],
           case when length(previous) <= 25 then regexp_extract_all(previous, '{_LABEL_RE2}')[1] end) as word from us
         where not (regexp_matches(right(before, 40), '{_NOT_RE2}') and not regexp_matches(right(gap, 25), '{_LABEL_RE2}'))
           and regexp_matches(regexp_replace(raw, '\\D', '', 'g'), '^1[2-9]')),
 num as (select company_id, page_id, line_no, match_no, raw, {_sql_label('word')} as label, '+' || regexp_replace(raw, '\\D', '', 'g') as e164 from lab),
 numbers as (select * from num where label is null or label <> 'Fax')"""


def _numbers(spark, sf):
    docs = _texts(spark, sf).withColumn("lines", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).withColumn("kind", F.lit("kontakt"))
    return PH.text_numbers(PH.nearest_person(PH.number_lines(docs, P.NORTH_AMERICA)))


@query("phones_found", f"""with {_TEXTS}, {_US_NUMBERS}
select company_id, page_id, cast(line_no as integer) as line_no, cast(match_no as integer) as match_no, e164,
   '(' || substr(e164, 3, 3) || ') ' || substr(e164, 6, 3) || '-' || substr(e164, 9) as national, label from numbers""")
def phones_found(spark, sf):
    return _numbers(spark, sf).select("company_id", "page_id", "line_no", "match_no", "e164", "national", "label")


@query("phones_per_page", f"""with {_TEXTS}, {_US_NUMBERS}
select company_id, page_id, e164, max(label) as label, count(*) as n from
 (select company_id, page_id, e164, first_value(label) over (partition by company_id, page_id, e164 order by label is null, line_no, match_no) as label from numbers)
group by 1, 2, 3""")
def phones_per_page(spark, sf):
    found = _numbers(spark, sf).drop("person_line").withColumn("person", F.lit(None).cast("string"))
    folded = PH.dedupe_page_numbers(found)
    counts = found.groupBy("company_id", "page_id", "e164").agg(F.count("*").alias("n"))
    return folded.join(counts, ["company_id", "page_id", "e164"]).select("company_id", "page_id", "e164", "label", "n")


@query("phone_best_per_source", f"""with {_TEXTS}, {_US_NUMBERS},
 r as (select *, row_number() over (partition by company_id, e164 order by label is null, page_id, line_no, match_no) as rn from numbers)
select company_id, e164, raw, label from r where rn = 1""")
def phone_best_per_source(spark, sf):
    found = _numbers(spark, sf).withColumn("person", F.lit(None).cast("string"))
    at = F.struct("page_ord", "page_id", "part", "line_no", "match_no")
    return PH.best_numbers(found, ["company_id"], at).select("company_id", "e164", "raw", "label")


_AT = "company_id, page_id, line_no"


@query("phone_nearest_name", f"""with {_TEXTS}, {_US_NUMBERS},
 near as (select distinct n.company_id, n.page_id, n.line_no - back as line_no from us n, range(5) t(back) where n.line_no - back >= 0),
 src as (select row_number() over () as id, company_id, page_id, line_no, line from ln join near using (company_id, page_id, line_no)), {names_in('src')},
 here as (select {_AT}, arg_min(name, no) as first_name, arg_max(name, no) as last_name from src_names join src using (id) group by all),
 hits as (select row_number() over () as id, numbers.*, replace(us.before, chr(2), '') as line from numbers join us using (company_id, page_id, line_no, match_no)), {names_in('hits')},
 ahead as (select id, arg_max(name, no) as name from hits_names group by 1),
 back as (select h.id, arg_max(b.last_name, b.line_no) as name from hits h join here b on b.company_id = h.company_id and b.page_id = h.page_id and b.line_no between h.line_no - 3 and h.line_no - 1 group by 1)
select hits.company_id, hits.page_id, cast(hits.line_no as integer) as line_no, cast(match_no as integer) as match_no, e164, coalesce(ahead.name, here.first_name, back.name) as person
from hits left join ahead using (id) left join here on here.company_id = hits.company_id and here.page_id = hits.page_id and here.line_no = hits.line_no left join back on back.id = hits.id""")
def phone_nearest_name(spark, sf):
    """Numbers with the name closest before them, in texts of every source."""
    return _numbers(spark, sf).select("company_id", "page_id", "line_no", "match_no", "e164", "person")


@query("suppression_anti", f"""with {_FOUND},
 flagged as (select email from f join labels on page_id = doc_id where company_id <> 'pages' and toxic = 1),
 hosts as (select regexp_extract(email, '@([^@]*)$', 1) as host from f where company_id = 'pages')
select company_id, page_id, email from f where email not in (select email from flagged) and regexp_extract(email, '@([^@]*)$', 1) not in (select host from hosts)""")
def suppression_anti(spark, sf):
    """Objections: addresses in documents flagged as toxic, and all hosts written on pages."""
    found = C.page_emails(_texts(spark, sf)).select("company_id", "page_id", "email")
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    flagged = found.where("company_id <> 'pages'").join(toxic, "page_id", "left_semi").select(F.lit("email").alias("kind"), F.col("email").alias("key"))
    hosts = found.where("company_id = 'pages'").select(F.substring_index("email", "@", -1).alias("host")).distinct()
    kept = suppress(found, flagged, email="email").withColumn("host", F.substring_index("email", "@", -1))
    return kept.join(hosts, "host", "left_anti").select("company_id", "page_id", "email")


@query("names_found", f"""with {_TEXTS}, p as (select company_id, page_id, string_split(text, chr(10)) as l from texts),
 src as (select row_number() over () as id, * from (select company_id, page_id, unnest(l) as line from p)), {names_in('src')}
select company_id, name_key, count(*) as n, min(page_id) as first_page from src_names join src using (id) group by 1, 2""")
def names_found(spark, sf):
    """Person names by normalised spelling in all documents and pages, with where they were first seen."""
    lines = each(_texts(spark, sf), ["company_id", "page_id"], F.split("text", "\n"), "line_no", "line")
    found = each(lines, ["company_id", "page_id"], N.find_names(F.col("line")), "no", "name")
    return found.groupBy("company_id", N.name_key(F.col("name")).alias("name_key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("keyword_signal", """
select source as company_id, bool_or(regexp_matches(text, '(?i)(?:secret|token|password|key)')) as positive,
  bool_or(regexp_matches(text, '(?i)(?:license|copyright|warranty)')) as negative, count(*) as docs from documents group by 1""")
def keyword_signal(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.col("source").alias("company_id")).agg(
        F.bool_or(F.col("text").rlike(vocab.any_of(("secret", "token", "password", "key")))).alias("positive"),
        F.bool_or(F.col("text").rlike(vocab.any_of(("license", "copyright", "warranty")))).alias("negative"),
        F.count("*").alias("docs"),
    )


_WORDS = "(?i)(?:license|copyright|password|secret)"


@query("signal_snippets", f"""
with p as (select doc_id, text, string_split(regexp_replace(text, '({_WORDS})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as p from documents where regexp_matches(text, '{_WORDS}')),
 h as (select doc_id, text, p, unnest(range(2, least(len(p), 4) + 1)) as i from p),
 o as (select doc_id, i, text, length(replace(array_to_string(list_slice(p, 1, i - 1), ''), chr(2), '')) as pos, split_part(p[i], chr(2), 1) as raw from h)
select doc_id, cast(i - 2 as integer) as no,
  regexp_replace(substr(text, greatest(pos - 25, 0) + 1, least(pos, 25)) || raw || substr(text, pos + length(raw) + 1, 25), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') as snippet from o""")
def signal_snippets(spark, sf):
    found = C.snippets(F.col("text"), vocab.any_of(("license", "copyright", "password", "secret")))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(found).alias("no", "snippet"))


@query("indicator_array", """
with t as (select source, bool_or(lang = 'de') as german, bool_or(regexp_matches(text, '(?i)license')) as licensed, max(n_chars) as longest, count(*) as n from documents group by 1)
select source, array_to_string([x for x in [case when german then 'german' end, case when licensed then 'licensed' end,
   case when longest >= 10000 then 'long' end, case when n > 20 then 'many' end] if x is not null], ';') as indicators from t""")
def indicator_array(spark, sf):
    t = table(spark, sf, "documents").groupBy("source").agg(
        F.bool_or(F.col("lang") == "de").alias("german"), F.bool_or(F.col("text").rlike("(?i)license")).alias("licensed"),
        F.max("n_chars").alias("longest"), F.count("*").alias("n"),
    )
    tests = ((F.col("german"), "german"), (F.col("licensed"), "licensed"), (F.col("longest") >= 10000, "long"), (F.col("n") > 20, "many"))
    listed = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in tests]), lambda x: x.isNotNull())
    return t.select("source", F.array_join(listed, ";").alias("indicators"))


@query("next_two_rows", """
select conv_id, turn, lead(role, 1) over w as next_role, lead(role, 2) over w as second_role,
  coalesce(length(lead(text, 1) over w), length(lead(text, 2) over w)) as next_len
from conversations window w as (partition by conv_id order by turn)""")
def next_two_rows(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("len"))
    cut = chunked(rows, ["conv_id"], F.floor(F.col("turn") / 64), ["turn"], after=2)
    w = chunk_window(["conv_id"], ["turn"])
    return cut.select(
        "conv_id", "turn", "_halo", F.lead("role", 1).over(w).alias("next_role"), F.lead("role", 2).over(w).alias("second_role"),
        F.coalesce(F.lead("len", 1).over(w), F.lead("len", 2).over(w)).alias("next_len"),
    ).where(~F.col("_halo")).drop("_halo")


@query("segment_islands", """
with s as (select conv_id, turn, role, length(text) as len, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as segment from conversations)
select conv_id, cast(segment as bigint) as segment, min(turn) as first_turn, count(*) as turns, cast(sum(len) as bigint) as chars from s group by 1, 2""")
def segment_islands(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("len"), (F.col("role") == "user").cast("long").alias("opens"))
    marked = running_total(rows, ["conv_id"], F.floor(F.col("turn") / 64), ["turn"], "opens", "segment")
    return marked.groupBy("conv_id", "segment").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum("len").alias("chars"))


@query("entity_clusters", """
with recursive keys as (
   select doc_id as record, 't:' || md5(lower(text)) as token from documents
   union select doc_id, 'l:' || lower(split_part(text, chr(10), 1)) from documents),
 hub as (select token, min(record) as hub from keys group by 1),
 edge as (select distinct record as u, hub as v from keys join hub using (token) where record <> hub),
 sym as (select u, v from edge union select v, u from edge),
 walk(record, label) as (select distinct record, record from keys union select b.v, w.label from walk w join sym b on b.u = w.record where w.label < b.v)
select record, min(label) as cluster from walk group by 1""")
def entity_clusters(spark, sf):
    docs = table(spark, sf, "documents")
    keys = docs.select(
        F.col("doc_id").alias("record"),
        F.explode(F.array(
            F.concat(F.lit("t:"), F.md5(F.lower("text"))), F.concat(F.lit("l:"), F.lower(F.substring_index("text", "\n", 1)))
        )).alias("token"),
    )
    return clusters(keys)


@query("reachability_ratio", f"""
with h as (select {sql_host('url')} as host, bool_and(length(html) < 3000) as failed, min(page_id) as p from pages group by 1)
select count(*) as sites, count(*) filter (failed) as failed, round(count(*) filter (failed) / count(*), 6) as ratio,
   count(*) >= 5 and count(*) filter (failed) >= 0.8 * count(*) as warn, min(p) filter (failed) as first_failed from h""")
def reachability_ratio(spark, sf):
    """Hosts whose pages are all very short play the unreachable sites."""
    hosts = table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(
        F.bool_and(F.length("html") < 3000).alias("failed"), F.min("page_id").alias("p")
    )
    return reachability(hosts, F.col("failed"), F.col("p"), F.col("p")).withColumnRenamed("first_error", "first_failed")


_LISTED = "'spam-farm.example.org', 'cheap-pills.example.com'"


@query("domain_exclusion", f"""
with p as (select page_id, {sql_domain('url')} as domain, lower(regexp_extract(html, '<title>([^<]*)', 1)) as name from pages)
select page_id, domain, case when domain in ({_LISTED}) then 'Kette/Franchise (Domain ' || domain || ')'
  when contains(name, 'the the') then 'Kette/Franchise (Name „the the“)' when contains(name, ' les ') then 'Kette/Franchise (Name „les“)' end as reason from p""")
def domain_exclusion(spark, sf):
    from firmatlas.functions.company import exclusion_reason

    rows = table(spark, sf, "pages").select(
        "page_id", urls.registrable_domain(F.col("url"), SUFFIXES).alias("domain"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("name")
    )
    reason = exclusion_reason(F.col("domain"), F.col("name"), ("spam-farm.example.org", "cheap-pills.example.com"), ("The the", " Les "))
    return rows.select("page_id", "domain", reason.alias("reason"))


@query("run_meta", """
select 'documents' as parameter, count(*) as value from documents union all select 'labelled', count(*) from documents join labels using (doc_id)
union all select 'good', count(*) from documents join labels using (doc_id) where quality = 1
union all select 'toxic', count(*) from documents join labels using (doc_id) where toxic = 1""")
def run_meta(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    one = rows.agg(
        F.count("*").alias("documents"), F.count("quality").alias("labelled"),
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"),
    )
    return one.unpivot([], ["documents", "labelled", "good", "toxic"], "parameter", "value")
