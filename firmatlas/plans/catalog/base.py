"""Registry of queries and the SQL fragments their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SUFFIXES = ("example.com", "example.net", "example.org")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def sql_host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def sql_domain(url: str) -> str:
    h = sql_host(url)
    three = f"array_to_string(list_slice(string_split({h}, '.'), -3, -1), '.')"
    two = f"array_to_string(list_slice(string_split({h}, '.'), -2, -1), '.')"
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"case when {two} in ({listed}) then {three} else {two} end"


def sql_path(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def sql_query(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"


def sql_page_key(url: str) -> str:
    p = f"regexp_replace({sql_path(url)}, '/+$', '')"
    q = sql_query(url)
    return (
        f"regexp_replace({sql_host(url)}, '^www\\.', '') || case when {p} = '' then '/' else {p} end "
        f"|| case when {q} = '' then '' else '?' || {q} end"
    )


def _drop(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "svg", "template", "iframe", "canvas", "head"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return out


BLOCKS = (
    "br|p|div|li|ul|ol|tr|table|thead|tbody|tfoot|h1|h2|h3|h4|h5|h6|address|section|article|header|footer|nav|aside|main|"
    "form|fieldset|legend|blockquote|pre|dl|dt|dd|figure|figcaption|hr|details|summary|option|select|textarea|label|button"
)


def sql_text(html: str) -> str:
    out = _drop(html)
    out = f"regexp_replace({out}, '(?i)</?(?:{BLOCKS})\\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:td|th)\\b[^>]*>', chr(9), 'g')"
    out = f"regexp_replace({out}, '(?i)</?a\\b[^>]*>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[/!?A-Za-z][^>]*>', '', 'g')"
    for name, char in (("amp", "&"), ("middot", "·"), ("copy", "©"), ("quot", '"'), ("nbsp", " "), ("lt", "<"), ("gt", ">")):
        out = f"replace({out}, '&{name};', '{char}')"
    out = f"replace({out}, chr(9), ' · ')"
    out = f"regexp_replace({out}, '[\\r\\f\\x0B\\x{{00A0}} ]+', ' ', 'g')"
    out = f"regexp_replace({out}, '(?: *· *)+', ' · ', 'g')"
    out = f"regexp_replace({out}, '(?m)^[ ·]+|[ ·]+$', '', 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{2,}}', chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"


# every link of a page in order, as the test pages write them: double-quoted href, plain text inside
SQL_LINKS = f"""
  l0 as (select page_id, url, {_drop('html')} as body from pages),
  l1 as (select page_id, url, regexp_extract_all(body, '(?is)<a\\b[^>]*\\shref\\s*=\\s*"[^"]*"[^>]*>.*?</a\\s*>') as tags from l0),
  l2 as (select page_id, url, unnest(tags) as tag, generate_subscripts(tags, 1) - 1 as link_no from l1),
  l3 as (select page_id, url, link_no, trim(regexp_extract(tag, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1)) as raw,
           trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from l2),
  links as (select page_id, url, link_no,
       case when raw like '/%' then regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || regexp_replace(raw, '#.*$', '') else raw end as href,
       replace(replace(text, '&amp;', '&'), '&quot;', '"') as text,
       case when raw like 'mailto:%' then 'mailto' when raw like 'tel:%' then 'tel' when raw like '#%' then 'other'
            when raw like '/%' then 'internal' else 'external' end as kind
     from l3 where raw <> '')
"""
