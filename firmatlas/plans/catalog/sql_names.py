"""The name rules stated in SQL: tokens, their classes, and runs of classes, as CTEs over a table (id, line)."""

from __future__ import annotations

from firmatlas.functions import names as N
from firmatlas.rules import vocab

TOKEN = r"\p{L}+\.(?:-?\p{L}+\.)*|[\p{L}\p{N}\p{M}_]+(?:-[\p{L}\p{N}\p{M}_]+)*|[^\s\p{Z}]"
SHAPED = r"[A-ZÄÖÜ][a-zäöüßé.].*[\s\p{Z}].*[A-ZÄÖÜ]"


def listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + ")"


def token_class(t: str) -> str:
    plain = f"rtrim(lower({t}), '.')"
    spoilt = "(?:" + "|".join(sorted({*vocab.JOB_ENDINGS, *vocab.STREET_ENDINGS})) + ")$"
    word = f"case when {plain} in {listed(N._BESIDE)} then 'W' when regexp_matches({plain}, '{spoilt}') then 'B' else 'N' end"
    return f"""case when not regexp_matches({t}, '^\\p{{L}}') then 'X' when {t} in {listed(vocab.NAME_TITLES)} or starts_with({t}, 'Dipl.-') then 'T'
      when regexp_matches({t}, '{N.WORD}') then case when {t} in {listed(vocab.SALUTATIONS)} then 'S' when {t} like '%.' then lower({word}) else {word} end
      when regexp_matches({t}, '^[A-ZÄÖÜ]\\.$') then 'I' when lower({t}) = 'und' then 'U' when lower({t}) in {listed(vocab.NAME_PARTICLES)} then 'P' else 'X' end"""


def names_in(source: str) -> str:
    """CTEs that end in ``{source}_names`` (id, no, name, name_key): the different names of each line, in order."""
    s = source
    return f"""
 {s}_t as (select id, regexp_extract_all(line, '{TOKEN}') as toks from {s} where regexp_matches(line, '{SHAPED}')),
 {s}_k as (select id, toks, array_to_string([{token_class('t')} for t in toks], '') as kinds from {s}_t),
 {s}_p as (select id, toks, string_split(regexp_replace(kinds, '({N.RUN})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as p from {s}_k where regexp_matches(kinds, '{N.RUN}')),
 {s}_i as (select id, toks, p, unnest(range(2, len(p) + 1)) as i from {s}_p),
 {s}_r as (select id, toks, i, length(replace(array_to_string(p[1:i - 1], ''), chr(2), '')) as start, split_part(p[i], chr(2), 1) as raw from {s}_i),
 {s}_f as (select *, regexp_extract(raw, '{N.NAME_IN_RUN}', 1) as front, regexp_extract(raw, '{N.NAME_IN_RUN}', 2) as core from {s}_r),
 {s}_w as (select id, i, core, toks[start + length(front) + 1:start + length(front) + length(core)] as own,
   case when contains(front, 'T') then toks[start + 1 + case when starts_with(front, 'S') then 1 else 0 end:start + length(front)] else [] end as titles from {s}_f where core <> ''),
 {s}_j as (select id, i, array_to_string(titles || own, ' ') as said, array_to_string(own, ' ') as bare, core like '%n' as ends from {s}_w),
 {s}_e as (select id, i, case when ends then rtrim(said, '.') else said end as name, replace(lower(case when ends then rtrim(bare, '.') else bare end), 'ß', 'ss') as name_key from {s}_j),
 {s}_names as (select id, row_number() over (partition by id order by i) as no, name, name_key from
   (select * from {s}_e where length(name) <= 60 qualify row_number() over (partition by id, name_key order by i) = 1))"""
