"""Registered queries of the corpus operators, with their SQL twins where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.llm import bpe, decontaminate, fill_middle, hard_negatives, html_content, language, language_model, ngram_join, privacy, quality, secret_scan, toxicity, url_rules
from firmatlas.llm.common import held_out, table, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOXIC = 0.7
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def twin(name: str, sql: str) -> None:
    """The SQL that states the result of a query."""
    ORACLES[name] = sql


@query
def op1_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_content.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.array_join("blocks", "\n\n")
    return pages.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


@query
def op2_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(privacy.PATTERNS))
    counts = [privacy.number(F.col("spans"), kind).alias(f"n_{kind}") for kind in privacy.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(privacy.written(base), 256).alias("base_sha256"), privacy.written(F.col("spans")).alias("spans"))


@query
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    network = language.fit(docs.where("not held_out"))
    return language.predict(docs.drop("lang"), network).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    scored = toxicity.score(docs, toxicity.learn(docs, labels), clauses=None, drop=("text",))
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


twin("op6_ngram_join", rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '[^\x20\x09-\x0D]+') as words from documents),
  s as (select doc_id, unnest(list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] end)) as shingle from w),
  n as (select doc_id, count(*) as n from s group by 1),
  shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (shingle) where a.doc_id < b.doc_id group by 1, 2),
  linked as (select x, y from shared join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
  both_ways as (select x, y from linked union all select y, x from linked),
  walk(doc_id, label) as (select doc_id, doc_id from w union select y, label from walk join both_ways on x = doc_id where label < y)
select doc_id, coalesce(max(n), 0) as n_shingles, min(label) as component_id from walk left join n using (doc_id) group by 1""")


@query
def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "kept")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", whole().alias("text"))
    done = bpe.round_trip(docs, path, pattern, pieces_kept=bpe.PIECES_KEPT, drop=("text",))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    told = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", told), F.col("vec_id") % 100 == 0)


twin("op11_hard_negatives", """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v
    from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
  pairs as (select a.vec_id as anchor_id, a.label as own, r.vec_id, r.label, cast(list_inner_product(a.v, r.v) as bigint) as score from r a join r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
  p as (select anchor_id, vec_id as positive_id, score as positive_score from pairs where label = own
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join pairs using (anchor_id) where label <> own and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5""")

SITES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# words of spam hosts, and paths that hold no article
GLOBS = ("*casino*/**", "*cheap-pills*/**", "*ads-track*/**", "*.*/**/login**", "*.*/**/cart/**")


@query
def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.site_rule(*s) for s in SITES] + [url_rules.Rule(g, "block") for g in GLOBS]
    return url_rules.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


_FITS = [f"when ends_with('.' || host, '.{h}') and starts_with(path, '{p}') then" for h, p, _ in sorted(SITES, key=lambda s: -len(s[0] + s[1]))]
_BY_LENGTH = sorted(SITES, key=lambda s: -len(s[0] + s[1]))
_GLOBBED = " or ".join("regexp_full_match('.' || host || path || query, '(?s)" + g.replace(".", r"\.").replace("**", "\0").replace("*", "[^/?]*").replace("\0", ".*") + "')" for g in GLOBS)
twin("op12_url_rules", rf"""
with s as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
  p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
    regexp_extract(rest, '^[^?#]*([^#]*)', 1) as query from s)
select page_id, host, path, case {' '.join(f"{w} '{h}{p}'" for w, (h, p, _) in zip(_FITS, _BY_LENGTH, strict=True))} end as rule,
  case {' '.join(f"{w} '{v}'" for w, (_, _, v) in zip(_FITS, _BY_LENGTH, strict=True))} when {_GLOBBED} then 'block' else 'allow' end as verdict
from (select page_id, coalesce(host, '') as host, coalesce(path, '') as path, coalesce(query, '') as query from p)""")


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(again).alias("restored_sha256"))


twin("op13_fill_middle", """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units from documents),
  n as (select *, cast(len(units) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from t),
  c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from n),
  d as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from d""")
