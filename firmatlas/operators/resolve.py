"""Company resolution: records that share an id, a domain or a phone number become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions import phone as P
from firmatlas.functions import urls
from firmatlas.functions.text import blank_to_null
from firmatlas.operators.skew import first_by, top_rows
from firmatlas.session import drop_stage, write_stage

RULERS = 4  # one of so many records of a chain stays in the next, shorter list
SHORT = 100_000  # links that are followed without shorter lists


def _keys() -> list[Column]:
    """Matching keys of a company record, null where it has none."""
    domain = urls.registrable_domain(F.coalesce(F.col("website"), F.col("domain")))
    phone = P.phone_key(F.coalesce(F.col("phone"), F.col("phone_international")))
    return [F.concat(F.lit("id:"), F.col("place_id")), F.concat(F.lit("domain:"), domain), F.concat(F.lit("phone:"), phone)]


def record_keys(companies: DataFrame, record: str = "ord") -> DataFrame:
    """record, token: one row per matching key of a company record."""
    keys = F.filter(F.array(*_keys()), lambda k: k.isNotNull())
    return companies.select(F.col(record).alias("record"), F.explode(keys).alias("token"))


def clusters(pairs: DataFrame) -> DataFrame:
    """record, cluster: connected records, named by their smallest record.

    Records meet at the smallest record of each key, so a key held by a third of all records adds one
    edge per record and never a pair of them. Then alternating star contraction: every node hands its
    larger (then smaller) neighbours to its smallest one, which needs few rounds even for long chains.
    Each round is a stage, written over that of the round before; only two numbers reach the driver. (A checkpoint keeps
    Spark's estimate of its plan, which joins multiply: over rounds a number of megabytes.) Joins are by sorting: the
    estimates leave out how long exploded arrays were, and would send millions of rows through the driver.
    """
    hubs = pairs.groupBy("token").agg(F.min("record").alias("hub"))
    edges = (
        pairs.hint("merge").join(hubs, "token")
        .where("record <> hub")
        .select(F.col("record").alias("u"), F.col("hub").alias("v"))
        .distinct()
    )
    edges, seen = write_stage(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.hint("merge").join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, last = write_stage(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "edges"), edges
        drop_stage(last)
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    records = pairs.select("record").distinct()
    return records.join(edges.withColumnRenamed("u", "record").hint("merge"), "record", "left").select(
        "record", F.coalesce("v", "record").alias("cluster")
    )


def merge_records(rows: DataFrame, cluster: str = "cluster", order: str = "ord", joined: str | None = "query") -> DataFrame:
    """One row per cluster: each field from the earliest record that has it; queries joined in order."""
    fields = [c for c in rows.columns if c not in (cluster, order, joined)]
    at = F.col(order)

    def filled(name: str):
        kind = rows.schema[name].dataType.typeName()
        c = F.col(name)
        if kind == "string":
            return F.nullif(c, F.lit(""))
        return F.when(F.size(c) > 0, c) if kind == "array" else c

    out = rows.groupBy(cluster).agg(*[first_by(filled(c), at).alias(c) for c in fields], F.min(at).alias(order))
    if joined is None:
        return out
    return out.join(_search_terms(rows, cluster, order, joined), cluster, "left")


def _search_terms(rows: DataFrame, cluster: str, order: str, joined: str) -> DataFrame:
    """The distinct terms of each cluster, in first-seen order, as one text ``joined``."""
    # distinct per cluster before joining: the list is no longer than the list of search terms
    terms = (
        rows.groupBy(cluster, joined)
        .agg(F.min(order).alias(order))
        .select(cluster, order, F.posexplode(F.split(joined, r"\|")).alias("no", "term"))
        .select(cluster, F.struct(order, "no").alias("at"), blank_to_null(F.col("term")).alias("term"))
        .where("term is not null")
        .groupBy(cluster, "term")
        .agg(F.min("at").alias("at"))
    )
    return join_in_order(terms, [cluster], "term", "at", " | ", joined)


def join_in_order(rows: DataFrame, keys: list[str], value: str, order: str, separator: str, out: str) -> DataFrame:
    """Distinct values of a short list per key, joined in first-seen order."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", value)))
    return first.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x[value]), separator).alias(out))


def dedupe_companies(companies: DataFrame) -> DataFrame:
    """Resolved companies in first-seen order, with the domain filled from the website.

    Most hits of a place say the same: records that differ in nothing but ``ord`` and ``query`` are one row from the start,
    named by the first of them. Only these rows are linked and merged. The search terms of all records follow by one
    key each.
    """
    domain = urls.registrable_domain(F.coalesce(F.col("website"), F.col("domain")))
    filled = companies.where("ord is not null").withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), domain))
    # written once: the folded rows and the search terms read it
    staged = write_stage(filled, "companies")
    # records of the same ``ord`` are one, whatever they say; so they are not named by others
    again = write_stage(staged.groupBy("ord").agg(F.count("*").alias("n")).where("n > 1").select("ord", F.col("ord").alias("_again")), "companies-again")
    repeated = not again.isEmpty()
    marked = staged.hint("merge").join(again, "ord", "left") if repeated else staged.withColumn("_again", F.lit(None).cast("long"))
    same = [c for c in marked.columns if c not in ("ord", "query")]
    folded = write_stage(marked.groupBy(*same).agg(F.min("ord").alias("ord")), "companies-folded")
    linked = write_stage(clusters(record_keys(folded)).withColumnRenamed("record", "ord"), "companies-linked")
    merged = merge_records(folded.drop("_again").hint("merge").join(linked.hint("merge"), "ord"), joined=None)

    token = F.coalesce(*_keys()).alias("_token")
    named = folded.select("ord", token).where("_token is not null").hint("merge").join(linked.hint("merge"), "ord").select("_token", "cluster").distinct()
    single = marked.where("_again is null").select("ord", "query", token).where("_token is not null")
    asked = single.hint("merge").join(named.hint("merge"), "_token").select("cluster", "ord", "query")
    if repeated:
        asked = asked.unionByName(marked.where("_again is not null").hint("merge").join(linked.hint("merge"), "ord").select("cluster", "ord", "query"))
    return merged.hint("merge").join(_search_terms(asked, "cluster", "ord", "query").hint("merge"), "cluster", "left").drop("cluster")


def _settled(records: DataFrame, group: str, order: str, keys: list[str]) -> DataFrame:
    """Orders of the records that are taken when each group is read from its first record to its last."""
    kind = {c: records.schema[c].dataType.simpleString() for c in (order, *keys)}
    read = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])))
    start = F.struct(
        F.expr(f"cast(array() as array<{kind[order]}>)").alias("taken"),
        *[F.expr(f"cast(array() as array<{kind[k]}>)").alias(f"k{i}") for i, k in enumerate(keys)],
    )

    def step(done: Column, r: Column) -> Column:
        free = F.lit(True)
        for i in range(len(keys)):
            free = free & ~F.coalesce(F.array_contains(done[f"k{i}"], r[f"k{i}"]), F.lit(False))
        marked = [F.when(r[f"k{i}"].isNull(), done[f"k{i}"]).otherwise(F.array_append(done[f"k{i}"], r[f"k{i}"])).alias(f"k{i}") for i in range(len(keys))]
        return F.when(free, F.struct(F.array_append(done["taken"], r["at"]).alias("taken"), *marked)).otherwise(done)

    folded = records.groupBy(group).agg(F.aggregate(read, start, step, lambda done: done["taken"]).alias("taken"))
    return folded.select(F.explode("taken").alias(order))


def _along_chains(left: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Orders of records that are taken as far as chains tell: records that hang on a single earlier one.

    Such a record is first with one key and second with the other, or second behind the same record with both: it is
    taken if that one is not. Pointers along these records double their length in every round, so a chain costs the
    logarithm of its length; long lists are shortened to some of their records first. A chain is settled if it begins with
    a record that is first with both keys.
    """
    told = left.select(order, *keys)
    for k in keys:
        first = told.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_{k}1"))
        told = told.hint("merge").join(first, k, "left")
        second = told.where(F.col(order) > F.col(f"_{k}1")).groupBy(k).agg(F.min(order).alias(f"_{k}2"))
        told = told.hint("merge").join(second, k, "left")
    at = F.col(order)
    free = [F.coalesce(at == F.col(f"_{k}1"), F.lit(True)) for k in keys]
    behind = [F.when(at == F.col(f"_{k}2"), F.col(f"_{k}1")) for k in keys]
    up = (
        F.when(free[0] & free[1], at)
        .when(free[0], behind[1])
        .when(free[1], behind[0])
        .when(behind[0] == behind[1], behind[0])
    )
    # a record that hangs on several is where its chain begins, and stays open
    found = write_stage(told.select(at.alias("at"), up.alias("up"), F.lit(True).alias("odd")).where("up is not null").distinct(), "links")
    heads = found.where("at = up").select("at")
    links, below = found.where("at <> up"), []
    while links.count() > SHORT:
        part = _to_rulers(links, len(below))
        links = part.where("ruler").select("at", "up", "odd")
        below.append(part.where("not ruler").select("at", "up", "odd"))
    links = _to_ends(links)
    known = links.hint("merge").join(heads.withColumnRenamed("at", "up"), "up", "left_semi").select("at", (~F.col("odd")).alias("taken"))
    known = heads.select("at", F.lit(True).alias("taken")).unionByName(write_stage(known, "settled"))
    for part in reversed(below):
        ahead = known.select(F.col("at").alias("up"), "taken")
        told = part.hint("merge").join(ahead, "up").select("at", (F.col("odd") != F.col("taken")).alias("taken"))
        known = known.unionByName(write_stage(told, "settled"))
    return known.where("taken").select(F.col("at").alias(order))


def _to_ends(links: DataFrame) -> DataFrame:
    """at, up, odd with ``up`` at the beginning of the chain: pointers double their length in every round."""
    last = None
    while True:
        ahead = links.select(F.col("at").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
        moved = links.hint("merge").join(ahead, "up", "left").select(
            "at", F.coalesce("_up", "up").alias("up"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"), F.col("_up").isNotNull().alias("moved")
        )
        moved = write_stage(moved, "links")
        if last is not None:
            drop_stage(last)
        last, links = moved, moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def _to_rulers(links: DataFrame, level: int) -> DataFrame:
    """at, up, odd, ruler: pointers to the next ruler ahead, or to the beginning of the chain if none comes before.

    One record of ``RULERS`` is a ruler, by a hash. Pointers double their length until they meet one, so a few rounds
    with ever fewer rows are enough; the rulers alone are the next list, and all lists together cost a few times the first.
    """
    named = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(RULERS)) == 0
    rows = links.select("at", "up", "odd", named("at").alias("ruler"), named("up").alias("done"))
    last = None
    while True:
        ahead = rows.where("not ruler").select(F.col("at").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"), F.col("done").alias("_done"))
        # who finds nobody ahead is at the beginning
        moved = rows.where("not done").hint("merge").join(ahead, "up", "left").select(
            "at", F.coalesce("_up", "up").alias("up"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"), "ruler", F.coalesce("_done", F.lit(True)).alias("done")
        )
        rows = write_stage(rows.where("done").unionByName(moved), "rulers")
        if last is not None:
            drop_stage(last)
        last = rows
        if rows.where("not done").isEmpty():
            return rows.drop("done")


def unseen(
    batch: DataFrame, seen: DataFrame, id_col: str = "place_id", domain: str = "domain", order: str = "ord", fold: int = 16_384
) -> DataFrame:
    """Records whose id and domain were not processed before, read in the order of ``order`` (unique per record).

    A record is taken if no seen record and no earlier taken one has its id or its domain; a record that is left out
    marks neither. A missing id or domain matches nothing.

    What a record is up to depends only on the records that share keys with it, directly or through others. So each
    round first takes all records that come first with both keys and drops what they exclude: two partial aggregates,
    whatever share of the records one key holds. Then chains of records that hang on a single earlier one are settled,
    and while that halves the rest, it goes on so. Of what is left, components of up to ``fold`` records are read each in one
    sorted pass; of a larger one its first ``fold`` records, and then the next round goes on behind them. The number of
    rounds so grows with the size of the largest component divided by ``fold``, not with the length of its chains.
    """
    keys, untyped = [id_col, domain], [c for c, kind in batch.dtypes if kind == "void"]
    names = [c for c in batch.columns if c not in untyped]  # stages have no columns without a type
    left = batch
    for k in keys:
        left = left.join(seen.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")

    def kept(rows: DataFrame) -> DataFrame:
        return write_stage(rows.select(names), "unseen")

    left, taken = kept(left), []

    def excluded(rows: DataFrame, now: DataFrame) -> DataFrame:
        # by sorting: the files of a stage may be far smaller than its rows
        rest = rows.hint("merge").join(now.select(order), order, "left_anti")
        for k in keys:
            rest = rest.hint("merge").join(now.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        return kept(rest)

    while True:
        told = left.hint("merge")
        for k in keys:
            first = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_{k}"))
            told = told.join(first.hint("merge"), k, "left")
        ahead = [F.coalesce(F.col(order) == F.col(f"_{k}"), F.lit(True)) for k in keys]
        now = kept(told.where(ahead[0] & ahead[1]))
        taken.append(now)
        left, last = excluded(left, now), left
        drop_stage(last)
        n = left.count()
        if n <= fold:  # one pass settles all, whatever hangs together
            if n:
                settled = _settled(left.withColumn("_group", F.lit(0)), "_group", order, keys)
                taken.append(kept(left.join(settled, order, "left_semi")))
            break
        chained = _along_chains(left, order, keys)
        now = kept(left.hint("merge").join(chained, order, "left_semi"))
        taken.append(now)
        left, last = excluded(left, now), left
        drop_stage(last)
        rest = left.count()
        if not rest:
            break
        if 2 * rest <= n:
            continue
        tokens = F.filter(F.array(*[F.concat(F.lit(f"{i}:"), F.col(k).cast("string")) for i, k in enumerate(keys)]), lambda t: t.isNotNull())
        linked = clusters(left.select(F.col(order).alias("record"), F.explode(tokens).alias("token")))
        grouped = write_stage(left.select(order, *keys).hint("merge").join(linked.withColumnRenamed("record", order), order), "unseen-groups")
        early = top_rows(grouped, ["cluster"], [F.col(order)], fold, "_place").drop("_place")
        now = kept(left.hint("merge").join(_settled(early, "cluster", order, keys), order, "left_semi"))
        taken.append(now)
        # of a settled component nothing is left; of a larger one what lies behind its first records
        read = excluded(left.hint("merge").join(early.select(order), order, "left_anti"), now)
        if read.isEmpty():
            break
        left = read
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out.select(*[F.lit(None).alias(c) if c in untyped else F.col(c) for c in batch.columns])


def latest_per_key(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(at), F.col(tie)))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def fresh_values(cache: DataFrame, keys: list[str], at: str, tie: str, now, ttl_days: float) -> DataFrame:
    """Latest value per key that is not older than the time to live."""
    latest = latest_per_key(cache, keys, at, tie)
    return latest.where(F.col(at) >= now - F.expr(f"make_dt_interval(0, 0, 0, {ttl_days * 86400})"))
