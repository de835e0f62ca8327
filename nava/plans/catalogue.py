"""Query catalogue: the reference operators applied to the driver's whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nava.functions import arrays as A
from nava.functions import dates as D
from nava.functions import edits as E
from nava.functions import html as H
from nava.functions import signal as S
from nava.functions import text as T
from nava.operators import constraints as C
from nava.operators import context as X
from nava.operators import intervals as I
from nava.operators import metrics as M
from nava.operators import relational as R
from nava.plans.registry import long, oracle_sql, queries, query, rounded  # noqa: F401
from nava.session import shared_folder, table
from nava.streaming import incremental as Inc

# Text

_DISCARDED = "!\"#&''(),-.:;–¬“”…«»"
_WORDS = "array_to_string(list_filter(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' '), lambda w: not starts_with(w, '#')), ' ')"


def _latin(t: str) -> str:
    words = _WORDS.format(t=t)
    replaced = f"replace(replace(replace(replace({words}, 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '’', '''')"
    cleaned = f"regexp_replace(translate({replaced}, '{_DISCARDED}', ''), '\\p{{P}}', '', 'g')"
    return f"case when not regexp_matches({t}, '[0-9=]') then trim(regexp_replace({cleaned}, '\\s+', ' ', 'g')) end"


_PLAIN = "trim(regexp_replace(regexp_replace({t}, '\\p{{P}}', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"select doc_id, {_latin('text')} as normalized from documents")
def text_normalize(spark, sf_dir):
    """Ordered replacements, discards, punctuation and white space; null where digits or = occur."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_latin(F.col("text")).alias("normalized"))


# Persian texts: the documents in other letters, some of them of those that the pack replaces, with one word that it discards.
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "ابپتثجچحخدذرزسشصطعفقهكيىﻢء"
_PERSIAN = f"translate(lower(text), '{_FROM}', '{_TO}') || case when doc_id % 3 = 0 then ' #دور (خنده) ۀم' when doc_id % 7 = 0 then ' Q' else '' end"


def _persian_sql(t: str) -> str:
    out = _WORDS.format(t=t)
    for a, b in T.PERSIAN_REPLACE:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"replace({out}, '{T.PERSIAN_DISCARD_WORD}', '')"
    out = f"translate({out}, '{T.PERSIAN_DISCARD.replace(chr(39), chr(39) * 2)}', '')"
    # Of what the compatibility composition changes the texts have this one letter; then the hamza goes.
    out = f"replace(replace({out}, 'ﻡ', 'م'), 'ء', '')"
    return f"case when not regexp_matches({t}, '[A-Za-z=āšة]') then trim(regexp_replace(regexp_replace({out}, '\\p{{P}}', '', 'g'), '\\s+', ' ', 'g')) end"


@query(f"select doc_id, {_persian_sql('t')} as normalized from (select doc_id, {_PERSIAN} as t from documents)")
def text_normalize_persian(spark, sf_dir):
    """The Persian pack, with NFKC, on texts in Persian letters; Latin ones reject."""
    tail = F.when(F.col("doc_id") % 3 == 0, " #دور (خنده) ۀم").when(F.col("doc_id") % 7 == 0, " Q").otherwise("")
    text = F.concat(F.translate(F.lower("text"), _FROM, _TO), tail)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).select("doc_id", T.normalize_persian(F.col("t")).alias("normalized"))


@query(f"select doc_id, coalesce({_latin('text')}, case when doc_id % 2 = 0 then {_PLAIN.format(t='text')} end) as sentence from documents")
def text_reject_fallback(spark, sf_dir):
    """Rejected rows of even ids keep their raw text without punctuation."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.with_fallback(text, T.normalize_latin(text), F.col("doc_id") % 2 == 0).alias("sentence"))


@query(f"""select lang, count(*)::bigint as source, count(n)::bigint as final, count(*) filter (n is not null and n <> text)::bigint as changed,
count(*) filter (n is null)::bigint as discarded from (select lang, text, {_latin('text')} as n from documents) group by lang""")
def normalize_audit(spark, sf_dir):
    """Counters of a normalization by language."""
    df = table(spark, sf_dir, "documents").withColumn("n", T.normalize_latin(F.col("text")))
    n = F.col("n")
    return M.audit(df, "lang", source=F.lit(True), final=n.isNotNull(), changed=n != F.col("text"), discarded=n.isNull())


@query("""select page_id, case when c = '' then 'source' else c end[1:96] as safe, case when c = '' then 'source' else c end[1:96] || '-' || substring(sha256(url), 1, 10) as generated
from (select page_id, url, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-._') as c from pages)""")
def safe_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_id(F.col("url")).alias("safe"), T.generated_id(F.col("url")).alias("generated"))


@query("""select conv_id, turn, len(regexp_extract_all(text, '([0-9]+)', 1))::bigint as numbers, len(text)::bigint as chars,
trim(regexp_replace(text, '\\s+', ' ', 'g')) as squeezed from conversations""")
def text_measures(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", long(F.size(T.number_tokens(text)), "numbers"), long(F.length(text), "chars"), T.squeeze(text).alias("squeezed")
    )


@query("""select doc_id, case when contains(text, 'icense') then 'license' when contains(text, '!!') then 'shouting' when contains(text, ' | ') then 'table'
when contains(text, '$$$') or contains(text, '***') then 'symbols' else 'plain' end as reason from documents""")
def classify_keywords(spark, sf_dir):
    """The first rule that matches decides."""
    rules = (("license", ("icense",)), ("shouting", ("!!",)), ("table", (" | ",)), ("symbols", ("$$$", "***")))
    return table(spark, sf_dir, "documents").select("doc_id", T.first_rule(F.col("text"), rules, "plain").alias("reason"))


@query("""select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.1f KB', round(n_chars / 1024.0::double, 1)) else printf('%.1f MB', round(n_chars / 1048576.0::double, 1)) end as size from documents""")
def bytes_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(F.col("n_chars")).alias("size"))


@query("""select o_orderkey, (o_orderkey % 400)::bigint * 60 + o_custkey % 60 as short_seconds, ((o_orderkey % 5) * 3600 + (o_orderkey % 60) * 60 + o_custkey % 60)::bigint as long_seconds, null::bigint as bad from orders""")
def duration_parse(spark, sf_dir):
    """M:SS, H:MM:SS and other texts to seconds."""
    part = lambda c, m: F.lpad((F.col(c) % m).cast("string"), 2, "0")
    short = F.concat_ws(":", (F.col("o_orderkey") % 400).cast("string"), part("o_custkey", 60))
    longer = F.concat_ws(":", (F.col("o_orderkey") % 5).cast("string"), part("o_orderkey", 60), part("o_custkey", 60))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.duration_seconds(short).alias("short_seconds"), D.duration_seconds(longer).alias("long_seconds"), D.duration_seconds(F.col("o_orderpriority")).alias("bad")
    )


# Constraints


@query("select conv_id, count(*)::bigint as rows from conversations group by conv_id having count(*) > 1")
def dup_key_check(spark, sf_dir):
    return C.duplicates(table(spark, sf_dir, "conversations"), "conv_id")


@query("""select target, sources::bigint as sources from (select case when c = '' then 'source' else c end[1:96] as target, count(distinct name) as sources
from (select name, trim(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'), '-._') as c from (select source || ['', '!', ' ? '][doc_id % 3 + 1] || lang as name from documents)) group by 1) where sources > 1""")
def collision_check(spark, sf_dir):
    """Different names with one safe id."""
    between = F.element_at(F.array(F.lit(""), F.lit("!"), F.lit(" ? ")), (F.col("doc_id") % 3 + 1).cast("int"))
    return C.safe_id_collisions(table(spark, sf_dir, "documents").select(F.concat("source", between, "lang").alias("name")), "name")


@query("select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')")
def orphan_check(spark, sf_dir):
    """Lines whose order isn't among those that aren't pending."""
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.orphans(table(spark, sf_dir, "lineitem"), parents, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("select c_custkey, c_acctbal from customer where not coalesce(c_acctbal > 0 and not isnan(c_acctbal) and not isinf(c_acctbal), false)")
def positive_check(spark, sf_dir):
    return C.not_positive(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("""select event_id, list_filter([case when event_type = 'error' then 'is_error' end, case when value > 100 then 'large' end, case when json_extract(props, '$.missing') is null then 'missing_field' end],
lambda x: x is not null) as flags from events""")
def row_flags(spark, sf_dir):
    missing = F.get_json_object("props", "$.missing").isNull()
    flags = C.flags(is_error=F.col("event_type") == "error", large=F.col("value") > 100, missing_field=missing)
    return table(spark, sf_dir, "events").select("event_id", flags.alias("flags"))


@query("""select flag, count(*)::bigint as rows from (select unnest(list_filter([case when event_type = 'error' then 'is_error' end, case when value > 100 then 'large' end,
case when user_id % 7 = 0 then 'seventh' end], lambda x: x is not null)) as flag from events) group by flag""")
def flag_counts(spark, sf_dir):
    flags = C.flags(is_error=F.col("event_type") == "error", large=F.col("value") > 100, seventh=F.col("user_id") % 7 == 0)
    return M.flag_counts(table(spark, sf_dir, "events").select(flags.alias("flags")), "flags")


@query("""select event_id, case when json_valid(props) and list_sort(json_keys(props)) = ['k'] then null when json_valid(props) then 'invalid_schema' else 'invalid_json' end as reason from events""")
def json_contract(spark, sf_dir):
    """Valid JSON with exactly the wanted keys."""
    return table(spark, sf_dir, "events").select("event_id", X.contract_reason(F.col("props"), ("k",)).alias("reason"))


@query("select event_id, ts + to_minutes((user_id % 90)::int) <= timestamp '2024-01-15 00:00:00' as completed from events")
def completed_predicate(spark, sf_dir):
    start = F.date_format("ts", "H:mm")
    # Minutes are what the entry tells; the event's own seconds come back with it.
    seconds = F.col("ts") - F.date_trunc("minute", "ts").cast("timestamp_ntz")
    done = C.completed(F.to_date("ts"), start, F.col("user_id") % 90, F.lit("2024-01-15 00:00:00").cast("timestamp") - seconds)
    return table(spark, sf_dir, "events").select("event_id", done.alias("completed"))


# Splits, groups, choices


@query("""with test as (select distinct doc_id from labels where toxic = 1), dev as (select distinct doc_id from labels where quality = 0)
select 'test' as split, doc_id from test union all
select 'dev', doc_id from (select distinct doc_id from documents) where doc_id in (select doc_id from dev) and doc_id not in (select doc_id from test) union all
select 'train', doc_id from (select distinct doc_id from documents) where doc_id not in (select doc_id from dev) and doc_id not in (select doc_id from test)""")
def split_rebuild(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return R.rebuild_splits(table(spark, sf_dir, "documents"), labels.where("quality = 0"), labels.where("toxic = 1"), "doc_id")


_UNIT = "(('0x' || substring(sha256({key}), 1, 13))::bigint / 4503599627370496.0::double)"


@query(f"""select doc_id, case when u < 0.8 then 'train' when u < 0.9 then 'dev' else 'test' end as split from (select doc_id, {_UNIT.format(key="'v1|' || source || '|' || lang")} as u from documents)""")
def split_stable_hash(spark, sf_dir):
    """All documents of a source and language share a split."""
    group = F.concat_ws("|", "source", "lang")
    return R.stable_split(table(spark, sf_dir, "documents"), group, "v1", {"train": 0.8, "dev": 0.9 - 0.8, "test": 0.1}).select("doc_id", "split")


@query(f"""select source, count(distinct split)::bigint as splits from (select source, case when {_UNIT.format(key="'v1|' || doc_id")} < 0.8 then 'train' else 'test' end as split from documents where source is not null) group by source having count(distinct split) > 1""")
def split_leaks(spark, sf_dir):
    """Sources that a split by document leaks across."""
    df = R.stable_split(table(spark, sf_dir, "documents").where("source is not null"), F.col("doc_id"), "v1", {"train": 0.8, "test": 0.2})
    return M.no_leak(df, "source", "split")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) as r from conversations) where r = 1")
def first_wins(spark, sf_dir):
    return R.first_wins(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")]).select("conv_id", "turn", "role")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r = 1")
def last_wins(spark, sf_dir):
    return R.last_wins(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


@query("""select l_orderkey, sum(l_quantity) as total, count(*)::bigint as rows, bool_and(coalesce(l_partkey in (select p_partkey from part where p_size <= 40), false)) as complete from lineitem group by l_orderkey""")
def group_complete(spark, sf_dir):
    """Orders all of whose parts are usable."""
    usable = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return R.complete_groups(table(spark, sf_dir, "lineitem"), usable, "l_orderkey", "l_partkey", "l_quantity")


@query("""with g as (select o_custkey, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders group by 1),
t as (select (sum(cents) * 3 // 10)::bigint as target from g),
r as (select o_custkey, cents, (sum(cents) over (order by sha256('1337' || chr(0) || o_custkey), o_custkey))::bigint as running from g)
select o_custkey, cents, running from r, t where running - cents < target and not (running >= target and running - cents > 0 and target - (running - cents) <= running - target)""")
def closest_prefix(spark, sf_dir):
    """Customers in seeded order whose orders come closest to three tenths of the whole."""
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    target = groups.agg(F.sum("cents")).first()[0] * 3 // 10
    return R.closest_prefix(groups, "o_custkey", "cents", target, "1337").select("o_custkey", "cents", long("running", "running"))


@query("""select o_orderkey, coalesce(c_name, '(omitted)') as title, coalesce(n_name, '(omitted)') as description from orders
left join customer on o_custkey = c_custkey and c_mktsegment <> 'BUILDING' left join nation on c_nationkey = n_nationkey""")
def book_metadata_join(spark, sf_dir):
    """Orders with their customers' metadata, with a default where there is none. Catalyst broadcasts what is small."""
    usable = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    rows = table(spark, sf_dir, "orders").join(usable, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.lit("(omitted)")).alias("title"), F.coalesce("n_name", F.lit("(omitted)")).alias("description"))


@query("""select l_orderkey, l_linenumber, l_returnflag from (select *, max((l_returnflag = 'R')::int) over (partition by l_orderkey) as any_r,
row_number() over (partition by l_orderkey, l_returnflag = 'R' order by l_linenumber, l_partkey, l_suppkey) as r from lineitem)
where (l_returnflag = 'R' and r = 1) or (any_r = 0 and l_returnflag <> 'N')""")
def prefer_full_else_all(spark, sf_dir):
    """Per order the first returned line, else every line that isn't new."""
    preferred, usable = F.col("l_returnflag") == "R", F.col("l_returnflag") != "N"
    rows = R.preferred_else_all(table(spark, sf_dir, "lineitem"), ["l_orderkey"], preferred, usable, ["l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag")


@query("select doc_id, source, n_chars, running from (select *, (sum(n_chars) over (order by doc_id))::bigint as running from documents) where running <= (select sum(n_chars) // 3 from documents)")
def budget_stop(spark, sf_dir):
    """Documents in id order within a third of all characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    limit = docs.agg(F.sum("n_chars")).first()[0] // 3
    return R.budget_stop(docs, "doc_id", "n_chars", limit).select("doc_id", "source", "n_chars", long("running", "running"))


@query("select doc_id, lang, ((row_number() over (partition by lang order by doc_id) - 1) // 64)::bigint as cohort from documents")
def cohorts(spark, sf_dir):
    return R.cohorts(table(spark, sf_dir, "documents"), ["doc_id"], 64, ["lang"]).select("doc_id", "lang", "cohort")


@query("select doc_id, quality from (select *, row_number() over (order by sha256('1337|' || doc_id), doc_id) as r from labels) where r <= 50")
def seeded_sample(spark, sf_dir):
    return R.seeded_sample(table(spark, sf_dir, "labels"), "doc_id", 50, "1337").select("doc_id", "quality")


@query("""with r as (select doc_id, quality, row_number() over (partition by quality = 1 order by sha256('1337|' || doc_id), doc_id) as r, count(*) filter (quality = 1) over () as yes, count(*) filter (quality <> 1) over () as no from labels)
select doc_id, quality from r where r <= case when quality = 1 then greatest(20, 40 - least(no, 20)) else 40 - least(yes, greatest(20, 40 - least(no, 20))) end""")
def balanced_sample(spark, sf_dir):
    return R.balanced_sample(table(spark, sf_dir, "labels"), F.col("quality") == 1, "doc_id", 40, "1337").select("doc_id", "quality")


@query("select o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey from orders group by o_custkey")
def argmax_tiebreak(spark, sf_dir):
    return R.argmax(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice", "o_orderkey"])


@query("select o_custkey, min_by(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey, min(o_totalprice) as o_totalprice from orders group by o_custkey")
def best_step(spark, sf_dir):
    return M.best(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", "o_custkey")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r <= 3")
def latest_k(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("select doc_id, v::int as variant, lang || '_' || doc_id || '_v' || v as pair_id from documents, range(2) t(v)")
def variant_explode(spark, sf_dir):
    rows = R.variants(table(spark, sf_dir, "documents"), 2)
    return rows.select("doc_id", "variant", T.pair_id(F.col("lang"), F.col("doc_id").cast("string"), F.col("variant")).alias("pair_id"))


@query(f"select doc_id, case when u < 0.25 then 'g711' when u < 0.5 then 'gsm' when u < 0.75 then 'opus' else 'pass_through' end as codec from (select doc_id, {_UNIT.format(key="'codec|' || doc_id")} as u from documents)")
def weighted_choice(spark, sf_dir):
    unit = R.hash_unit("codec", F.col("doc_id"))
    return R.weighted_choice(table(spark, sf_dir, "documents"), unit, [("g711", 2), ("gsm", 2), ("opus", 2), ("pass_through", 2)], "codec").select("doc_id", "codec")


@query()
def stable_seed(spark, sf_dir):
    """32-bit seeds from BLAKE2b."""
    rows = R.variants(table(spark, sf_dir, "documents"), 2)
    return rows.select("doc_id", "variant", S.stable_seeds(F.lit(1337), F.col("lang"), F.col("doc_id").cast("string"), F.col("variant")).alias("seed"))


@query("""select conv_id, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' order by turn) as sentence, count(*)::bigint as clips, min(len(text))::bigint as least, max(len(text))::bigint as most from conversations group by conv_id having count(*) >= 2""")
def concat_variants(spark, sf_dir):
    """Sentences of groups of at least two clips, joined in order."""
    item = F.struct("turn", T.squeeze(F.col("text")).alias("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("clips"), long(F.min(F.length("text")), "least"), long(F.max(F.length("text")), "most")
    )
    return rows.where("clips >= 2").select("conv_id", F.array_join("items.text", " ").alias("sentence"), "clips", "least", "most")


@query("""with days as (select distinct user_id, ts::date as day from events), u as (select distinct user_id from events), spine as (select user_id, unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date as day from u)
select user_id, day from spine where not exists (select 1 from days where days.user_id = spine.user_id and days.day = spine.day)""")
def date_spine_missing(spark, sf_dir):
    """Days of January without events, by user."""
    events = table(spark, sf_dir, "events")
    spine = R.date_spine(events.select("user_id").distinct(), F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    return spine.join(events.select("user_id", F.to_date("ts").alias("day")).distinct(), ["user_id", "day"], "left_anti").select("user_id", "day")


# Aggregates


@query("""select dimension, value, count(*)::bigint as rows from (select unnest(['flag', 'status', 'month', 'discount']) as dimension,
unnest([l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m'), case when l_discount = 0 then 'none' else 'some' end]) as value from lineitem) group by 1, 2""")
def manifest_distributions(spark, sf_dir):
    """Value counts of several columns in one pass; empty and zero are "none"."""
    some = F.when(F.col("l_discount") == 0, F.lit("0")).otherwise("some")
    return M.value_counts(table(spark, sf_dir, "lineitem"), {
        "flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "month": F.date_format("l_shipdate", "yyyy-MM"), "discount": some,
    })


@query("""select event_type, count(value)::bigint as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.9), 6) as p90,
min(value) as least, max(value) as most from events group by event_type""")
def numeric_summary(spark, sf_dir):
    rows = M.summary(table(spark, sf_dir, "events"), "value", "event_type")
    return rows.select("event_type", "n", *[rounded(c, c) for c in ("mean", "median", "p10", "p90")], "least", "most")


@query("""select user_id, round(coalesce(sum(value) filter (event_type <> 'error'), 0) / 3600, 6) as hours, count(*) filter (event_type <> 'error')::bigint as ok, count(*) filter (event_type = 'error')::bigint as failed from events group by user_id""")
def hours_total(spark, sf_dir):
    rows = M.hours(table(spark, sf_dir, "events"), "value", F.col("event_type") == "error", "user_id")
    return rows.select("user_id", rounded(F.coalesce("hours", F.lit(0.0)), "hours"), "ok", "failed")


@query("""select l_returnflag, l_linestatus, level, rows, round(identity, 4) as identity, round(distance, 4) as distance, round(case when identity <= 0 then 0 else (identity - distance) / identity end, 6) as captured from (
select l_returnflag, l_linestatus, case when grouping(l_linestatus) = 0 then 'l_linestatus' when grouping(l_returnflag) = 0 then 'l_returnflag' else '' end as level, count(*)::bigint as rows, avg(l_extendedprice) as identity, avg(l_extendedprice * (1 - l_discount)) as distance
from lineitem group by grouping sets ((), (l_returnflag), (l_linestatus)))""")
def captured_grouping_sets(spark, sf_dir):
    """One metric at three granularities in one pass."""
    rows = table(spark, sf_dir, "lineitem").withColumn("distance", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    rows = M.grouped_means(rows, [[], ["l_returnflag"], ["l_linestatus"]], "l_extendedprice", "distance")
    return rows.select("l_returnflag", "l_linestatus", "level", "rows", rounded("identity", "identity", 4), rounded("distance", "distance", 4), rounded("captured", "captured"))


@query("select event_type, user_id, count(*)::bigint as rows, count(*) filter (value > 50)::bigint as large, grouping(event_type, user_id)::bigint as level from events group by rollup(event_type, user_id)")
def rollup_flags(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("event_type", "user_id").agg(F.count("*").alias("rows"), F.count_if(F.col("value") > 50).alias("large"), long(F.grouping_id(), "level"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Turns as references, and hypotheses that drop every fifth word and change every seventh."""
    words = F.filter(F.split(T.squeeze(F.col("text")), " "), lambda w: w != "")
    kept = F.filter(F.transform(words, lambda w, i: F.when(i % 5 == 4, F.lit(None)).when(i % 7 == 6, F.lit("x")).otherwise(w)), lambda w: w.isNotNull())
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(words, " ").alias("reference"), F.array_join(kept, " ").alias("hypothesis"))


_PAIRS = """p0 as (select conv_id, turn, role, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') as r from conversations),
p1 as (select row_number() over () as pair, *, list_filter([case when (i - 1) % 5 = 4 then null when (i - 1) % 7 = 6 then 'x' else r[i] end for i in range(1, len(r) + 1)], lambda v: v is not null) as h from p0),
p as (select *, array_to_string(r, ' ') as reference, array_to_string(h, ' ') as hypothesis from p1)"""

# DuckDB compares bytes, so a pair's characters are first written as letters of ASCII; the tables' pairs have fewer distinct ones.
_LETTERS = "".join(map(chr, [*range(48, 127), *range(33, 48)])).replace("'", "''")


def _char_edits(a: str, b: str) -> str:
    own = f"array_to_string(list_distinct(regexp_extract_all({a} || {b}, '(?s).')), '')"
    coded = lambda x: f"translate({x}, {own}, '{_LETTERS}'[1:len({own})])"
    return f"levenshtein({coded(a)}, {coded(b)})"


# The distance matrix of words by its diagonals: cur is the diagonal's value at row i, before the one of the diagonal before.
_WORD_EDITS = """x as (select pair, len(r) as n, len(h) as m, r, h from p),
t(pair, n, m, i, d, cur, before) as (
    select pair, n, m, i, 0, case when i = 0 then 0 end, null::bigint from x, range(0, n + 1) g(i) union all
    select s.pair, s.n, s.m, s.i, s.d, case when s.j < 0 or s.j > s.m then null when s.i = 0 then s.j when s.j = 0 then s.i else least(cur + 1, up + 1, diag + (x.r[s.i] <> x.h[s.j])::int) end, cur
    from (select pair, n, m, i, d + 1 as d, d + 1 - i as j, cur, lag(cur) over (partition by pair order by i) as up, lag(before) over (partition by pair order by i) as diag from t where d < n + m) s join x on s.pair = x.pair),
we as (select pair, cur as word_edits from t where d = n + m and i = n)"""


@query(f"""with recursive {_PAIRS}, {_WORD_EDITS}, e as (select role, word_edits, len(r) as words, {_char_edits('reference', 'hypothesis')} as char_edits, len(reference) as chars from p join we using (pair))
select coalesce(role, 'all') as role, count(*)::bigint as examples, round(sum(word_edits) / sum(words)::double, 6) as wer, round(sum(char_edits) / sum(chars)::double, 6) as cer from e group by rollup(role)""")
def wer_by_dataset(spark, sf_dir):
    """Word and character error rates by role and overall, over edits of whole texts."""
    rows = M.error_counts(_pairs(spark, sf_dir), F.col("reference"), F.col("hypothesis"))
    return M.error_rates(rows, "role", overall=True).select(F.coalesce("role", F.lit("all")).alias("role"), "examples", rounded("wer", "wer"), rounded("cer", "cer"))


@query(f"""with {_PAIRS}, e as (select role, {_char_edits('reference', 'hypothesis')} as edits, len(reference) as n from p)
select coalesce(role, 'all') as role, count(*)::bigint as examples, round(sum(edits) / sum(n)::double, 6) as cer from e group by rollup(role)""")
def cer_by_dataset(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("role", E.char_edits("reference", "hypothesis").alias("char_edits"), F.length("reference").alias("chars"))
    rate = rounded(F.sum("char_edits") / F.sum("chars"), "cer")
    return rows.rollup("role").agg(F.count("*").alias("examples"), rate).select(F.coalesce("role", F.lit("all")).alias("role"), "examples", "cer")


@query(f"""with {_PAIRS}, d as (select *, case when reference = hypothesis then 0.0 when reference = '' or hypothesis = '' then 1.0 else {_char_edits('reference', 'hypothesis')} / greatest(len(reference), len(hypothesis))::double end as distance from p)
select conv_id, turn, round(distance, 6) as distance, case when role = 'system' then 'model_uncertain' when reference = '' then 'target_normalization_rejected' when hypothesis = '' then 'persian_normalization_rejected' when distance > 0.25 then 'edit_distance_exceeded' end as reason from d""")
def edit_gate(spark, sf_dir):
    """The distance of two texts, and the first check that fails."""
    distance = T.edit_distance(F.col("reference"), F.col("hypothesis"))
    reason = C.first_reason(
        ("model_uncertain", F.col("role") == "system"), ("target_normalization_rejected", F.col("reference") == ""),
        ("persian_normalization_rejected", F.col("hypothesis") == ""), ("edit_distance_exceeded", distance > 0.25),
    )
    return _pairs(spark, sf_dir).select("conv_id", "turn", rounded(distance, "distance"), reason.alias("reason"))


@query(f"""with {_PAIRS}, n as (select conv_id, turn, role, {_latin('reference')} as wanted, {_latin('hypothesis')} as cleaned from p),
d as (select *, case when wanted = cleaned then 0.0 when wanted = '' or cleaned = '' then 1.0 else {_char_edits('wanted', 'cleaned')} / greatest(len(wanted), len(cleaned))::double end as distance from n)
select conv_id, turn, cleaned as cleaned_text, round(distance, 6) as distance, case when role = 'system' then 'model_uncertain' when coalesce(cleaned, '') = '' then 'persian_normalization_rejected' when coalesce(wanted, '') = '' then 'target_normalization_rejected'
when regexp_extract_all(wanted, '(\\p{{Nd}}+)', 1) <> regexp_extract_all(cleaned, '(\\p{{Nd}}+)', 1) then 'numeric_tokens_changed' when distance > 0.35 then 'edit_distance_exceeded' end as reason from d""")
def response_ledger(spark, sf_dir):
    """JSON responses through the whole ladder of checks."""
    rows = _pairs(spark, sf_dir).withColumn("response", F.to_json(F.struct(F.col("hypothesis").alias("cleaned_text"), (F.col("role") == "system").alias("uncertain"))))
    rows = X.validate(rows, "response", "reference", T.normalize_latin)
    return rows.select("conv_id", "turn", "cleaned_text", rounded("distance", "distance"), "reason")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger: normalized turns with context, validated responses, and error rates by role of what was accepted."""
    rows = _pairs(spark, sf_dir).withColumn("response", F.to_json(F.struct(F.col("hypothesis").alias("cleaned_text"), F.lit(False).alias("uncertain"))))
    rows = X.validate(rows, "response", "reference", T.normalize_latin)
    rows = X.context(rows, "conv_id", ["turn"], "reference", F.col("reason").isNull(), 3, 3)
    rows = M.error_counts(rows, F.col("reference"), F.col("hypothesis"))
    return rows.groupBy("role", F.coalesce("reason", F.lit("accepted")).alias("status")).agg(
        F.count("*").alias("examples"), F.avg(F.size("preceding")).alias("context"), (F.sum("word_edits") / F.sum("words")).alias("wer"), (F.sum("char_edits") / F.sum("chars")).alias("cer")
    )


@query("select round(avg(m), 6) as macro_mean from (select avg(value) as m from events group by event_id // 64)")
def macro_batch_mean(spark, sf_dir):
    return M.macro_batch_mean(table(spark, sf_dir, "events"), F.floor(F.col("event_id") / 64), "value").select(rounded("macro_mean", "macro_mean"))


@query("select round(avg(g), 6) as mean, round(median(g), 6) as median, round(avg(1 - g), 6) as other_mean, round(median(1 - g), 6) as other_median from (select l_discount as g from lineitem)")
def gate_usage(spark, sf_dir):
    rows = M.usage(table(spark, sf_dir, "lineitem"), "l_discount")
    return rows.select(*[rounded(c, c) for c in rows.columns])


@query("select source, count(*)::bigint as rows, count(distinct lang)::bigint as langs from documents group by source")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("lang").alias("langs"))


@query("select sum(n_chars)::bigint - sum(len(trim(regexp_replace(text, '\\s+', ' ', 'g'))))::bigint as saved, round(100.0 * (sum(n_chars) - sum(len(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) / sum(n_chars)::double, 6) as percent from documents")
def space_saved(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("n_chars", F.length(T.squeeze(F.col("text"))).alias("after"))
    return M.space_saved(rows, "n_chars", "after").select(long("saved", "saved"), rounded("percent", "percent"))


# Order


_TURNS = "(partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"


@query(f"""select conv_id, turn, list_slice(h, greatest(len(h) - 2, 1), len(h)) as preceding, following from (select conv_id, turn,
coalesce(list(text) filter (role = 'user') over {_TURNS}, []) as h, coalesce(list(text) over (partition by conv_id order by turn rows between 1 following and 3 following), []) as following from conversations)""")
def context_window(spark, sf_dir):
    """The last three accepted (user) turns before, and the next three after."""
    rows = X.context(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", F.col("role") == "user", 3, 3)
    return rows.select("conv_id", "turn", "preceding", "following")


@query(f"""select conv_id, turn, 'Title: ' || role || chr(10) || 'Description: (omitted)' || chr(10) || 'Preceding:' || chr(10) || case when len(h) = 0 then '(none)' else array_to_string(list_slice(h, greatest(len(h) - 2, 1), len(h)), chr(10)) end
|| chr(10) || 'Target:' || chr(10) || text || chr(10) || 'Following:' || chr(10) || case when len(f) = 0 then '(none)' else array_to_string(f, chr(10)) end as prompt from (select conv_id, turn, role, text,
coalesce(list(text) filter (role = 'user') over {_TURNS}, []) as h, coalesce(list(text) over (partition by conv_id order by turn rows between 1 following and 3 following), []) as f from conversations)""")
def prompt_render(spark, sf_dir):
    rows = X.context(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", F.col("role") == "user", 3, 3)
    prompt = T.prompt(F.col("role"), F.lit(None).cast("string"), F.col("preceding"), F.col("text"), F.col("following"))
    return rows.select("conv_id", "turn", prompt.alias("prompt"))


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::bigint as wave from conversations")
def round_robin_waves(spark, sf_dir):
    return X.waves(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "wave")


_FRAMES = "f as (select user_id, event_id, value, value >= 30 as active, coalesce(lag(value >= 30) over (partition by user_id order by event_id), false) as was from events)"


@query(f"""with {_FRAMES}, r as (select *, sum((active and not was)::int) over (partition by user_id order by event_id) as run from f)
select user_id, run::bigint as run, min(event_id) as first, max(event_id) as last, count(*)::bigint as frames, round(avg(value), 6) as mean, max(value) as most from r where active group by user_id, run having count(*) >= 2""")
def speech_runs(spark, sf_dir):
    """Runs of events at or above a threshold, of at least two."""
    rows = I.runs(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 30.0).where("frames >= 2")
    return rows.select("user_id", long("run", "run"), "first", "last", "frames", rounded("mean", "mean"), "most")


def _intervals(spark, sf_dir) -> DataFrame:
    """Events as intervals: from their second, for value seconds, at least one."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double") - 1704067200.0
    return table(spark, sf_dir, "events").select(
        "user_id", seconds.alias("start_sec"), (seconds + F.greatest(F.col("value"), F.lit(1.0)) * 60).alias("end_sec"), F.col("value").alias("mean_probability"), F.col("value").alias("max_probability"), "event_id"
    )


_INTERVALS = "i as (select user_id, event_id, epoch_us(ts) // 1000000 - 1704067200.0::double as s, (epoch_us(ts) // 1000000 - 1704067200.0::double) + greatest(value, 1.0::double) * 60 as e, value as v from events)"
_ISLANDS = f"""{_INTERVALS}, g as (select *, case when s - max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) < 3600 then 0 else 1 end as fresh from i),
n as (select *, sum(fresh) over (partition by user_id order by s, e) as island from g)"""


@query(f"with {_ISLANDS} select user_id, min(s) as start_sec, round(max(e), 4) as end_sec, count(*)::bigint as parts from n group by user_id, island")
def merge_gaps(spark, sf_dir):
    """Intervals less than an hour apart become one."""
    rows = I.islands(_intervals(spark, sf_dir), "user_id", "start_sec", "end_sec", 3600.0)
    return rows.groupBy("user_id", "island").agg(F.min("start_sec").alias("start_sec"), rounded(F.max("end_sec"), "end_sec", 4), F.count("*").alias("parts")).drop("island")


@query(f"with {_ISLANDS} select user_id, min(s) as start_sec, round(list_reduce(list(v order by s, e, v), lambda a, b: (a + b) / 2), 6) as mean, max(v) as most from n group by user_id, island")
def merge_gaps_pairwise_mean(spark, sf_dir):
    """As merge_gaps; the mean is a fold of pairwise means."""
    rows = I.merge_pairwise(_intervals(spark, sf_dir), "user_id", 3600.0)
    return rows.select("user_id", "start_sec", rounded("mean_probability", "mean"), F.col("max_probability").alias("most"))


@query(f"""with {_INTERVALS}, d as (select distinct user_id, floor(s / 21600) * 21600 as a from i)
select d.user_id, a as start_sec, round(coalesce(sum(least(a + 21600, e) - greatest(a, s)), 0), 4) as seconds from d left join i on d.user_id = i.user_id and a < e and s < a + 21600 group by d.user_id, a""")
def interval_overlap(spark, sf_dir):
    """Seconds of six-hour windows that intervals cover, with repeats counted."""
    own = _intervals(spark, sf_dir)
    start = F.floor(F.col("start_sec") / 21600).cast("double") * 21600.0
    windows = own.select("user_id", start.alias("start_sec"), (start + 21600.0).alias("end_sec")).distinct()
    return I.overlap(windows, own, "user_id", 21600.0).select("user_id", "start_sec", rounded("seconds", "seconds", 4))


@query(f"""with {_INTERVALS}, g as (select user_id, e, lead(s) over (partition by user_id order by s, e) - e as gap from i)
select user_id, round(min_by(e + gap / 2, (abs(e + gap / 2 - 1296000), e + gap / 2)), 4) as midpoint from g where gap >= 1800 group by user_id""")
def silence_candidates(spark, sf_dir):
    """The middle of the pause nearest to a target time, by user; of equally near ones the earlier."""
    rows = I.silences(_intervals(spark, sf_dir), "user_id", 1800.0)
    order = F.struct(F.abs(F.col("midpoint") - 1296000.0), F.col("midpoint"))
    return rows.groupBy("user_id").agg(rounded(F.min_by("midpoint", order), "midpoint", 4))


@query()
def segment_greedy(spark, sf_dir):
    """Clips of every user's recording, one cut after the other."""
    rows = _intervals(spark, sf_dir).withColumn("start_sec", F.col("start_sec") / 600).withColumn("end_sec", F.col("end_sec") / 600)
    rows = I.islands(rows, "user_id", "start_sec", "end_sec", 0.5).groupBy("user_id", "island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))
    rows = rows.withColumn("duration", F.lit(4400.0))
    return I.segments(rows, "user_id", "duration").select("user_id", rounded("start_sec", "start_sec", 4), rounded("end_sec", "end_sec", 4), rounded("speech_seconds", "speech_seconds", 4), "boundary_type")


@query("""with recursive o as (select conv_id, turn, len(text)::double as length, row_number() over (partition by conv_id order by len(text) desc, turn) as i from conversations),
t(conv_id, i, batch, rows, longest) as (select conv_id, 1::bigint, 0::bigint, 1::bigint, length from o where i = 1 union all
    select o.conv_id, o.i, t.batch + full_::int, case when full_ then 1 else t.rows + 1 end, case when full_ then o.length else t.longest end
    from (select t.*, rows + 1 > 8 or (rows + 1) * longest * longest > 1500.0 * 1500.0 as full_ from t) t join o on o.conv_id = t.conv_id and o.i = t.i + 1)
select o.conv_id, o.turn, t.batch from o join t on o.conv_id = t.conv_id and o.i = t.i""")
def batch_pack(spark, sf_dir):
    """Conversations' turns packed into batches by length."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("length"))
    return I.packed(rows, "conv_id", "turn", "length", 8, 1500.0)


@query("""with t as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as was from events)
select user_id, list(event_type order by event_id) filter (event_type <> 'view' and (was is null or event_type <> was)) as tokens from t group by user_id""")
def ctc_collapse(spark, sf_dir):
    """Event types in order without repeats and blanks ("view")."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("items"))
    return rows.select("user_id", A.ctc_collapse(F.col("items.event_type"), F.lit("view")).alias("tokens"))


# Arrays: embeddings as waveforms of 64 samples

_V = "v as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings)"
_SQUARES = "list_sum(list_transform({x}, lambda q: q * q))"


def _waves(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("x"))


@query(f"""with {_V}, r as (select vec_id, x, sqrt({_SQUARES.format(x='x')} / len(x) + 1e-12) as rms, list_max(list_transform(x, lambda q: abs(q))) as peak from v)
select vec_id, round(rms, 6) as rms, round(case when peak > 0.2 then 0.2 / peak else 1.0 end, 6) as scale, round(case when rms <= 1e-6 then 1.0 else least(0.05 / rms, 20.0) end, 6) as gain,
round(len(list_filter(x, lambda q: abs(q) > 0.15)) / len(x)::double, 6) as clipped from r""")
def array_levels(spark, sf_dir):
    """Level, peak scale, gain and clipped fraction."""
    x = F.col("x")
    return _waves(spark, sf_dir).select("vec_id", rounded(A.rms(x), "rms"), rounded(A.peak_scale(x, 0.2), "scale"), rounded(A.rms_gain(x), "gain"), rounded(A.clipped_fraction(x, 0.15), "clipped"))


@query(f"""with {_V}, p as (select a.vec_id, a.x as a, b.x as b, list_transform(list_zip(a.x, b.x), lambda z: z[1] - z[2]) as d from v a join v b on b.vec_id = a.vec_id + 1),
s as (select *, list_transform(range(0, len(a)), lambda i: a[((i - 3 + len(a)) % len(a))::int + 1]) as c from p), q as (select *, list_transform(list_zip(b, c), lambda z: z[1] - z[2]) as e from s)
select vec_id, round(list_sum(list_transform(d, lambda q: abs(q))) / len(a), 6) as l1, round(sqrt({_SQUARES.format(x='d')}) / (sqrt({_SQUARES.format(x='a')}) + 1e-12), 6) as l2,
round(case when {_SQUARES.format(x='c')} <= 1e-12 then 0.0 else 10 * log10({_SQUARES.format(x='c')} / ({_SQUARES.format(x='e')} + 1e-12)) end, 6) as snr from q""")
def array_distances(spark, sf_dir):
    """Distances of each vector to the next."""
    a = _waves(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "vec_id").select("vec_id", rounded(A.l1(x, y), "l1"), rounded(A.relative_l2(x, y), "l2"), rounded(A.waveform_snr(x, y, F.lit(3)), "snr"))


# Every lag's correlation as a sum of products; the later copy is turned upside down, so the correlation is negative.
_LAGS = """m as (select vec_id, list_transform(x, lambda q: q - list_sum(x) / len(x)) as b, list_transform(range(0, len(x)), lambda i: -(x[((i - 7 + len(x)) % len(x))::int + 1] - list_sum(x) / len(x))) as a from v),
l as (select vec_id, lag, list_sum(list_transform(range(greatest(0, -lag), least(len(a), len(a) - lag)), lambda t: b[t + 1] * a[t + lag + 1])) / (sqrt(list_sum(list_transform(a, lambda q: q * q)) * list_sum(list_transform(b, lambda q: q * q))) + 1e-12) as corr from m, range(-20, 21) g(lag))"""


@query(f"with {_V}, {_LAGS} select vec_id, max_by(lag, abs(round(corr, 9)))::bigint as lag, round(max_by(corr, abs(round(corr, 9))), 6) as corr from l group by vec_id")
def best_lag(spark, sf_dir):
    """Shift and signed correlation of each vector's copy, rolled by seven and turned upside down, against the vector."""
    x = F.col("x")
    rows = _waves(spark, sf_dir).select("vec_id", S.best_lags(F.transform(A.rolled(x, F.lit(7)), lambda v: -v), x, F.lit(20)).alias("r"))
    return rows.select("vec_id", "r.lag", rounded("r.corr", "corr"))


@query(f"with {_V}, {_LAGS} select vec_id, min_by(lag, (round(corr, 9), lag))::bigint as lag from l group by vec_id")
def alignment_lag(spark, sf_dir):
    """The lag of the highest signed correlation: of the vector against its copy, rolled by seven."""
    x = F.col("x")
    return _waves(spark, sf_dir).select("vec_id", S.alignment_lags(x, A.rolled(x, F.lit(7)), F.lit(20)).alias("lag"))


_POWER = """f as (select vec_id, k, (list_sum(list_transform(range(0, len(x)), lambda t: x[t + 1] * cos(2 * pi() * k * t / len(x)))) ** 2 + list_sum(list_transform(range(0, len(x)), lambda t: x[t + 1] * sin(2 * pi() * k * t / len(x)))) ** 2) as power from v, range(0, 33) g(k))"""


@query(f"with {_V}, {_POWER} select vec_id, round(sum(power) filter (k * 16000.0 / 64 > 3400) / (sum(power) + 1e-12), 6) as fraction from f group by vec_id")
def high_fraction(spark, sf_dir):
    """Energy above a frequency, of all."""
    return _waves(spark, sf_dir).select("vec_id", rounded(S.high_fractions(F.col("x"), F.lit(16000), F.lit(3400.0)), "fraction"))


@query()
def hf_energy(spark, sf_dir):
    """Energy above a frequency, before and after a band-pass."""
    x, rate = F.col("x"), F.lit(16000)
    passed = S.bandpassed(x, rate, F.lit(300.0), F.lit(3400.0))
    rows = _waves(spark, sf_dir).select("vec_id", S.high_fractions(x, rate, F.lit(3400.0)).alias("before"), passed.alias("y"))
    return rows.select("vec_id", rounded("before", "before"), rounded(S.high_fractions(F.col("y"), rate, F.lit(3400.0)), "after"))


@query()
def degraded_variants(spark, sf_dir):
    """Two seeded degradations of every vector: codec, level of noise, observed loss and the new level."""
    rows = R.variants(_waves(spark, sf_dir), 2)

    def run(parts):
        for part in parts:
            out = []
            for vec_id, x, variant in zip(part["vec_id"], part["x"], part["variant"]):
                y, facts = S.degrade(x, x[::-1], 16000, S.stable_seed(1337, "train", str(vec_id), int(variant)))
                out.append((vec_id, variant, facts["codec"], facts["snr_db"], facts["observed_loss"], float(abs(y).max())))
            yield pd.DataFrame(out, columns=["vec_id", "variant", "codec", "snr_db", "observed_loss", "peak"])

    return rows.mapInPandas(run, "vec_id long, variant int, codec string, snr_db double, observed_loss double, peak double")


# Pages

_STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"""select page_id, coalesce(nullif({_STRIP.format(x="regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")}, ''), nullif({_STRIP.format(x="regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")}, '')) as title from pages""")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query("select distinct page_id, unnest(regexp_extract_all(html, '(?i)href=[\"'']([^\"'']+)', 1)) as link from pages")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("link"))


@query(f"select page_id, {_STRIP.format(x='html')} as text from pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.strip_tags(F.col("html")).alias("text"))


@query("""select page_id, regexp_extract(url, '^(https?)://', 1) as protocol, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, regexp_replace(url, '#.*$', '') as normalized from pages""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.try_parse_url(url, F.lit("PROTOCOL")).alias("protocol"), F.try_parse_url(url, F.lit("HOST")).alias("host"), H.query_value(url, "page").alias("page"), H.normalized_url(url).alias("normalized")
    )


# Ledgers and comparison

_NOW = "w as (select doc_id, source, sha256(text) as digest from documents)"
_PRIOR = "p as (select doc_id, source, case when doc_id % 5 = 0 then 'old' else sha256(text) end as digest, doc_id % 7 = 0 as operational from documents where lang <> 'de')"


def _ledger(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    prior = docs.where("lang <> 'de'").select("doc_id", "source", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("digest")).alias("digest"), (F.col("doc_id") % 7 == 0).alias("operational"))
    return docs.select("doc_id", "source", "digest"), prior


@query(f"with {_NOW}, {_PRIOR} select w.doc_id, w.digest, coalesce(not p.operational and p.digest = w.digest, false) as reused from w left join p on w.doc_id = p.doc_id")
def reuse_ledger(spark, sf_dir):
    """Rows whose prior result holds still: same digest, and no operational failure."""
    work, prior = _ledger(spark, sf_dir)
    return R.reuse(work, prior, "doc_id", ["digest"]).select("doc_id", "digest", "reused")


@query("""select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'P') union all
select o_orderkey, o_custkey, 'new' from orders where o_orderstatus = 'P'""")
def group_upsert(spark, sf_dir):
    """Customers with pending orders are replaced as a whole."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.upsert_groups(orders, orders.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("new")), "o_custkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""with n as (select c_custkey, case when c_acctbal < 0 then null else c_name end as c_name, c_acctbal + 1 as c_acctbal from customer where c_mktsegment = 'BUILDING'), o as (select c_custkey, c_name, c_acctbal from customer where c_mktsegment <> 'MACHINERY')
select coalesce(n.c_custkey, o.c_custkey) as c_custkey, case when n.c_custkey is not null then n.c_name else o.c_name end as c_name, round(case when n.c_custkey is not null then n.c_acctbal else o.c_acctbal end, 2) as c_acctbal from o full join n on o.c_custkey = n.c_custkey""")
def overlay_merge(spark, sf_dir):
    """New fields win where a new row exists, nulls too."""
    rows = table(spark, sf_dir, "customer")
    new = rows.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    old = rows.where("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_name", "c_acctbal")
    return R.overlay(old, new, "c_custkey").select("c_custkey", "c_name", rounded("c_acctbal", "c_acctbal", 2))


@query(f"with {_NOW}, {_PRIOR} select p.doc_id, p.source from p left join w on w.doc_id = p.doc_id where p.digest is distinct from w.digest")
def stale_check(spark, sf_dir):
    work, prior = _ledger(spark, sf_dir)
    return R.stale(prior, work.select("doc_id", "digest"), "doc_id", "digest").select("doc_id", "source")


@query("""with b as (select o_orderkey, o_custkey, case when o_orderkey % 10 = 3 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderpriority <> '1-URGENT'), a as (select o_orderkey, o_custkey, o_orderstatus from orders where o_orderpriority <> '5-LOW')
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'only_left' when a.o_orderkey is null then 'only_right' else 'changed' end as side from a full join b on a.o_orderkey = b.o_orderkey
where a.o_orderkey is null or b.o_orderkey is null or a.o_custkey <> b.o_custkey or a.o_orderstatus <> b.o_orderstatus""")
def table_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 10 == 3, "X").otherwise(F.col("o_orderstatus"))
    return R.table_diff(orders.where("o_orderpriority <> '5-LOW'"), orders.where("o_orderpriority <> '1-URGENT'").withColumn("o_orderstatus", status), "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("""with a as (select turn, count(*)::bigint as rows, sum(len(text))::bigint as chars from conversations group by turn), b as (select turn, rows + (turn % 3 = 1)::int as rows, chars from a where turn > 0)
select a.turn, case when b.turn is null then 'only_left' else 'changed' end as side from a left join b on a.turn = b.turn where b.turn is null or a.rows <> b.rows""")
def ordered_equal(spark, sf_dir):
    """A table against itself without its first ordinal and with some counts raised."""
    rows = table(spark, sf_dir, "conversations").groupBy("turn").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    other = rows.where("turn > 0").withColumn("rows", F.col("rows") + F.when(F.col("turn") % 3 == 1, 1).otherwise(0))
    return R.ordered_differences(rows, other, "turn")


@query("select 'benchmark' as dataset, item_id as id, len(text)::bigint as chars from benchmark union all select 'documents', doc_id, len(text)::bigint from documents")
def union_label(spark, sf_dir):
    parts = {"benchmark": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), "documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")}
    return R.labelled_union(parts).select("dataset", "id", long(F.length("text"), "chars"))


# Streams


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*)::bigint as rows from events group by 1, 2")
def tumbling(spark, sf_dir):
    rows = Inc.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", F.col("event_type"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "rows")


@query("select time_bucket(interval 1 hour, ts) - to_hours(k::int) as start, count(*)::bigint as rows from events, range(3) t(k) group by 1")
def sliding(spark, sf_dir):
    rows = Inc.sliding(table(spark, sf_dir, "events"), "ts", "3 hours", "1 hour")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "rows")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 2 hours then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts) as s from g)
select user_id, min(ts) as start, count(*)::bigint as rows from s group by user_id, s""")
def session(spark, sf_dir):
    rows = Inc.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", F.col("user_id"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "rows")


@query("select event_type, count(*)::bigint as rows, round(sum(value), 4) as value from events group by event_type")
def incremental_snapshot(spark, sf_dir):
    """A stream over the files that are there, in micro-batches that each append to one table."""
    import uuid

    own = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source streams a folder; the pattern picks the one table's files.
    source = f"{sf_dir}/events.parque[t]"
    Inc.run_available(Inc.stream_of(spark, source, schema), f"{own}/checkpoint", path=f"{own}/rows")
    return spark.read.schema(schema).parquet(f"{own}/rows").groupBy("event_type").agg(F.count("*").alias("rows"), rounded(F.sum("value"), "value", 4))


# The other parts register themselves here.
from nava.plans import rules, scans, sounds  # noqa: E402, F401
