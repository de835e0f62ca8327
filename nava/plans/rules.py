"""Catalogue, second part: constraints, identifiers, formats, choices and ledgers on the driver's whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nava.functions import dates as D
from nava.functions import text as T
from nava.operators import constraints as C
from nava.operators import context as X
from nava.operators import metrics as M
from nava.operators import relational as R
from nava.plans.catalogue import _UNIT
from nava.plans.registry import long, pick, query, rounded, sql_pick
from nava.session import table
from nava.sources import files


# Constraints


@query("select n_chars as target, count(distinct doc_id)::bigint as sources from documents group by n_chars having count(distinct doc_id) > 1")
def many_to_one(spark, sf_dir):
    return C.collisions(table(spark, sf_dir, "documents"), "doc_id", F.col("n_chars"))


_BLANKS = ("", "  ", "x", " y ")


@query(f"select doc_id from (select doc_id, {sql_pick('doc_id', *_BLANKS)} as t from documents) where trim(t) = ''")
def blank_rows(spark, sf_dir):
    """Rows whose text is empty but for blanks."""
    return C.blank(table(spark, sf_dir, "documents").select("doc_id", pick("doc_id", *_BLANKS).alias("t")), "t").select("doc_id")


@query("select event_id, value from events where value between 10 and 50")
def duration_window(spark, sf_dir):
    return C.duration_window(table(spark, sf_dir, "events"), "value", 10, 50).select("event_id", "value")


@query("select doc_id, case when len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) <= 100 then null else 'too_long' end as reason from documents")
def label_limit(spark, sf_dir):
    """Texts of at most a hundred words, and the others with their reason."""
    kept, skipped = C.split_by_limit(table(spark, sf_dir, "documents"), T.word_count(F.col("text")), 100)
    return kept.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(skipped.select("doc_id", "reason"))


_PATHS = ("clips/a.wav", "/clips/a.wav", "clips/../a.wav", "other/a.wav", "clips/b..c.wav", "../x")


@query(f"select doc_id, p as path from (select doc_id, {sql_pick('doc_id', *_PATHS)} as p from documents) where starts_with(p, '/') or list_contains(string_split(p, '/'), '..') or not starts_with(p, 'clips/')")
def unsafe_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", pick("doc_id", *_PATHS).alias("path"))
    return rows.where(T.unsafe_path(F.col("path")))


_URLS = ("https://a.example.org/x/1", "http://a.example.org/x/1", "https://b.example.org/x", "https://u@a.example.org/x/", "https://a.example.org:443/x/", "https://a.example.org/y", "https://a.example.org/x/?q=1#f", "no url")


@query(f"select doc_id, coalesce(regexp_matches(u, '^https://a\\.example\\.org/x/'), false) as allowed from (select doc_id, {sql_pick('doc_id', *_URLS)} as u from documents)")
def allowed_urls(spark, sf_dir):
    """https, a listed host, no user, no port, a listed path."""
    return table(spark, sf_dir, "documents").select("doc_id", C.allowed_url(pick("doc_id", *_URLS), ["a.example.org"], ["/x/"]).alias("allowed"))


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then false else o_orderdate::date <= (o_orderdate + to_days((o_custkey % 9 - 3)::int))::date and (o_orderdate + to_days((o_custkey % 9 - 3)::int))::date <= date '1998-01-01' end as valid from orders""")
def date_ranges(spark, sf_dir):
    """ISO dates, in order and not after a day; one in five can't be read."""
    first = F.when(F.col("o_orderkey") % 5 == 0, "1998-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    last = F.date_format(F.date_add("o_orderdate", (F.col("o_custkey") % 9 - 3).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.valid_range(first, last, F.lit("1998-01-01").cast("date")).alias("valid"))


@query("select c_custkey, list_filter([case when c_acctbal < 0 then 'balance' end, case when c_custkey % 3 = 0 then 'segment' end], lambda x: x is not null) as missing from customer")
def missing_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return rows.select("c_custkey", C.missing_fields("balance", "segment").alias("missing"))


@query("select count(*)::bigint as rows, min(quality - 1)::bigint as least, sum(quality - 1)::bigint as total from labels having count(*) = 0 or min(quality - 1) < 0 or sum(quality - 1) <= 0")
def invalid_weights(spark, sf_dir):
    """A distribution with negative weights."""
    found = C.invalid_weights(table(spark, sf_dir, "labels").select((F.col("quality") - 1).alias("w")), "w")
    return found.select("rows", long("least", "least"), long("total", "total"))


@query("""select doc_id, case when coalesce(lower(lang) not in ('en', 'de'), true) then 'extension' when n_chars <= 0 then 'empty' when n_chars > 3000 then 'size' when not (doc_id % 100 > 0 and doc_id % 100 <= 60) then 'duration' end as reason from documents""")
def upload_limits(spark, sf_dir):
    reason = C.upload_reason(F.col("lang"), F.col("n_chars"), (F.col("doc_id") % 100).cast("double"), ["en", "de"], 3000, 60.0)
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))


_NUMBERS = ("12", "007", "1a", "", "-3", "٣")


@query(f"select doc_id, case when regexp_full_match(t, '[0-9]+') then t end as number from (select doc_id, {sql_pick('doc_id', *_NUMBERS)} as t from documents)")
def digits_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.digits(pick("doc_id", *_NUMBERS)).alias("number"))


_CODECS = tuple(C.CODEC_PATHS) + ("unknown",)


@query(f"select doc_id, coalesce(n = p or n = 'drawn', false) as fits from (select doc_id, {sql_pick('doc_id', *[*C.CODEC_PATHS.values(), 'none'])} as n, case when doc_id % 2 = 0 then 'narrow' else 'wide' end as p from documents)")
def codec_fits(spark, sf_dir):
    """Whether a codec may stand in a channel path."""
    path = F.when(F.col("doc_id") % 2 == 0, "narrow").otherwise("wide")
    return table(spark, sf_dir, "documents").select("doc_id", C.codec_fits(pick("doc_id", *_CODECS), path).alias("fits"))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def work_left(spark, sf_dir):
    """Customers without a large order: outputs that are not there or empty."""
    listing = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("length"))
    return R.not_existing(table(spark, sf_dir, "customer"), listing, "c_custkey").select("c_custkey", "c_name")


_STATION = " ".join(f"when s = '{s}' then '{r}'" for s, r in T.STATION_EXCLUDED)
_INSIDE = " or ".join(f"s::int between {a} and {b}" for a, b in T.STATION_RANGES)
_NAMES = ("رادیو ایران", "رادیو نما", "رادیو نما - دو", "رادیو نمایش", "x")


@query(f"""select c_custkey, case when {_INSIDE} then case when s::int between {T.VISUAL_RANGE[0]} and {T.VISUAL_RANGE[1]} or regexp_matches(n, 'رادیو\\s*نما(\\s|[-–—]|$)') then 'radio_visual_station' {_STATION} else 'included_default' end end as reason
from (select c_custkey, (c_custkey % 600)::varchar as s, {sql_pick('c_custkey', *_NAMES)} as n from customer)""")
def station_rules(spark, sf_dir):
    """Stations by ranges, exclusions and names."""
    reason = T.station_reason((F.col("c_custkey") % 600).cast("string"), pick("c_custkey", *_NAMES))
    return table(spark, sf_dir, "customer").select("c_custkey", reason.alias("reason"))


@query("select unnest(['7', '-5', 'none']) as c_custkey except select c_custkey::varchar from customer")
def unknown_overrides(spark, sf_dir):
    """Override numbers that no station has."""
    return T.unknown_overrides(table(spark, sf_dir, "customer"), "c_custkey", ["7", "-5", "none", "7"])


@query("""select o_orderkey, case when o_orderpriority <> '1-URGENT' then 'priority' when o_orderstatus = 'P' then 'status' when not o_totalprice > 1000 then 'price' end as reason from orders""")
def provenance(spark, sf_dir):
    """Equalities that must all hold; the first that fails is the reason, and null fails."""
    reason = C.unequal_reason(("priority", F.col("o_orderpriority") == "1-URGENT"), ("status", F.col("o_orderstatus") != "P"), ("price", F.col("o_totalprice") > 1000))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("""with a as (select o_orderkey as k, o_custkey, o_totalprice from orders), b as (select o_orderkey as k, case when o_orderkey % 4 = 0 then o_custkey + 1 else o_custkey end as o_custkey, case when o_orderkey % 6 = 0 then null else o_totalprice end as o_totalprice from orders where o_orderkey % 10 <> 9)
select a.k, case when b.k is null then 'missing' when a.o_custkey <> b.o_custkey then 'o_custkey' when b.o_totalprice is null or abs(a.o_totalprice - b.o_totalprice) > 0.01 then 'o_totalprice' end as reason from a left join b on a.k = b.k""")
def verified_reusable(spark, sf_dir):
    """Recorded facts against found ones: what is missing or the first column that differs; numbers may differ by a tolerance."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice")
    b = a.where("k % 10 <> 9").select("k", F.when(F.col("k") % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(F.col("k") % 6 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return R.facts_agree(a, b, "k", ["o_custkey"], {"o_totalprice": 0.01}).select("k", "reason")


# Identifiers and formats


@query("select conv_id, turn, trim(regexp_replace(replace(role || chr(8204) || ' ' || left(text, 40), chr(8204), ' '), '\\s+', ' ', 'g')) as squeezed from conversations")
def squeeze_joiners(spark, sf_dir):
    """The zero-width non-joiner as a space."""
    text = F.concat("role", F.lit("\u200c "), F.substring("text", 1, 40))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.squeeze_zwnj(text).alias("squeezed"))


_FILES = ("a/S1_16K/x.wav", "noise/cafe/y.tar.gz", "z", "deep/er/S2_16k/sub/n.flac", ".hidden")


@query(f"""select doc_id, case when starts_with(source, 'src') then source else 'src-' || source end as prefixed, case when starts_with(lang, 'x') then lang else 'x-' || lang end as other,
regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^./]*$', '') as stem, regexp_replace(p, '\\.[^./]*$', '') || '.wav' as wav, case when starts_with(p, 'a/') then substr(p, 3) else p end as relative,
lang || '-' || regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^./]*$', '') || '-' || lpad(doc_id::varchar, 6, '0') as item, case when ends_with(source, '.tsv') then source else source || '.tsv' end as file
from (select *, {sql_pick('doc_id', *_FILES)} as p from documents)""")
def path_names(spark, sf_dir):
    """Identifiers and file names from paths."""
    path = pick("doc_id", *_FILES)
    return table(spark, sf_dir, "documents").withColumn("p", path).select(
        "doc_id", T.prefixed_id("src", F.col("source")).alias("prefixed"), T.prefixed_id("x", F.col("lang")).alias("other"), T.stem(F.col("p")).alias("stem"), T.with_suffix(F.col("p"), ".wav").alias("wav"),
        T.relative_to(F.col("p"), "a").alias("relative"), T.item_id(F.col("lang"), F.col("p"), F.col("doc_id")).alias("item"), T.split_name(F.col("source")).alias("file"),
    )


@query(f"select doc_id, {sql_pick('doc_id', 'S1', 'cafe', 'none', 'S2', 'none')} as scene from documents")
def scenes(spark, sf_dir):
    """The folder named as a scene, else the parent."""
    path = pick("doc_id", *_FILES)
    return table(spark, sf_dir, "documents").withColumn("p", path).select("doc_id", F.coalesce(T.scene_of(F.col("p")), F.lit("none")).alias("scene"))


_RATES = ("16k", "128 kbps", "12200", "", "24.5K", "none")


@query("select doc_id, [16000, 128000, 12200, null, 24500, null][doc_id % 6 + 1]::bigint as bits from documents")
def bitrates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.bitrate(pick("doc_id", *_RATES)).alias("bits"))


@query("""select doc_id, ['sha256:' || s, 'md5:' || m, 'sha256:' || s, null, 'md5:' || m, null][doc_id % 6 + 1] as checksum from (select doc_id, sha256(text) as s, md5(text) as m from documents)""")
def checksums(spark, sf_dir):
    """Prefixed and bare digests in one form; what doesn't fit its prefix is null."""
    s, m = F.sha2("text", 256), F.md5("text")
    forms = F.array(F.concat(F.lit("SHA256:"), F.upper(s)), F.concat(F.lit("md5:"), m), s, F.concat(F.lit("md5:"), s), m, F.substring(s, 1, 63))
    return table(spark, sf_dir, "documents").select("doc_id", T.checksum(F.element_at(forms, (F.col("doc_id") % 6 + 1).cast("int"))).alias("checksum"))


@query("""select doc_id, ['bad ' || doc_id, 'plain', 'unknown'][doc_id % 3 + 1] as message from documents""")
def error_messages(spark, sf_dir):
    """A JSON body's error, else its text, else a fallback."""
    forms = F.array(F.concat(F.lit('{"error": "bad '), F.col("doc_id").cast("string"), F.lit('"}')), F.lit(" plain "), F.lit(" "))
    body = F.element_at(forms, (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(body.alias("body"), "doc_id").select("doc_id", T.error_text(F.col("body"), "unknown").alias("message"))


@query("select doc_id, 'https://h.example.org/c/' || url_encode(source || ' /' || lang) || '?page=' || (doc_id % 9) || '&q=' || url_encode('a&b ' || doc_id) as url from documents")
def built_urls(spark, sf_dir):
    """URLs of quoted parts and parameters."""
    url = T.built_url("https://h.example.org/c", [F.concat("source", F.lit(" /"), "lang")], {"page": (F.col("doc_id") % 9).cast("string"), "q": F.concat(F.lit("a&b "), F.col("doc_id").cast("string"))})
    return table(spark, sf_dir, "documents").select("doc_id", url.alias("url"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT') || lpad((o_orderkey % 24)::varchar, 2, '0') || ':05:09+03:30' as iso, (o_orderdate::timestamp + to_hours((o_orderkey % 24)::int) + interval 309 second - interval 210 minute) as utc,
month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) as url_day, strftime(o_orderdate, '%Y%m%d-%H%M%S') as run from orders""")
def mail_dates(spark, sf_dir):
    """Mail dates to ISO with their offset and to UTC; days in URLs; run ids."""
    text = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy "), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":05:09 +0330"))
    rows = table(spark, sf_dir, "orders").withColumn("t", text)
    utc = D.rfc822(F.col("t"))["at"].cast("timestamp_ntz")
    return rows.select("o_orderkey", D.iso_with_offset(F.col("t")).alias("iso"), utc.alias("utc"), D.url_date(F.col("o_orderdate")).alias("url_day"), D.run_id(F.col("o_orderdate")).alias("run"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then (o_custkey % 100)::double when 1 then greatest(0, (o_custkey % 50 - 20) * 60)::double when 2 then null else 0 end as seconds from orders""")
def retry_after(spark, sf_dir):
    """Seconds to wait from a number or a mail date, at least 0; null for other texts."""
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    at = F.date_format(now + F.make_dt_interval(mins=(F.col("o_custkey") % 50 - 20).cast("int")), "EEE, dd MMM yyyy HH:mm:ss")
    forms = F.array((F.col("o_custkey") % 100).cast("string"), F.concat(at, F.lit(" GMT")), F.lit("soon"), F.lit("-7"))
    header = F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").withColumn("h", header).select("o_orderkey", D.retry_after(F.col("h"), now).alias("seconds"))


@query("select doc_id, case when d < 0.5 or (d = 0.5 and w % 2 = 0) then w else w + 1 end / 4.0::double as quarter from (select doc_id, floor(n_chars / 8.0)::bigint as w, n_chars / 8.0 - floor(n_chars / 8.0) as d from documents)")
def half_even(spark, sf_dir):
    """Rounding to whole numbers, halves to the even one, of eighths; in quarters."""
    return table(spark, sf_dir, "documents").select("doc_id", (M.half_even(F.col("n_chars") / 8.0) / 4).alias("quarter"))


# Choices and orders


@query("select c_custkey, c_name from (select *, row_number() over (order by c_custkey desc) as r from customer) where r <= 25")
def numeric_order(spark, sf_dir):
    """The last of numbers that are held as text, by their value."""
    rows = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey").cast("string"))
    return rows.orderBy(F.col("id").try_cast("decimal(38,0)").desc()).limit(25).select(F.col("id").cast("long").alias("c_custkey"), "c_name")


@query("select conv_id, max_by(text, (len(text), -turn)) as longest from conversations group by conv_id")
def longest_text(spark, sf_dir):
    """The longest text of a group; of equally long ones the first."""
    return R.longest(table(spark, sf_dir, "conversations"), ["conv_id"], "text", "turn").withColumnRenamed("text", "longest")


_SEEDED = "sha256('s|0|' || doc_id)"


@query(f"select doc_id, (row_number() over (order by {_SEEDED}, doc_id) - 1)::bigint as position from documents qualify row_number() over (order by {_SEEDED}, doc_id) > 100")
def resumed_order(spark, sf_dir):
    """A permutation by seed and epoch, gone on from its hundredth row."""
    return R.resumable_order(table(spark, sf_dir, "documents"), "doc_id", "s", 0, 100).select("doc_id", "position")


@query(f"select doc_id, ((row_number() over (order by {_SEEDED}, doc_id) - 1) % 7)::int as hand from documents")
def dealt_hands(spark, sf_dir):
    """Rows in seeded order, dealt in turn."""
    return R.dealt(table(spark, sf_dir, "documents"), "doc_id", 7, "s").select("doc_id", "hand")


@query("select doc_id from (select doc_id, row_number() over (order by sha256('p|' || doc_id), doc_id) as r from documents where n_chars > 200) where r <= 30")
def probe_readable(spark, sf_dir):
    """The first thirty readable rows in seeded order."""
    return R.readable_until(table(spark, sf_dir, "documents"), "doc_id", F.col("n_chars") > 200, 30, "p").select("doc_id")


@query(f"select doc_id, p.item_id from (select doc_id, floor({_UNIT.format(key=chr(39) + 'pool|' + chr(39) + ' || doc_id')} * (select count(*) from benchmark))::bigint as at from documents) d join (select item_id, row_number() over (order by item_id) - 1 as at from benchmark) p on d.at = p.at")
def pool_choice(spark, sf_dir):
    """One item of a pool for every row, with replacement."""
    rows = R.pool_choice(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", R.hash_unit("pool", F.col("doc_id")))
    return rows.select("doc_id", "item_id")


@query("select row_number() over (order by item_id)::bigint as source_index, item_id from benchmark")
def numbered_rows(spark, sf_dir):
    """Rows numbered from 1 in their order."""
    return files.numbered(table(spark, sf_dir, "benchmark").orderBy("item_id")).select("source_index", "item_id")


@query("select a.conv_id, a.turn, a.role, len(a.text)::bigint as chars from conversations a")
def zipped_rows(spark, sf_dir):
    """References and hypotheses by their ordinal; both sides are complete."""
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    return R.zipped(rows.select("at", "role"), rows.repartition(3).select("at", F.length("text").alias("n")), "at").select("at.conv_id", "at.turn", "role", long("n", "chars"))


@query("""select doc_id, case when doc_id % 4 = 3 then null else doc_id % 4 end::bigint as choice, case when doc_id % 4 = 3 then 'incomplete' when doc_id % 10 = 0 then 'repeated' else null end as problem from documents""")
def response_choices(spark, sf_dir):
    """Answers by index against requests: each index once, none missing, none unknown."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    requests = docs.select("doc_id", F.lit(0).alias("index"))
    answers = docs.where("doc_id % 4 <> 3").select("doc_id", F.lit(0).alias("index"), (F.col("doc_id") % 4).alias("choice"))
    answers = answers.unionByName(answers.where("doc_id % 10 = 0"))
    return X.choices(requests, answers, "doc_id", "index", "choice")


@query("""select doc_id, case c when 'g711_alaw' then 64000 when 'gsm' then 13000 when 'opus_wb' then 24000 end::int as bits, case c when 'g711_alaw' then 'wav' when 'gsm' then 'gsm' when 'opus_wb' then 'opus' end as extension from (select doc_id, ['g711_alaw', 'gsm', 'opus_wb', 'other'][doc_id % 4 + 1] as c from documents)""")
def codec_dimension(spark, sf_dir):
    dimension = {"g711_alaw": {"bits": 64000, "extension": "wav"}, "gsm": {"bits": 13000, "extension": "gsm"}, "opus_wb": {"bits": 24000, "extension": "opus"}}
    rows = R.lookup(table(spark, sf_dir, "documents"), pick("doc_id", "g711_alaw", "gsm", "opus_wb", "other"), dimension, ["bits", "extension"])
    return rows.select("doc_id", "bits", "extension")


@query("select doc_id, case when u < 0.5 then 'legacy' when u < 0.75 then 'phone' else 'radio' end as profile, case when u < 0.5 then 0.6 when u < 0.75 then 0.9 else 0.6 end::double as noise, case when u >= 0.75 then 3 else 1 end::int as scenes from (select doc_id, " + _UNIT.format(key="'profile|' || doc_id") + " as u from documents)")
def profile_choice(spark, sf_dir):
    """A weighted profile for every row, with its overrides merged over the defaults."""
    defaults = {"noise": {"probability": 0.6, "scenes": 1}, "gain": 3}
    profiles = [{"name": "legacy", "weight": 2}, {"name": "phone", "weight": 1, "noise": {"probability": 0.9}}, {"name": "radio", "weight": 1, "noise": {"scenes": 3}}]
    rows = R.choose_profile(table(spark, sf_dir, "documents"), R.hash_unit("profile", F.col("doc_id")), defaults, profiles)
    return rows.select("doc_id", "profile", F.get_json_object("settings", "$.noise.probability").cast("double").alias("noise"), F.get_json_object("settings", "$.noise.scenes").cast("int").alias("scenes"))


# Aggregates and ledgers


@query("select event_type, count(*)::bigint as rows from events group by event_type")
def common_values(spark, sf_dir):
    return M.common(table(spark, sf_dir, "events"), "event_type")


@query("select event_type, round(case when sum(value) > 0 then count(*) / sum(value) end, 6) as rate from events group by event_type")
def throughput(spark, sf_dir):
    rows = M.throughput(table(spark, sf_dir, "events").withColumn("one", F.lit(1)), "one", "value", "event_type")
    return rows.select("event_type", rounded("rate", "rate"))


@query("""select printf('%X-%X', (sum(('0x' || substr(h, 1, 12))::hugeint) % 281474976710656)::bigint, (sum(('0x' || substr(h, 13, 12))::hugeint) % 281474976710656)::bigint) as fingerprint from (select sha256(doc_id || '|' || text) as h from documents)""")
def table_fingerprint(spark, sf_dir):
    """One digest of a table, whatever its order."""
    return R.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""select doc_id, sha256('{"chars":' || n_chars || ',"lang":"' || lang || '","source":"' || source || '"}') as digest from documents where source is not null""")
def canonical_digests(spark, sf_dir):
    """SHA-256 of each row as JSON with sorted names and without spaces."""
    rows = table(spark, sf_dir, "documents").where("source is not null").withColumn("chars", F.col("n_chars"))
    return rows.select("doc_id", R.canonical_digest("source", "lang", "chars").alias("digest"))


@query("""select doc_id, case when doc_id % 3 = 0 then 'refused' else null end as problem from documents""")
def digest_gates(spark, sf_dir):
    """Stored results of another configuration are refused unless forced."""
    stored_ = F.when(F.col("doc_id") % 6 == 1, F.lit(None)).when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.lit("new"))
    return table(spark, sf_dir, "documents").select("doc_id", R.gate_problem(stored_, F.lit("new"), F.lit(False)).alias("problem"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 's' || o_custkey when o_orderkey % 3 = 1 then 'm' || o_custkey end as expected from orders""")
def expected_checksum(spark, sf_dir):
    """The state's checksum where its path is the row's, else the manifest's where its path is, else none."""
    key, name = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").withColumn("path", name).select(
        "o_orderkey", R.expected_checksum(F.col("path"), F.when(key % 3 == 0, name).otherwise("other"), F.concat(F.lit("s"), name), F.when(key % 3 <= 1, name), F.concat(F.lit("m"), name)).alias("expected")
    )


@query("""select user_id, day, not bool_or(event_type = 'error') as done from (select user_id, ts::date as day, event_type from events) group by user_id, day""")
def day_checkpoints(spark, sf_dir):
    """Days may be checked off only if no entry of theirs failed."""
    return R.checkpoints(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], F.col("event_type") == "error")


@query("""select o_custkey, o_orderkey from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'O' and o_totalprice > 200000)""")
def undiscovered(spark, sf_dir):
    """Work whose key is not discovered yet; failed keys are tried again."""
    orders = table(spark, sf_dir, "orders")
    state = orders.select("o_custkey", F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), "discovered").otherwise("failed").alias("status"))
    return R.undiscovered(orders, state, "o_custkey", "status", "discovered").select("o_custkey", "o_orderkey")


@query("""select conv_id, turn, case when turn % 4 = 2 then null else 'ok ' || left(text, 12) end as transcript, case when turn % 4 = 2 then 'inference_failed: no ' || turn end as error from conversations""")
def batch_fallback(spark, sf_dir):
    """A model whose batches fail with one of their rows: the others are tried again by themselves."""

    def make():
        def model(paths):
            if bad := [p for p in paths if p.startswith("!")]:
                raise ValueError(f"no {bad[0][1:]}")
            return [f"ok {p}" for p in paths]

        return model

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 2, F.concat(F.lit("!"), F.col("turn").cast("string"))).otherwise(F.substring("text", 1, 12)).alias("path"))
    return X.transcribe(rows, "path", make).select("conv_id", "turn", "transcript", "error")


@query("""select doc_id, case when p.digest is null then 'missing' when p.digest <> sha256(text) then 'changed' end as problem from documents left join (select doc_id as id, case when doc_id % 5 = 0 then 'old' else sha256(text) end as digest from documents where lang <> 'de') p on doc_id = p.id
where p.digest is null or p.digest <> sha256(text)""")
def digest_mismatches(spark, sf_dir):
    """Files whose digest is not the recorded one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "lang")
    recorded = docs.where("lang <> 'de'").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    return R.digest_mismatches(docs.select("doc_id", "digest"), recorded, "doc_id", "digest")


@query("""select 'content' as kind, count(*)::bigint as files from pages where page_id % 3 <> 0 union all select 'metadata', count(*) from pages where page_id % 3 = 0""")
def tree_listing(spark, sf_dir):
    """Files below a root as content and metadata, by their first folder."""
    path = F.concat(F.lit("root/"), F.when(F.col("page_id") % 3 == 0, "").otherwise("clips/"), F.col("page_id").cast("string"), F.lit(".x"))
    return files.split_listing(table(spark, sf_dir, "pages").select(path.alias("path")), "root", "clips").groupBy("kind").agg(F.count("*").alias("files"))
