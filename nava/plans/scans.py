"""Catalogue, third part: sources and sinks by writing the driver's tables and reading them back, pages, feeds, and whole preparations."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from nava.functions import html as H
from nava.functions import text as T
from nava.plans import pipelines as P
from nava.plans.catalogue import _PLAIN, _STRIP, _UNIT, _latin
from nava.plans.registry import long, pick, query, rounded, sql_pick
from nava.session import shared_folder, table
from nava.sources import files, sinks
from nava.streaming import incremental as Inc

_SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Files: written by the sinks, read by the scans


@query(f"select doc_id::varchar as path, {_SQUEEZED} as sentence, coalesce(lang, '') as lang from documents")
def scan_delimited(spark, sf_dir):
    """Tab-separated text with a header and extra columns, all as strings."""
    at = _folder(spark, "scan-tsv")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), T.squeeze(F.col("text")).alias("sentence"), "lang")
    sinks.split_file(rows, at, "path", columns=("path", "sentence", "lang"))
    return files.delimited(spark, at)


@query(f"select {_SQUEEZED} as sentence, doc_id::varchar as path from documents where lang = 'en'")
def scan_two_columns(spark, sf_dir):
    """Two columns of a comma-separated table with quoted texts."""
    at = _folder(spark, "scan-csv")
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("path"), "lang", T.squeeze(F.col("text")).alias("sentence"))
    rows.write.option("header", True).option("escape", '"').csv(at)
    return files.delimited(spark, at, sep=",", columns=["sentence", "path"])


@query(f"select item_id || '.mp3' as file_name, {_SQUEEZED} as sentence from benchmark")
def scan_overflow(spark, sf_dir):
    """Two columns without quotes, whose text may hold the separator; names get their suffix."""
    at = _folder(spark, "scan-overflow")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("nested/"), F.col("item_id").cast("string"), F.lit(","), T.squeeze(F.col("text"))).alias("value"))
    # A small table: one file, whose first line is the header.
    spark.createDataFrame([("file_name,sentence",)], "value string").unionByName(rows).coalesce(1).write.text(at)
    return files.overflowing(spark, at, ",")


@query("select doc_id, text, lang from documents")
def scan_json(spark, sf_dir):
    """Strict JSON lines, from the sink with sorted names."""
    at = _folder(spark, "scan-json")
    sinks.json_lines(table(spark, sf_dir, "documents").select("text", "lang", "doc_id"), at, "doc_id")
    return files.json_lines(spark, at, "doc_id long, text string, lang string")


@query("select doc_id, text from documents where doc_id % 10 <> 0 and doc_id % 10 <> 3")
def scan_json_lenient(spark, sf_dir):
    """JSON lines of which some are broken or no objects, and blank ones between."""
    at = _folder(spark, "scan-lenient")
    whole = F.to_json(F.struct("doc_id", "text"))
    line = F.when(F.col("doc_id") % 10 == 0, F.concat(whole, F.lit("}{"))).when(F.col("doc_id") % 10 == 3, "[1]").otherwise(F.concat(whole, F.lit("\n  ")))
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(at)
    return files.json_lines(spark, at, "doc_id long, text string", strict=False)


@query("select doc_id, coalesce(lang, 'none') as lang, 'train' as split from documents where doc_id % 4 = 0")
def scan_mapping(spark, sf_dir):
    """A mapping with a split filter; fields that a line lacks have their default, lines without a split are of the default one."""
    at = _folder(spark, "scan-mapping")
    split = F.when(F.col("doc_id") % 4 == 1, "dev").when(F.col("doc_id") % 8 == 0, "train").when(F.col("doc_id") % 4 == 2, "test").when(F.col("doc_id") % 4 == 3, "dev")
    table(spark, sf_dir, "documents").select("doc_id", "lang", split.alias("split")).write.json(at)
    return files.mapping(spark, at, "doc_id long, lang string, split string", {"lang": "none", "split": "train"}, "train").select("doc_id", "lang", "split")


@query(f"select doc_id || '.wav' as path, {_SQUEEZED} as sentence from documents")
def scan_pattern(spark, sf_dir):
    """Lines of a quoted name and a quoted text."""
    at = _folder(spark, "scan-pattern")
    line = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('.wav" "'), T.squeeze(F.col("text")), F.lit('"'))
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(at)
    return files.pattern_lines(spark, at)


_SHARDS = ("data/part_10.tar", "data/part_2.tar", "part.tar", "x_3/y", "z_007")


@query("select doc_id, [10, 2, null, null, 7][doc_id % 5 + 1]::int as shard from documents")
def natural_order(spark, sf_dir):
    """Numbers at the end of shard names."""
    return table(spark, sf_dir, "documents").select("doc_id", files.shard_number(pick("doc_id", *_SHARDS)).alias("shard"))


@query("""with f as (select 'x/' || (doc_id // 3) || ['.wav', '.mp3', ''][doc_id % 3 + 1] as path, doc_id from documents) select regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^./]*$', '') as stem, min(path) as path from f group by 1""")
def stem_index(spark, sf_dir):
    """Files by stem; of equal stems the first path."""
    path = F.concat(F.lit("x/"), F.floor(F.col("doc_id") / 3).cast("string"), pick("doc_id", ".wav", ".mp3", ""))
    return files.stems(table(spark, sf_dir, "documents").select(path.alias("path")))


@query("""select doc_id, case when doc_id % 4 = 0 then 'audio/' || doc_id || '.wav' when doc_id % 4 = 1 then 'audio/' || doc_id || '.flac' end as found from documents""")
def resolved_paths(spark, sf_dir):
    """Transcripts' files by name, else by stem, else none."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    have = docs.where("doc_id % 4 <= 1").select(F.concat(F.lit("audio/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".wav").otherwise(".flac")).alias("path"))
    return files.resolve_paths(docs.withColumn("path", F.concat(F.lit("my/"), F.col("doc_id").cast("string"), F.lit(".wav"))), have, "path").select("doc_id", "found")


@query("select doc_id, n_chars, case when n_chars > 2000 then 'too_long' end as reason from documents")
def split_outputs(spark, sf_dir):
    """A ledger's accepted and rejected rows as two outputs, read back."""
    one, two = _folder(spark, "accepted"), _folder(spark, "rejected")
    ledger = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(F.col("n_chars") > 2000, "too_long").alias("reason"))
    sinks.accepted_and_rejected(ledger, "reason", one, two)
    kept = spark.read.schema("doc_id long, n_chars long").parquet(one).withColumn("reason", F.lit(None).cast("string"))
    return kept.unionByName(spark.read.schema("doc_id long, n_chars long, reason string").parquet(two))


@query("select doc_id, lang from documents where lang = 'en' union all select doc_id, lang from documents where lang <> 'en'")
def appended_lines(spark, sf_dir):
    """JSON lines, appended twice."""
    at = _folder(spark, "append")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sinks.append_json(docs.where("lang = 'en'"), at)
    sinks.append_json(docs.where("lang <> 'en'"), at)
    return files.json_lines(spark, at, "doc_id long, lang string")


@query("select count(*)::bigint as documents, 'done' as status, 'x' as kept from documents")
def status_document(spark, sf_dir):
    """A small JSON document, written, read and changed in two fields."""
    at = f"{_folder(spark, 'status')}.json"
    sinks.document(spark, {"status": "begun", "kept": "x"}, at)
    value = sinks.update_document(spark, at, status="done", documents=table(spark, sf_dir, "documents").count())
    return spark.createDataFrame([(value["documents"], value["status"], value["kept"])], "documents long, status string, kept string")


@query("select doc_id, lang from documents where doc_id % 2 = 0")
def staged_replace(spark, sf_dir):
    """A table is replaced by what passes its guard, and kept where the guard refuses what was written."""
    at = _folder(spark, "replaced")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    write = lambda df, path: df.write.parquet(path)
    sinks.replace(docs, at, write)
    sinks.replace(docs.where("doc_id % 2 = 0"), at, write, guard=lambda df: not df.isEmpty())
    try:
        sinks.replace(docs.where("doc_id < 0"), at, write, guard=lambda df: not df.isEmpty())
    except ValueError:
        pass
    return spark.read.schema(docs.schema).parquet(at)


# Pages and feeds


def _page():
    """A book's page, made of a document's facts."""
    return F.concat(
        F.lit("<html><h1> Book "), F.col("doc_id").cast("string"), F.lit("</h1><meta content='about &amp; more' property='og:description'><dl><dt>Author:</dt><dd><a href=1>"), F.col("lang"), F.lit("</a>, <a href=2>"),
        F.col("source"), F.lit("</a></dd><dt>Kind :</dt><dd> one, two ،one</dd></dl><ul><li><a href='/s"), F.col("doc_id").cast("string"), F.lit("'>Sample 2:46</a></li><li><a href='/f'>Full 259:49</a></li><li>no length</li></ul>"),
        F.lit("<a href='v.mp4'>mp4 9 MB</a><a href='a"), F.col("doc_id").cast("string"), F.lit(".mp3'>MP3 <b>10.5 MB</b></a>"),
        F.lit("<audio data-sources='[{&quot;src&quot;:&quot;x.mp3&quot;,&quot;label&quot;:&quot;64k&quot;}]'></audio><audio src=\"y"), F.col("doc_id").cast("string"), F.lit(".mp3\"></audio></html>"),
    )


@query("select doc_id, list_sort(list_distinct([lang, source])) as authors, ['one', 'two'] as kinds from (select doc_id, lang, source from documents where source is not null)")
def labelled_fields(spark, sf_dir):
    """Values of labelled fields: anchors, else texts between commas; each once."""
    rows = table(spark, sf_dir, "documents").where("source is not null").withColumn("page", _page())
    return rows.select("doc_id", F.array_sort(H.field_values(F.col("page"), "Author")).alias("authors"), H.field_values(F.col("page"), "Kind").alias("kinds"))


@query("select doc_id, 'Book ' || doc_id as title, 'about & more' as description, 2::bigint as tracks, '/s' || doc_id as first_url, '2:46' as first_length, true as first_sample, true as second_full from documents where source is not null")
def book_pages(spark, sf_dir):
    """A book's title, description and tracks; items without a length are none."""
    rows = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", H.book_page(_page()).alias("b"))
    first, second = F.element_at("b.tracks", 1), F.element_at("b.tracks", 2)
    return rows.select("doc_id", "b.title", "b.description", long(F.size("b.tracks"), "tracks"), first["url"].alias("first_url"), first["length"].alias("first_length"), first["is_sample"].alias("first_sample"), second["is_full"].alias("second_full"))


@query("select doc_id, 'a' || doc_id || '.mp3' as url, '10.5 MB' as size from documents where source is not null")
def download_links(spark, sf_dir):
    """The first link whose label names the format, with its size."""
    rows = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", H.download_link(_page()).alias("d"))
    return rows.select("doc_id", "d.url", "d.size")


@query("select doc_id, unnest(['x.mp3', 'y' || doc_id || '.mp3']) as src, unnest(['64k', null]) as label from documents where source is not null")
def audio_sources(spark, sf_dir):
    """Sources of audio elements, from JSON with entities or plain attributes."""
    rows = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.explode(H.audio_candidates(_page())).alias("a"))
    return rows.select("doc_id", "a.src", "a.label")


@query("select page_id, (len(html) - len(replace(html, '<li>', '')))::bigint // 4 as blocks from pages")
def marked_blocks(spark, sf_dir):
    """What follows each match of a marker."""
    return table(spark, sf_dir, "pages").select("page_id", long(F.size(H.blocks_after(F.col("html"), "<li>")), "blocks"))


@query("""select lang as url, (k - 1)::int as position, 'T ' || doc_id as title, 'https://x/' || doc_id as link, case when doc_id % 2 = 0 then 'g' || doc_id else 'https://x/' || doc_id end as guid, 'Tue, 14 Jul 2026 19:00:00 +0330' as published, 'e' || doc_id || '.mp3' as enclosure
from (select *, row_number() over (partition by lang order by doc_id) as k from documents where lang is not null and doc_id < 60) qualify row_number() over (partition by lang order by doc_id) <= 5""")
def feed_items(spark, sf_dir):
    """Items of feeds in order, at most five of each."""
    key = F.col("doc_id").cast("string")
    item = F.concat(
        F.lit("<item><title><![CDATA[T "), key, F.lit("]]></title><link>https://x/"), key, F.lit("</link>"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<guid>g"), key, F.lit("</guid>"))).otherwise(""),
        F.lit("<pubDate>Tue, 14 Jul 2026 19:00:00 +0330</pubDate><enclosure url='e"), key, F.lit(".mp3'/></item>"),
    )
    rows = table(spark, sf_dir, "documents").where("lang is not null and doc_id < 60").groupBy(F.col("lang").alias("url")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("items"))
    feeds = rows.select("url", F.concat(F.lit("<rss><channel><title>c</title>"), F.array_join("items.item", "\n"), F.lit("</channel></rss>")).alias("payload"))
    return files.feed_items(feeds, "url", "payload", 5)


# Preparations


@query(f"""with t as (select doc_id from labels where toxic = 1), d as (select doc_id from labels where quality = 0),
r as (select case when doc_id in (select doc_id from t) then 'test' when doc_id in (select doc_id from d) then 'dev' else 'train' end as split, doc_id::varchar as path, {_latin('text')} as n, {_PLAIN.format(t='text')} as plain from documents)
select split, path, coalesce(n, case when split = 'test' then plain end) as sentence from r where n is not null or split = 'test'""")
def prepared_splits(spark, sf_dir):
    """Leakage-free splits of normalized sentences; only test keeps rejected rows, as plain text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("sentence"))
    labels = table(spark, sf_dir, "labels")
    part = lambda condition: docs.join(labels.where(condition).select("doc_id").distinct(), "doc_id", "left_semi").drop("doc_id")
    return P.corpus_splits(docs.drop("doc_id"), part("quality = 0"), part("toxic = 1"), T.normalize_latin).rows


@query(f"""select case lang when 'en' then 'train' when 'de' then 'dev' else 'test' end as split, regexp_replace(regexp_extract(source || '/' || doc_id || '.flac', '([^/]*)$', 1), '\\.[^./]*$', '') || '.wav' as path,
coalesce({_latin('text')}, case when lang not in ('en', 'de') then {_PLAIN.format(t='text')} end) as sentence from documents where lang is not null and source is not null and ({_latin('text')} is not null or lang not in ('en', 'de'))""")
def prepared_records(spark, sf_dir):
    """Records of named splits: splits renamed, names as .wav, sentences normalized."""
    docs = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    rows = docs.select(F.col("lang").alias("split"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".flac")).alias("audio_path"), F.col("text").alias("transcription"))
    names = {lang: {"en": "train", "de": "dev"}.get(lang, "test") for lang in [r[0] for r in docs.select("lang").distinct().collect()]}
    return P.renamed_splits(rows, names, T.normalize_latin).rows


@query(f"select doc_id || '.mp3' as file_name, {_latin('text')} as sentence, 'nested/' || doc_id || '.mp3' as member from documents where {_latin('text')} is not null and doc_id % 5 <> 0")
def prepared_archive(spark, sf_dir):
    """Sentences with the archive member of their name; names that no archive holds are left out."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".mp3"))
    members = docs.where("doc_id % 5 <> 0").select(F.concat(F.lit("nested/"), name).alias("member"))
    return P.archive_corpus(docs.select(name.alias("file_name"), F.col("text").alias("sentence")), members, T.normalize_latin)[0]


@query("""with f as (select doc_id, 'noise/' || source || '_16K/' || doc_id || '.wav' as path, source from documents where source is not null and doc_id % 4 <> 0)
select trim(regexp_replace(path, '[^A-Za-z0-9._-]+', '-', 'g'), '-._')[1:96] || '-' || substring(sha256(path), 1, 10) as id, source as scene, path from f""")
def noise_assets(spark, sf_dir):
    """Readable noise files with their scene and a stable id."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    path = F.concat(F.lit("noise/"), F.col("source"), F.lit("_16K/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    rows = docs.select(path.alias("path"), F.when(F.col("doc_id") % 4 == 0, "invalid_audio").alias("error"))
    return P.noise_index(rows.select("path"), rows)


_COMPLETE = "g as (select o_custkey as source_id, sum(l_quantity) as total, count(*)::bigint as rows, bool_and(l_returnflag <> 'R' or l_linenumber > 1) as complete from lineitem join orders on l_orderkey = o_orderkey group by o_custkey)"


@query(f"""with {_COMPLETE}, c as (select * from g where complete), r as (select *, sum(total) over (order by sha256('7' || chr(0) || source_id), source_id) as running from c)
select source_id, total as seconds, rows as segments from r where running - total < 7200 and not (running >= 7200 and running - total > 0 and 7200 - (running - total) <= running - 7200)""")
def selected_hours(spark, sf_dir):
    """Complete groups in seeded order that come closest to two hours."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source_id")), "l_orderkey")
    lines = lines.withColumn("id", F.concat_ws("-", *[F.col(c).cast("string") for c in lines.columns]))
    segments = lines.select("id", "source_id", F.col("l_quantity").cast("double").alias("duration_sec"))
    return P.selection(segments, lines.where("l_returnflag <> 'R' or l_linenumber > 1").select("id"), 2.0, "7")


@query("""select station, day from (select c_custkey::varchar as station, unnest(generate_series(date '2024-01-01', date '2024-01-05', interval 1 day))::date as day from customer where c_mktsegment = 'BUILDING') s
where not exists (select 1 from events where user_id::varchar = station and ts::date = day)""")
def days_to_read(spark, sf_dir):
    """Days of included stations that no checkpoint has."""
    stations = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("station"), (F.col("c_mktsegment") == "BUILDING").alias("included"))
    done = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("station"), F.to_date("ts").alias("day")).distinct()
    return P.radio_days(stations, "2024-01-01", "2024-01-05", done)


_TITLES = ("گفتگو", "موسیقی شب", "تلاوت", "آگهی", "میان برنامه", "به زبان عربی", "خبر")
_REASONS = ("broad_speech_default", "explicit_music", "explicit_recitation", "advertisement_or_promo", "station_filler", "non_persian", "broad_speech_default")


@query(f"""select event_id, {sql_pick('event_id', *_REASONS)} as reason, event_id % 7 in (0, 6) as eligible from events where date_trunc('minute', ts) + to_minutes((user_id % 90)::int) <= timestamp '2024-01-15 00:00:00'""")
def episode_classes(spark, sf_dir):
    """Completed entries with the class of their title and program."""
    events = table(spark, sf_dir, "events")
    rows = events.select("event_id", F.col("user_id").alias("station"), F.to_date("ts").alias("day"), F.date_format("ts", "H:mm").alias("start_time"), (F.col("user_id") % 90).alias("minutes"), pick("event_id", *_TITLES).alias("title"), F.lit(1).alias("program_id"), F.lit(None).cast("string").alias("error"))
    programs = events.sparkSession.createDataFrame([(1, "برنامه")], "program_id int, title string")
    return P.radio_episodes(rows, programs, F.lit("2024-01-15 00:00:00").cast("timestamp"))[0].select("event_id", "reason", "eligible")


@query("""with t as (select *, l_returnflag = 'R' as full_ from lineitem), p as (select *, bool_or(full_) over (partition by l_orderkey) as any_full, row_number() over (partition by l_orderkey, full_ order by l_linenumber, l_partkey) as r from t),
k as (select l_orderkey, l_linenumber, l_partkey, l_quantity from p where ((full_ and r = 1) or (not any_full and l_linestatus <> 'O')) and l_partkey % 9 <> 0),
s as (select *, sum(l_quantity) over (order by l_orderkey, l_linenumber, l_partkey, l_quantity) as running from k) select l_orderkey as book_id, l_linenumber::bigint as line, running::double as running from s where running <= 5000""")
def downloads(spark, sf_dir):
    """Per book the first full track, else all that are no samples, without those that are there, up to a number of bytes."""
    lines = table(spark, sf_dir, "lineitem")
    url = F.col("l_partkey").cast("string")
    tracks = lines.select(F.col("l_orderkey").alias("book_id"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q")).alias("track"), url.alias("url"), (F.col("l_returnflag") == "R").alias("is_full"), (F.col("l_linestatus") == "O").alias("is_sample"), F.col("l_quantity").alias("bytes"))
    have = lines.where("l_partkey % 9 = 0").select(url.alias("url"), F.lit(1).alias("length")).distinct()
    return P.download_plan(tracks, have, 5000).select("book_id", long("track.line", "line"), F.col("running").cast("double").alias("running"))


@query("""select doc_id // 3 as page, max_by('u' || doc_id, (coalesce([64000, 128000, null][doc_id % 3 + 1], 0), 'u' || doc_id)) as url from documents where doc_id % 5 <> 0 group by 1""")
def best_sources(spark, sf_dir):
    """Per page the candidate of the highest bitrate whose provenance holds."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.floor(F.col("doc_id") / 3).alias("page"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), pick("doc_id", "64k", "128 kbps", "none").alias("label"),
        F.when(F.col("doc_id") % 5 == 0, "other").otherwise("VOA").alias("entity"), F.lit("no").alias("copied"), F.lit("VOA Persian").alias("language_service"), F.lit("audio").alias("content_type"),
    )
    return P.best_audio(rows)


@query("""select category, 'l?g=' || id as link, id from (select distinct category, id from (select 'c' || (doc_id % 3) as category, doc_id // 10 as number, (doc_id % 17)::varchar as id, doc_id from documents where doc_id < 60) )""")
def category_links(spark, sf_dir):
    """Links of listing pages in order, each once, up to the first page that is empty or repeats another."""
    docs = table(spark, sf_dir, "documents").where("doc_id < 60")
    link = F.concat(F.lit("<a href='l?g="), (F.col("doc_id") % 17).cast("string"), F.lit("'>x</a>"))
    pages = docs.groupBy(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("category"), F.floor(F.col("doc_id") / 10).alias("number")).agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("html"))
    # Behind the last page stand the first page's links again, and behind them others that no longer count.
    again = pages.where("number = 0").withColumn("number", F.lit(100).cast("long"))
    beyond = pages.where("number = 1").select("category", F.lit(101).cast("long").alias("number"), F.lit("<a href='l?g=999'>x</a>").alias("html"))
    return P.catalogue_links(pages.unionByName(again).unionByName(beyond), "category", "number", "html")


@query(f"""with m as (select doc_id, source, case when n_chars < 100 then 'short' when n_chars > 4000 then 'long' end as reason from documents)
select doc_id, reason, case when reason is null then case when u < 0.8 then 'train' when u < 0.9 then 'dev' else 'test' end end as split from (select *, {_UNIT.format(key="'r|' || coalesce(source, 'none')")} as u from m)""")
def released_splits(spark, sf_dir):
    """Rows that pass the gates by group in splits, and the others with their reason."""
    docs = table(spark, sf_dir, "documents")
    kept, refused = P.release_splits(docs, F.coalesce("source", F.lit("none")), "r", {"train": 0.8, "dev": 0.9 - 0.8, "test": 0.1}, [("short", F.col("n_chars") < 100), ("long", F.col("n_chars") > 4000)])
    return kept.select("doc_id", F.lit(None).cast("string").alias("reason"), "split").unionByName(refused.select("doc_id", "reason", F.lit(None).cast("string").alias("split")))


@query("""select 'segments' as kind, boundary as name, count(*)::bigint as rows from (select ['silence', 'hard_cut', 'source_end'][doc_id % 3 + 1] as boundary from documents) group by 2
union all select 'rejections', reason, count(*) from (select case when n_chars < 100 then 'short' else 'long' end as reason from documents where n_chars < 100 or n_chars > 4000) group by 2 union all select 'sources', 'all', count(distinct source) from documents""")
def overview(spark, sf_dir):
    """Counts of boundaries, rejections and sources of a set of artifacts."""
    docs = table(spark, sf_dir, "documents")
    segments = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.lit("p").alias("path"), pick("doc_id", "silence", "hard_cut", "source_end").alias("boundary_type"))
    rejected = docs.where("n_chars < 100 or n_chars > 4000").select(F.when(F.col("n_chars") < 100, "short").otherwise("long").alias("reason"))
    parts = P.artifact_overview(segments, docs.select(F.col("doc_id").alias("id")), rejected, "1")
    return (
        parts["boundaries"].select(F.lit("segments").alias("kind"), F.col("boundary_type").alias("name"), "rows")
        .unionByName(parts["rejections"].select(F.lit("rejections").alias("kind"), F.col("reason").alias("name"), "rows"))
        .unionByName(parts["sources"].select(F.lit("sources").alias("kind"), F.lit("all").alias("name"), F.col("sources").alias("rows")))
    )


@query("""select conv_id, turn, text, coalesce(list(text) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding), []) as preceding from conversations""")
def streamed_context(spark, sf_dir):
    """The last three texts of each conversation as state of a stream, in micro-batches of one file each."""
    at = _folder(spark, "turns")
    rows = table(spark, sf_dir, "conversations").withColumn("late", F.col("turn") >= 3)
    ordered = ["conv_id", "turn"]
    for late in (False, True):  # the second file of a conversation comes later
        rows.where(F.col("late") == late).drop("late").repartition(1).sortWithinPartitions(*ordered).write.mode("append").parquet(f"{at}/in")
    schema = table(spark, sf_dir, "conversations").schema
    texts = Inc.stream_of(spark, f"{at}/in", schema, 1).select("conv_id", F.to_json(F.struct("turn", "text")).alias("text"))
    Inc.run_available(Inc.recent_texts(texts, "conv_id", "text", 3), f"{at}/checkpoint", path=f"{at}/out")
    found = spark.read.schema("conv_id long, text string, preceding array<string>").parquet(f"{at}/out")
    turn = lambda c: F.get_json_object(c, "$.turn").cast("long")
    text = lambda c: F.get_json_object(c, "$.text")
    return found.select("conv_id", turn(F.col("text")).alias("turn"), text(F.col("text")).alias("text"), F.transform("preceding", text).alias("preceding"))


@query("""select doc_id, case when doc_id % 2 = 0 then 'Heading ' || doc_id else 'entry ' || lang end as title, (doc_id % 50)::varchar as program_id, 'http://h/Program/?a=1&m=' || (doc_id % 50) as program_url, 'http://h/' || doc_id || '.mp3' as mp3_url,
case when doc_id % 3 = 0 then 'longer words & ' || source else 'short' end as description, 'گوینده: ' || lang || ' | مجری: xy' as people from documents where source is not null""")
def archive_pages(spark, sf_dir):
    """An episode's heading, program, audio, longest description and people."""
    key = F.col("doc_id").cast("string")
    page = F.concat(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<h1 itemprop='name'> Heading <i>"), key, F.lit("</i></h1>"))).otherwise("<h1>no name</h1>"),
        F.lit("<a href='http://h/Program/?a=1&amp;m="), (F.col("doc_id") % 50).cast("string"), F.lit("'>p</a><a href='x.ogg'>ogg</a><a href='http://h/"), key, F.lit(".mp3'>MP3</a><p itemprop='description'>short</p>"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<p class=a itemprop="description">longer <b>words</b> &amp; '), F.col("source"), F.lit("</p>"))).otherwise(""),
        F.lit("<li>گوینده : "), F.col("lang"), F.lit("</li><li>گوینده: "), F.col("lang"), F.lit("</li><li><b>مجری</b> xy</li>"),
    )
    rows = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", H.archive_page(page, F.concat(F.lit("entry "), "lang")).alias("p"))
    return rows.select("doc_id", "p.*")


@query(f"select page_id, {_STRIP.format(x='''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')} as title, '' as description from pages")
def program_pages(spark, sf_dir):
    """A program's title and description; these pages have no named heading and no description."""
    return table(spark, sf_dir, "pages").select("page_id", H.program_page(F.col("html")).alias("p")).select("page_id", "p.title", "p.description")


@query(f"""with r as (select doc_id, {_latin('text')} as n, {_PLAIN.format(t='text')} as plain from documents) select 'audio/' || doc_id || case when doc_id % 2 = 0 then '.wav' else '.flac' end as path, coalesce(n, plain) as sentence from r where doc_id % 5 <> 0 and coalesce(n, plain) <> ''""")
def evaluation_sets(spark, sf_dir):
    """Transcripts with their audio by name, else by stem; rejected sentences as plain text."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    listing = docs.where("doc_id % 5 <> 0").select(F.concat(F.lit("audio/"), key, F.when(F.col("doc_id") % 2 == 0, ".wav").otherwise(".flac")).alias("path"))
    return P.evaluation_set(docs.select(F.concat(key, F.lit(".wav")).alias("path"), F.col("text").alias("sentence")), listing, T.normalize_latin).rows


@query("select n, path, kind from (values (0, 'a', 'degraded'), (1, 'b', 'clean'), (2, 'c', 'other'), (3, 'd', 'degraded')) t(n, path, kind)")
def dataset_lists(spark, sf_dir):
    """Entries of a configuration's dataset list: kinds given, or found in the folders."""
    from nava.sources import configs

    at = _folder(spark, "datasets")
    for name in ("a/degraded_to_clean.jsonl", "b/dev.tsv", "d/train.tsv", "d/degraded_to_clean.jsonl"):
        sinks.document(spark, {}, f"{at}/{name}")
    sinks.document(spark, {"datasets": [f"{at}/a", f" {at}/b ", {"path": f"{at}/c", "kind": " other "}, {"path": f"{at}/d"}]}, f"{at}/config.json")
    found = configs.datasets(spark, configs.load(spark, f"{at}/config.json", {"batch": 8}))
    return spark.createDataFrame([(n, path.rsplit("/", 1)[1], kind) for n, (path, kind) in enumerate(found)], "n int, path string, kind string")


def _written(rows, folder: str) -> None:
    """Names and contents as files below a folder, by the tasks."""

    def write(name: str, content: bytes) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(content)

    sinks.each_file(rows, "name", "content", write)


@query("select 'nested/' || doc_id || '.txt' as member, strlen(text)::bigint as bytes, sha256(text) as digest from documents")
def archive_scan(spark, sf_dir):
    """Members of tar and zip archives, read as streams, those of one ending."""
    at = _folder(spark, "archives")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(8)).alias("part"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        part, out = int(rows["part"].iloc[0]), io.BytesIO()
        items = [(f"nested/{i}.txt", t.encode()) for i, t in zip(rows["doc_id"], rows["text"])] + [("nested/more.json", b"{}")]
        if part % 2:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                for name, data in items:
                    book.writestr(name, data)
        else:
            with tarfile.open(fileobj=out, mode="w:gz" if part % 4 else "w") as tar:
                for name, data in items:
                    member = tarfile.TarInfo(name)
                    member.size = len(data)
                    tar.addfile(member, io.BytesIO(data))
        return pd.DataFrame({"name": [f"a{part}.bin"], "content": [out.getvalue()]})

    _written(docs.where("text is not null").groupBy("part").applyInPandas(packed, "name string, content binary"), at)
    found = files.archive_members(spark, at, r"\.txt$")
    return found.select("member", long(F.octet_length("content"), "bytes"), F.sha2("content", 256).alias("digest"))


@query("select 'b' || item_id || '.xlsx' as book, 0::bigint as row, ['audio', '', 'text'] as cells from benchmark union all select 'b' || item_id || '.xlsx', 1, ['myaudio/' || item_id || '.wav', '', trim(regexp_replace(text, '\\s+', ' ', 'g'))] from benchmark")
def workbook_scan(spark, sf_dir):
    """First sheets of workbooks: shared and inline strings at their columns, blank rows left out."""
    at = _folder(spark, "books")
    items = table(spark, sf_dir, "benchmark").select("item_id", T.squeeze(F.col("text")).alias("text"))

    def made(parts):
        space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        for part in parts:
            names, contents = [], []
            for i, text in zip(part["item_id"], part["text"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as book:
                    book.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>audio</t></si><si><r><t>te</t></r><r><t>xt</t></r></si></sst>")
                    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"/>'
                    body = f'<row r="3"><c r="A3" t="inlineStr"><is><t>myaudio/{i}.wav</t></is></c><c r="C3" t="inlineStr"><is><t>{escape(text)}</t></is></c></row>'
                    book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{head}{body}</sheetData></worksheet>")
                names.append(f"b{i}.xlsx")
                contents.append(out.getvalue())
            yield pd.DataFrame({"name": names, "content": contents})

    _written(items.mapInPandas(made, "name string, content binary"), at)
    return files.sheets(spark, at).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("book"), "row", "cells")


@query("select name, (octet_length(encode(text)) > 0) as there from (select 'f' || item_id || '.txt' as name, text from benchmark where item_id % 3 <> 2)")
def tree_scan(spark, sf_dir):
    """Files below a root by a pattern, without an excluded folder; contents aren't read."""
    at = _folder(spark, "tree")
    items = table(spark, sf_dir, "benchmark")
    name = lambda folder, ending: F.concat(F.lit("f"), F.col("item_id").cast("string"), F.lit(ending))
    rows = lambda which, ending: items.where(which).select(name("", ending).alias("name"), F.col("text").cast("binary").alias("content"))
    _written(rows("item_id % 3 = 0", ".txt"), f"{at}/a")
    _written(rows("item_id % 3 = 1", ".txt"), f"{at}/b/c")
    _written(rows("item_id % 3 = 2", ".txt"), f"{at}/skipped")
    _written(rows("item_id % 3 = 2", ".bin"), f"{at}/a")
    found = files.listing(spark, at, "*.txt", "/skipped/")
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), (F.col("length") > 0).alias("there"))


_ROBOTS = [("disallow", "/private"), ("allow", "/private/open"), ("disallow", "/*.pdf$"), ("disallow", ""), ("allow", "/x.pdf")]
_SITE_PATHS = ("/a", "/private/x", "/private/open/y", "/b/c.pdf", "/b/c.pdf?x", "/x.pdf", "/privately")


@query(f"select doc_id, {sql_pick('doc_id', *_SITE_PATHS)} as path, [true, false, true, false, true, false, false][doc_id % 7 + 1] as allowed from documents")
def robots_rules(spark, sf_dir):
    """Paths that a site's rules allow: the longest pattern decides."""
    rows = table(spark, sf_dir, "documents").select("doc_id", pick("doc_id", *_SITE_PATHS).alias("path"))
    return rows.withColumn("allowed", H.robots_allow(F.col("path"), _ROBOTS))


@query("""select doc_id, case when doc_id % 3 <> 0 then 'https://h/download?id=' || doc_id || '&confirm=t+%26' end as url, case when doc_id % 4 = 0 then 'content_type' when doc_id % 4 = 1 then 'empty' end as problem from documents""")
def confirmed_downloads(spark, sf_dir):
    """The address behind a confirmation page, and what is wrong with a response."""
    key = F.col("doc_id").cast("string")
    form = F.concat(F.lit('<form id="f" action="/download" method=get><input type="hidden" name="id" value="'), key, F.lit("\"><input type='submit' name=s value='go'><input name='confirm' type='hidden' value='t &amp;'></form>"))
    kind = F.when(F.col("doc_id") % 4 == 0, "text/html; charset=utf-8").otherwise("Audio/MPEG; x=1")
    rows = table(spark, sf_dir, "documents").withColumn("page", F.when(F.col("doc_id") % 3 != 0, form).otherwise("<p>none</p>"))
    size = F.when(F.col("doc_id") % 4 == 1, 0).otherwise(5)
    return rows.select("doc_id", H.confirm_url(F.col("page"), F.lit("https://h/uc")).alias("url"), H.content_problem(kind, size, ["audio/mpeg"]).alias("problem"))


@query("select source || '_16k.zip' as name, min(doc_id)::bigint as size, 'md5:' || source as checksum, 'https://h/' || source as url from documents where source is not null group by source")
def record_listing(spark, sf_dir):
    """Files of one ending that JSON records list, each name once."""
    rows = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.min("doc_id").alias("size"))
    one = F.struct(F.concat("source", F.lit("_16k.zip")).alias("key"), "size", F.concat(F.lit("md5:"), "source").alias("checksum"), F.struct(F.concat(F.lit("https://h/"), "source").alias("self")).alias("links"))
    other = F.struct(F.concat("source", F.lit("_48k.zip")).alias("key"), F.lit(1).cast("long").alias("size"), F.lit("x").alias("checksum"), F.struct(F.lit("u").alias("self")).alias("links"))
    return files.record_files(rows.select(F.to_json(F.struct(F.array(other, one, one).alias("files"))).alias("payload")), "payload", "_16k.zip")


_REFINED = "(partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"


@query(f"""with c as (select * from conversations where conv_id % 4 <> 3), h as (select conv_id, turn, text, coalesce(list('r ' || text) filter (role = 'user') over {_REFINED}, []) as h,
coalesce(list(text) over (partition by conv_id order by turn rows between 1 following and 3 following), []) as f, row_number() over (partition by conv_id order by turn) - 1 as wave from c)
select conv_id || '-' || turn as id, wave::bigint as wave, 'Title: ' || coalesce(c_name, '(omitted)') || chr(10) || 'Description: ' || coalesce(c_mktsegment, '(omitted)') || chr(10) || 'Preceding:' || chr(10) || case when len(h) = 0 then '(none)' else array_to_string(list_slice(h, greatest(len(h) - 2, 1), len(h)), chr(10)) end
|| chr(10) || 'Target:' || chr(10) || text || chr(10) || 'Following:' || chr(10) || case when len(f) = 0 then '(none)' else array_to_string(f, chr(10)) end as prompt from h left join customer on c_custkey = conv_id and c_custkey % 2 = 0""")
def refinement_prompts(spark, sf_dir):
    """Prompts of chosen sources' targets: book metadata, the last refined texts before, the next raw ones after, and their wave."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn")).withColumn("source_id", F.concat(F.col("conv_id").cast("string"), F.lit(":t")))
    segments = turns.select("id", "source_id", F.col("turn").cast("double").alias("start_sec"))
    books = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("book_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("description"))
    refined = turns.where("role = 'user'").select("id", F.concat(F.lit("r "), "text").alias("text"))
    chosen = turns.where("conv_id % 4 <> 3").select("source_id").distinct()
    return P.refinement_requests(segments, turns.select("id", F.col("text").alias("normalized")), chosen, books, refined).select("id", "wave", "prompt")


@query(f"""with w as (select doc_id, doc_id::varchar as id, case when doc_id % 11 = 0 then '/abs/' else 'clips/' end || doc_id || '.wav' as path, sha256(text) as checksum, {_latin('source')} as n from documents where source is not null),
k as (select *, doc_id % 3 = 0 as known, doc_id % 6 = 0 as failed, doc_id % 9 = 0 as stale from w)
select id, known and not failed and not stale as reused, case when known and not failed and not stale then 'before' when doc_id % 7 = 0 then null else 't ' || doc_id end as transcript,
case when known and not failed and not stale then null when starts_with(path, '/') then 'invalid_segment_path' when doc_id % 7 = 0 then 'inference_failed' else 'normalization_rejected' end as reason from k""")
def transcription_ledger(spark, sf_dir):
    """The next ledger: prior rows of the same digest and checksum that did not fail are kept, the others are worked on and judged."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    key = F.col("doc_id").cast("string")
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, "/abs/").otherwise("clips/"), key, F.lit(".wav"))
    segments = docs.select(key.alias("id"), path.alias("path"), F.sha2("text", 256).alias("checksum"), "doc_id")
    prior = segments.where("doc_id % 3 = 0").select(
        "id", "path", "checksum", F.when(F.col("doc_id") % 9 == 0, "old").otherwise("new").alias("digest"), F.lit("before").alias("transcript"), F.lit("before").alias("normalized"),
        F.lit(None).cast("string").alias("reason"), (F.col("doc_id") % 6 == 0).alias("operational"),
    )

    def make():
        def model(paths):
            numbers = [int(p.rsplit("/", 1)[1].split(".")[0]) for p in paths]
            if any(n % 7 == 0 for n in numbers):
                raise ValueError("no")
            return [f"t {n}" for n in numbers]  # digits, which the Latin pack rejects

        return model

    found = P.transcription(segments.drop("doc_id"), segments.select("path"), prior, make, "new", T.normalize_latin)
    return found.select("id", "reused", "transcript", "reason")


@query(f"""with r as (select lang as dataset, {_latin('text')} as n from documents where lang in ('en', 'de')), w as (select dataset, n, string_split(n, ' ') as words from r where n <> '' and len(string_split(n, ' ')) <= 150)
select coalesce(dataset, 'all') as dataset, count(*)::bigint as examples, round(count(*) / sum(len(words))::double, 6) as wer, round(sum(len(words[-1]) + (len(words) > 1)::int) / sum(len(n))::double, 6) as cer from w group by rollup(dataset)""")
def evaluated_sets(spark, sf_dir):
    """Error rates by dataset and overall of a recognizer that loses each last word; empty and long references are skipped."""
    docs = table(spark, sf_dir, "documents")
    tables = {lang: docs.where(F.col("lang") == lang).select(T.normalize_latin(F.col("text")).alias("path"), F.col("text").alias("sentence")) for lang in ("de", "en")}
    rates = P.evaluation(tables, lambda: lambda paths: [p.rpartition(" ")[0] for p in paths], T.normalize_latin, 150)[1]
    return rates.select("dataset", "examples", rounded("wer", "wer"), rounded("cer", "cer"))
