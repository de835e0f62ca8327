"""Whole preparations as compositions of the operators: DataFrames in, DataFrames out. Readers and writers stand around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nava.functions import arrays as A
from nava.functions import html as H
from nava.functions import signal as S
from nava.functions import text as T
from nava.operators import constraints as C
from nava.operators import context as X
from nava.operators import intervals as I
from nava.operators import metrics as M
from nava.operators import relational as R
from nava.session import stored
from nava.sources.files import resolve_paths

Normalizer = Callable[[Column], Column]


@dataclass(frozen=True)
class Prepared:
    """The split rows of a preparation and its counters."""

    rows: DataFrame
    audit: DataFrame


def corpus_splits(validated: DataFrame, dev: DataFrame, test: DataFrame, normalize: Normalizer = T.normalize_persian) -> Prepared:
    """split, path, sentence: leakage-free splits; test keeps rejected rows as plain raw text, the others drop them."""
    splits = R.rebuild_splits(validated, dev, test, "path")
    texts = R.first_wins(R.labelled_union({"0": test, "1": validated, "2": dev}, "__from"), ["path"], [F.col("__from")]).select("path", "sentence")
    rows = splits.join(texts, "path")
    normalized = normalize(F.col("sentence"))
    rows = rows.withColumn("normalized", normalized).withColumn("final", T.with_fallback(F.col("sentence"), F.col("normalized"), F.col("split") == "test"))
    audit = M.audit(
        rows, "split", source=F.lit(True), final=F.col("final").isNotNull(), changed=F.col("normalized") != F.col("sentence"),
        discarded=F.col("final").isNull(), fallback=F.col("normalized").isNull() & F.col("final").isNotNull(),
    )
    return Prepared(rows.where("final is not null").select("split", "path", F.col("final").alias("sentence")), audit)


def renamed_splits(rows: DataFrame, names: dict[str, str], normalize: Normalizer = T.normalize_persian) -> Prepared:
    """Records with a split, audio_path and transcription: splits renamed, texts normalized, paths as .wav names."""
    split = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("split")]
    out = rows.select(split.alias("split"), F.concat(T.stem(F.col("audio_path")), F.lit(".wav")).alias("path"), "transcription")
    out = out.withColumn("sentence", T.with_fallback(F.col("transcription"), normalize(F.col("transcription")), F.col("split") == "test"))
    audit = M.audit(out, "split", source=F.lit(True), final=F.col("sentence").isNotNull(), discarded=F.col("sentence").isNull())
    return Prepared(out.where("sentence is not null").select("split", "path", "sentence"), audit)


def archive_corpus(metadata: DataFrame, members: DataFrame, normalize: Normalizer = T.normalize_persian) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with audio (file_name, sentence, member), counters, and names that no archive holds. Repeated names are an error."""
    C.require(C.duplicates(metadata, "file_name"), "a file name repeats")
    texts = metadata.withColumn("normalized", normalize(F.col("sentence")))
    names = members.select(F.regexp_extract("member", r"([^/]*)$", 1).alias("file_name"), "member")
    found = texts.where("normalized is not null").join(names, "file_name", "left")
    audit = M.audit(texts, source=F.lit(True), normalized=F.col("normalized").isNotNull(), changed=F.col("normalized") != F.col("sentence"), discarded=F.col("normalized").isNull())
    have = found.where("member is not null").select("file_name", F.col("normalized").alias("sentence"), "member")
    return have, audit, found.where("member is null").select("file_name")


def conversion_report(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """path, problem for two tables of path, rate, samples: missing, unexpected, other rates or samples beyond the tolerance."""
    a = left.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.struct("rate", "samples").alias("a"))
    b = right.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.struct("rate", "samples").alias("b"))
    problem = C.first_reason(
        ("missing", F.col("b").isNull()), ("unexpected", F.col("a").isNull()), ("rate", F.col("a.rate") != F.col("b.rate")),
        ("samples", ~A.within(F.col("a.samples"), F.col("b.samples"), tolerance)),
    )
    return a.join(b, "stem", "full").select("stem", problem.alias("problem")).where("problem is not null")


def noise_index(listing: DataFrame, facts: DataFrame) -> DataFrame:
    """id, scene, path of readable noise files."""
    good = listing.join(facts.where("error is null").select("path"), "path", "left_semi")
    return good.select(T.generated_id(F.col("path")).alias("id"), T.scene_of(F.col("path")).alias("scene"), "path")


def segmentation(frames: DataFrame, settings: I.Settings = I.Settings(), hop: float = 512 / 16000, threshold: float = 0.5, least: float = 0.25, merge: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Clips, and rejected sources, from source_id, frame, probability, duration_sec."""
    found = I.speech_intervals(frames, "source_id", "frame", "probability", "duration_sec", hop, threshold, least)
    merged = I.merge_pairwise(found, "source_id", merge)
    lengths = frames.groupBy("source_id").agg(F.max("duration_sec").alias("duration_sec"))
    clips = I.segments(merged.join(lengths, "source_id"), "source_id", "duration_sec", settings)
    order = F.row_number().over(Window.partitionBy("source_id").orderBy("start_sec"))
    clips = clips.withColumn("id", F.concat_ws("-", T.safe_id(F.col("source_id").cast("string")), F.lpad(order.cast("string"), 6, "0")))
    rejected = lengths.join(clips.select("source_id"), "source_id", "left_anti").withColumn("reason", F.lit("no_usable_speech"))
    return clips, rejected


def transcription(segments: DataFrame, listing: DataFrame, prior: DataFrame, make: Callable, digest: str, normalize: Normalizer = T.normalize_persian) -> DataFrame:
    """The next ledger: id, path, checksum, digest, transcript, normalized, reason, operational, reused.

    Clips on disk that no segment names are worked on too. Prior rows of the same digest and checksum that aren't operational
    failures are kept as they are.
    """
    known = segments.select("id", "path", "checksum")
    extra = listing.join(known, "path", "left_anti").select(T.generated_id(F.col("path")).alias("id"), "path", F.lit(None).cast("string").alias("checksum"))
    work = known.unionByName(extra).withColumn("digest", F.lit(digest))
    marked = R.reuse(work, prior, "id", ["digest", "checksum"])
    kept = prior.join(marked.where("reused").select("id"), "id", "left_semi").withColumn("reused", F.lit(True))
    fresh = X.transcribe(marked.where("not reused").drop("reused"), "path", make).withColumn("normalized", normalize(F.col("transcript")))
    reason = C.first_reason(
        ("invalid_segment_path", T.unsafe_path(F.col("path"))), ("inference_failed", F.col("error").isNotNull()),
        ("normalization_rejected", F.coalesce(F.length("normalized"), F.lit(0)) == 0),
    )
    fresh = fresh.withColumn("reason", reason).withColumn("operational", F.coalesce(F.col("reason").isin("invalid_segment_path", "inference_failed"), F.lit(False)))
    columns = ["id", "path", "checksum", "digest", "transcript", "normalized", "reason", "operational", "reused"]
    return fresh.withColumn("reused", F.lit(False)).select(*columns).unionByName(kept.select(*columns))


def selection(segments: DataFrame, usable: DataFrame, hours: float, seed: str) -> DataFrame:
    """source_id, seconds, segments of complete sources that come closest to a number of hours."""
    C.require(C.duplicates(segments, "id"), "a segment id repeats")
    C.require(C.not_positive(segments, "duration_sec"), "a duration isn't positive")
    C.require(C.orphans(usable, segments.select("id"), "id"), "a transcription has no segment")
    groups = R.complete_groups(segments, usable, "source_id", "id", "duration_sec").where("complete")
    return R.closest_prefix(groups, "source_id", "total", hours * 3600, seed).select("source_id", F.col("total").alias("seconds"), F.col("rows").alias("segments"))


def refinement_requests(segments: DataFrame, transcripts: DataFrame, chosen: DataFrame, books: DataFrame, refined: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """One prompt for each target with its wave and fingerprint; refined (id, text) has the accepted texts so far."""
    C.require(C.orphans(chosen, segments.select("source_id"), "source_id"), "a chosen source has no segments")
    rows = transcripts.join(segments.select("id", "source_id", "start_sec"), "id").join(chosen.select("source_id"), "source_id", "left_semi")
    book = F.when(F.split_part("source_id", F.lit(":"), F.lit(1)).rlike(r"^\d+$"), F.split_part("source_id", F.lit(":"), F.lit(1)))
    rows = rows.withColumn("book_id", book).join(books.select("book_id", "title", "description"), "book_id", "left")
    rows = rows.join(refined.select("id", F.col("text").alias("refined")), "id", "left")
    rows = rows.withColumn("session", X.session_key(F.col("source_id"), F.col("id"))).withColumn("start", F.coalesce("start_sec", F.lit(float("inf"))))
    rows = X.context(rows, "session", ["start", "id"], "refined", F.col("refined").isNotNull(), before, 0).drop("following")
    w = Window.partitionBy("session").orderBy("start", "id")
    rows = rows.withColumn("following", F.collect_list("normalized").over(w.rowsBetween(1, after)) if after else F.array().cast("array<string>"))
    rows = X.waves(rows, "session", ["start", "id"])
    prompt = T.prompt(F.col("title"), F.col("description"), F.col("preceding"), F.col("normalized"), F.col("following"))
    return rows.select("id", "session", "wave", F.col("normalized").alias("target"), prompt.alias("prompt")).withColumn("fingerprint", X.input_fingerprint(F.col("id"), F.col("prompt")))


def degraded_dataset(clips: DataFrame, variants: int, seed: int, noise: np.ndarray | None = None) -> DataFrame:
    """degraded_id, split, variant, samples and the degradation of each variant of split, path, rate, samples."""
    rows = R.variants(clips.select("split", "path", "rate", "samples"), variants)
    kinds = "split string, path string, variant int, rate long, samples array<double>, codec string, target_bandwidth string, gain_db double, snr_db double, observed_loss double, normalization_scale double, seed long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for split, path, rate, samples, variant in part[["split", "path", "rate", "samples", "variant"]].itertuples(index=False):
                own = S.stable_seed(seed, split, path, int(variant))
                wave, f = S.degrade(np.asarray(samples), noise, int(rate), own)
                out.append((split, path, variant, rate, wave, f["codec"], f["target_bandwidth"], f["gain_db"], f["snr_db"], f["observed_loss"], f["normalization_scale"], own))
            yield pd.DataFrame(out, columns=[k.split()[0] for k in kinds.split(", ")])

    return rows.mapInPandas(run, kinds).withColumn("degraded_id", T.pair_id(F.col("split"), T.stem(F.col("path")), F.col("variant")))


def long_variants(clips: DataFrame, per_group: int, seed: str, least: int = 2, most: int = 4, gap: float = 0.2, target: float = 5.0, cap: float = 20.0, draws: int = 64) -> DataFrame:
    """split, variant, paths, sentence, seconds: seeded concatenations within a split.

    A variant takes clips in seeded order, each once, while it has fewer than `most` and stays within the cap, until it has `least` and the
    target. It first draws `draws` places of its split's clips, so variants times draws rows are joined, not variants times clips; a
    variant that these don't complete goes on through all clips of its split.
    """
    own = clips.select("split", "path", "sentence", "seconds").withColumn("__order", F.sha2(F.concat_ws("|", F.lit(seed), "path"), 256))
    placed = stored(R.positions(own, ["split"], ["__order", "path"], "__at"), "variant-clips")
    sizes = placed.groupBy("split").agg(F.count("*").alias("__n"))
    wanted = sizes.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))))
    drawn = wanted.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("__at", F.floor(R.hash_unit(seed, F.col("split"), F.col("variant"), F.col("draw")) * F.col("__n")).cast("long"))
    item = F.struct("draw", "path", "sentence", "seconds")
    lists = drawn.join(placed, ["split", "__at"]).groupBy("split", "variant").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def complete(v: Column) -> Column:
        return (F.size(v["paths"]) >= most) | ((F.size(v["paths"]) >= least) & (v["seconds"] >= target))

    def take(v: Column, x: Column) -> Column:
        longer = v["seconds"] + x["seconds"] + F.when(F.size(v["paths"]) > 0, gap).otherwise(0.0)
        more = F.struct(F.array_append(v["paths"], x["path"]).alias("paths"), F.array_append(v["texts"], x["sentence"]).alias("texts"), longer.alias("seconds"))
        return F.when(complete(v) | (longer > cap) | F.array_contains(v["paths"], x["path"]), v).otherwise(more)

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("paths"), none.alias("texts"), F.lit(0.0).alias("seconds"))
    first = stored(lists.select("split", "variant", F.aggregate("items", start, take).alias("v")), "variant-draws")
    done = complete(F.col("v"))
    # What is open goes on through its split's clips in order; one variant's clips fit a row, as a variant reads them as one list.
    rest = first.where(~done).join(placed, "split").groupBy("split", "variant", "v").agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("draw"), "path", "sentence", "seconds"))).alias("items"))
    rest = rest.select("split", "variant", F.aggregate("items", F.col("v"), take).alias("v"))
    out = first.where(done).unionByName(rest).where(F.size("v.paths") >= least)
    return out.select("split", "variant", F.col("v.paths").alias("paths"), T.squeeze(F.array_join("v.texts", " ")).alias("sentence"), F.col("v.seconds").alias("seconds"))


def catalogue_links(pages: DataFrame, category: str, number: str, html: str, pattern: str = r"[?&]g=(\d+)") -> DataFrame:
    """category, link, id in page order, each once, from pages before the first that is empty or repeats an earlier one."""
    rows = pages.withColumn("links", F.filter(H.links(F.col(html)), lambda x: x.rlike(pattern))).withColumn("signature", F.sha2(F.to_json("links"), 256))
    again = F.row_number().over(Window.partitionBy(category, "signature").orderBy(number)) > 1
    rows = rows.withColumn("__stop", (F.size("links") == 0) | again)
    stop = F.min(F.when(F.col("__stop"), F.col(number))).over(Window.partitionBy(category))
    rows = rows.withColumn("__end", stop).where(F.col("__end").isNull() | (F.col(number) < F.col("__end")))
    links = rows.select(category, number, F.posexplode("links").alias("__at", "link")).withColumn("id", F.regexp_extract("link", pattern, 1))
    return R.first_wins(links, [category, "id"], [F.col(number), F.col("__at")]).select(category, "link", "id")


def radio_days(stations: DataFrame, first: str, last: str, checkpoints: DataFrame) -> DataFrame:
    """station, day that are still to be read: the spine of included stations and days without those present."""
    spine = R.date_spine(stations.where("included").select("station"), F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spine.join(checkpoints.select("station", "day"), ["station", "day"], "left_anti")


def radio_episodes(entries: DataFrame, programs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Completed entries with program and class, and the days that may be checked off: those without an error."""
    rows = entries.withColumn("completed", C.completed(F.col("day"), F.col("start_time"), F.col("minutes"), now))
    rows = rows.join(programs.select("program_id", F.col("title").alias("program_title")), "program_id", "left")
    text = T.squeeze_zwnj(F.concat_ws(" ", "title", "program_title"))
    reason = T.first_rule(text, T.EPISODE_RULES)
    rows = rows.withColumn("reason", reason).withColumn("eligible", (reason == "broad_speech_default") & F.col("completed"))
    days = entries.groupBy("station", "day").agg(F.bool_or(F.col("error").isNotNull()).alias("failed")).where("not failed").select("station", "day")
    return rows.where("completed"), days


def download_plan(tracks: DataFrame, have: DataFrame, limit_bytes: int) -> DataFrame:
    """Per book the first full track, else all that aren't samples; what is there isn't loaded again; up to the byte limit."""
    url = F.nullif(F.trim("url"), F.lit(""))
    rows = tracks.withColumn("url", url)
    full = F.coalesce(F.col("is_full") & F.col("url").isNotNull(), F.lit(False))
    usable = F.col("url").isNotNull() & ~F.coalesce("is_sample", F.lit(False))
    rows = R.preferred_else_all(rows, ["book_id"], full, usable, ["track"])
    return R.budget_stop(R.not_existing(rows, have, "url"), [F.col("book_id").cast("long"), F.col("track")], "bytes", limit_bytes)


def best_audio(candidates: DataFrame) -> DataFrame:
    """Per page the candidate with the highest bitrate, ties to the larger URL, of pages whose provenance holds."""
    good = candidates.where("entity = 'VOA' and copied = 'no' and language_service = 'VOA Persian' and content_type = 'audio'")
    rows = good.withColumn("bitrate", F.coalesce(T.bitrate(F.col("label")), T.bitrate(F.regexp_extract("url", r"(\d+k)", 1)), F.lit(0)))
    return R.argmax(rows, ["page"], "url", ["bitrate", "url"])


def evaluation(tables: dict[str, DataFrame], make: Callable, normalize: Normalizer = T.normalize_persian, most_tokens: int = 448, tokens: Callable[[Column], Column] = T.word_count) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, rates by dataset and overall, and skipped rows with their reason. tokens counts a reference's label tokens."""
    rows = R.labelled_union(tables)
    reference = F.coalesce(normalize(F.col("sentence")), F.lit(""))
    rows = rows.withColumn("reference", reference)
    reason = C.first_reason(("empty", (F.length(F.trim("path")) == 0) | (F.col("reference") == "")), ("too_long", tokens(F.col("reference")) > most_tokens))
    rows = rows.withColumn("reason", reason)
    scored = X.transcribe(rows.where("reason is null").drop("reason"), "path", make)
    scored = M.error_counts(scored.withColumn("hypothesis", F.coalesce(normalize(F.col("transcript")), F.lit(""))), F.col("reference"), F.col("hypothesis"))
    rates = M.error_rates(scored, "dataset", overall=True).withColumn("dataset", F.coalesce("dataset", F.lit("all")))
    return scored.select("dataset", "path", "reference", "hypothesis"), rates, rows.where("reason is not null").select("dataset", "path", "reason")


def pair_validation(pairs: DataFrame, most_lag_ms: float = 20.0, no_op: float = 0.05, high_tolerance: float = 0.05) -> DataFrame:
    """Measures and flags of clean, degraded, rate, target_bandwidth; a lag at the limit is flagged."""
    limit = F.ceil(F.col("rate") * most_lag_ms / 1000).cast("long")
    cutoff = F.when(F.col("target_bandwidth") == "narrow", 3400.0).otherwise(7000.0)
    rows = pairs.withColumn("r", S.best_lags(F.col("degraded"), F.col("clean"), limit))
    rows = rows.withColumn("high", S.high_fractions(F.col("degraded"), F.col("rate"), cutoff)).withColumn("relative", A.relative_l2(F.col("clean"), F.col("degraded")))
    rows = rows.withColumn("snr_db", A.waveform_snr(F.col("clean"), F.col("degraded"), F.col("r.lag")))
    flags = C.flags(lag=F.abs(F.col("r.lag")) >= limit, no_op=F.col("relative") < no_op, bandwidth=F.col("high") > high_tolerance)
    return rows.select("degraded_id", "target_bandwidth", F.col("r.lag").alias("lag"), F.col("r.corr").alias("corr"), "high", "relative", "snr_db", flags.alias("flags"))


def artifact_overview(segments: DataFrame, transcripts: DataFrame, rejected: DataFrame, seed: str, n: int = 5) -> dict[str, DataFrame]:
    """Counts of boundaries and rejections, sources, and a seeded sample of transcripts with their segments."""
    return {
        "boundaries": M.common(segments, "boundary_type"), "rejections": M.common(rejected, "reason"), "sources": segments.agg(F.countDistinct("source_id").alias("sources")),
        "sample": R.seeded_sample(transcripts, "id", n, seed).join(segments.drop("path"), "id", "left"),
    }


def release_splits(rows: DataFrame, group: Column, seed: str, shares: dict[str, float], gates: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the quality gates with a split by group digest, and the others with their first reason."""
    marked = rows.withColumn("reason", C.first_reason(*gates))
    return R.stable_split(marked.where("reason is null").drop("reason"), group, seed, shares), marked.where("reason is not null")


def identical_views(column: str) -> tuple[Column, Column]:
    """noisy and clean of rows that were never degraded."""
    return F.col(column).alias("noisy"), F.col(column).alias("clean")


def evaluation_set(rows: DataFrame, listing: DataFrame, normalize: Normalizer = T.normalize_persian) -> Prepared:
    """path, sentence of one evaluation set's transcripts: audio by name, else by stem; rejected sentences stay as plain text.

    Rows without audio or text are counted and left out; two rows of one file are an error.
    """
    found = resolve_paths(rows.select("path", F.col("sentence").alias("raw")), listing, "path")
    found = found.withColumn("normalized", normalize(F.col("raw")))
    found = found.withColumn("sentence", F.nullif(T.with_fallback(F.col("raw"), F.col("normalized"), F.lit(True)), F.lit("")))
    audit = M.audit(
        found, source=F.lit(True), missing_audio=F.col("found").isNull(), empty=F.col("sentence").isNull(), fallback=F.col("normalized").isNull() & F.col("sentence").isNotNull(),
        final=F.col("found").isNotNull() & F.col("sentence").isNotNull(),
    )
    good = found.where("found is not null and sentence is not null")
    C.require(C.duplicates(good, "found"), "a file has two transcripts")
    return Prepared(good.select(F.col("found").alias("path"), "sentence"), audit)
