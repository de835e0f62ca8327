"""Preparations on small inputs with stand-in models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nava.operators.constraints import ConstraintError
from nava.plans import pipelines as P


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def frame(spark, ddl, *values):
    return spark.createDataFrame(list(values), ddl)


def test_corpus_splits(spark):
    ddl = "path string, sentence string"
    validated = frame(spark, ddl, ("train-a.wav", "آه، سلام"), ("train-r.wav", "hello"), ("dev-a.wav", "یک"), ("test-a.wav", "دو"), ("test-reject.wav", "hello تست!"))
    out = P.corpus_splits(validated, frame(spark, ddl, ("dev-a.wav", "یک"), ("test-a.wav", "دو"), ("gone.wav", "x")), frame(spark, ddl, ("test-a.wav", "دو"), ("test-reject.wav", "hello تست!")))
    assert rows(out.rows) == [("dev", "dev-a.wav", "یک"), ("test", "test-a.wav", "دو"), ("test", "test-reject.wav", "hello تست"), ("train", "train-a.wav", "آه سلام")]
    audit = {r["split"]: r for r in out.audit.collect()}
    assert (audit["train"]["discarded"], audit["test"]["fallback"], audit["test"]["final"]) == (1, 1, 2)


def test_archive_corpus(spark):
    meta = frame(spark, "file_name string, sentence string", ("one.mp3", "سلام، دوست"), ("two.mp3", "hello"), ("three.mp3", "سه"))
    members = frame(spark, "member string", ("nested/one.mp3",), ("nested/other.mp3",))
    have, audit, missing = P.archive_corpus(meta, members)
    assert rows(have, "file_name", "sentence") == [("one.mp3", "سلام دوست")] and rows(missing) == [("three.mp3",)]
    assert audit.first().asDict() == {"source": 3, "normalized": 2, "changed": 1, "discarded": 1}
    with pytest.raises(ConstraintError):
        P.archive_corpus(meta.union(meta), members)


def test_renamed_splits(spark):
    df = frame(spark, "split string, audio_path string, transcription string", ("validation", "x/a.mp3", "سلام!"), ("test", "b.mp3", "ok تست"), ("train", "c.mp3", "no"))
    assert rows(P.renamed_splits(df, {"validation": "dev", "train": "train", "test": "test"}).rows) == [("dev", "a.wav", "سلام"), ("test", "b.wav", "ok تست")]


def test_segmentation_and_selection(spark):
    speech = [("s", i, 0.9 if not 560 <= i < 600 else 0.1, 40.0) for i in range(1250)] + [("silent", i, 0.0, 3.0) for i in range(90)]
    clips, rejected = P.segmentation(frame(spark, "source_id string, frame long, probability double, duration_sec double", *speech))
    assert rows(clips, "id", "boundary_type") == [("s-000001", "silence"), ("s-000002", "source_end")]
    assert rows(rejected, "source_id", "reason") == [("silent", "no_usable_speech")]
    segments = frame(spark, "id string, source_id string, duration_sec double", ("a-0", "a", 40.0), ("a-1", "a", 20.0), ("b-0", "b", 60.0), ("p-0", "p", 30.0), ("p-1", "p", 30.0))
    usable = frame(spark, "id string", ("a-0",), ("a-1",), ("b-0",), ("p-0",))
    assert P.selection(segments, usable, 100 / 3600, "s").count() == 2 and P.selection(segments, usable, 1 / 3600, "s").count() == 1
    with pytest.raises(ConstraintError):
        P.selection(segments.union(segments), usable, 1.0, "s")


def make():
    def model(paths):
        if any("bad" in p for p in paths):
            raise ValueError("unreadable")
        return ["سلام" if "good" in p else "hello" for p in paths]

    return model


def test_transcription_ledger(spark):
    segments = frame(spark, "id string, path string, checksum string", ("1", "clips/good1", "x"), ("2", "clips/bad", "x"), ("3", "clips/latin", "x"))
    listing = frame(spark, "path string", ("clips/good1",), ("clips/good9",))
    prior = frame(spark, "id string, path string, checksum string, digest string, transcript string, normalized string, reason string, operational boolean", )
    first = P.transcription(segments, listing, prior, make, "d").cache()
    assert sorted((r.path, r.normalized, r.reason, r.operational) for r in first.collect()) == [
        ("clips/bad", None, "inference_failed", True), ("clips/good1", "سلام", None, False), ("clips/good9", "سلام", None, False), ("clips/latin", None, "normalization_rejected", False),
    ]
    again = P.transcription(segments, listing, first.drop("reused"), make, "d")
    assert sorted(r.path for r in again.where("not reused").collect()) == ["clips/bad"]
    assert P.transcription(segments, listing, first.drop("reused"), make, "other").where("reused").count() == 0


def test_refinement_requests(spark):
    segments = frame(spark, "id string, source_id string, start_sec double", ("a", "1:t", 0.0), ("b", "1:t", 1.0), ("c", "1:t", 2.0), ("z", "other", 0.0))
    texts = frame(spark, "id string, normalized string", ("a", "A"), ("b", "B"), ("c", "C"), ("z", "Z"))
    chosen = frame(spark, "source_id string", ("1:t",))
    books = frame(spark, "book_id string, title string, description string", ("1", "T", None))
    refined = frame(spark, "id string, text string", ("a", "A+"))
    out = {r.id: r for r in P.refinement_requests(segments, texts, chosen, books, refined, 1, 1).collect()}
    assert sorted(out) == ["a", "b", "c"] and out["b"].wave == 1
    assert out["b"].prompt == "Title: T\nDescription: (omitted)\nPreceding:\nA+\nTarget:\nB\nFollowing:\nC"


def test_degraded_dataset_and_validation(spark):
    wave = np.sin(np.arange(4000) / 5).tolist()
    clips = frame(spark, "split string, path string, rate long, samples array<double>", ("train", "x/a.wav", 16000, wave), ("train", "x/b.wav", 16000, wave))
    out = P.degraded_dataset(clips, 2, 7)
    assert rows(out, "degraded_id") == [("train_a_v0",), ("train_a_v1",), ("train_b_v0",), ("train_b_v1",)]
    assert rows(out, "degraded_id", "seed", "codec") == rows(P.degraded_dataset(clips.repartition(3), 2, 7), "degraded_id", "seed", "codec")
    pairs = out.join(clips.select("path", F.col("samples").alias("clean")), "path").withColumnRenamed("samples", "degraded")
    assert P.pair_validation(pairs).count() == 4
    same = pairs.withColumn("degraded", F.col("clean"))
    assert "no_op" in P.pair_validation(same).first()["flags"]
    assert P.conversion_report(clips, clips.limit(1), 0.0).count() == 1


def test_long_variants(spark):
    clips = frame(spark, "split string, path string, sentence string, seconds double", *[("train", f"{i}.wav", f"s{i}", 1.5) for i in range(8)], ("dev", "d.wav", "d", 1.5))
    out = P.long_variants(clips, 6, "s")
    got = rows(out)
    assert len(got) == 6 and all(r[0] == "train" and 2 <= len(r[2]) <= 4 and r[4] >= 3.0 for r in got)
    assert got == rows(P.long_variants(clips.repartition(5), 6, "s"))


def test_discovery_and_download(spark):
    page = lambda *ids: "".join(f'<a href="/b?g={i}">x</a>' for i in ids)
    pages = frame(spark, "c string, n long, html string", ("k", 1, page(1, 2, 1)), ("k", 2, page(2, 3)), ("k", 3, page(2, 3)), ("k", 4, page(9)), ("m", 1, page()))
    assert rows(P.catalogue_links(pages, "c", "n", "html"), "c", "id") == [("k", "1"), ("k", "2"), ("k", "3")]
    stations = frame(spark, "station string, included boolean", ("11", True), ("21", False))
    done = spark.sql("select '11' as station, date '2026-01-02' as day")
    assert P.radio_days(stations, "2026-01-01", "2026-01-03", done).count() == 2
    entries = frame(spark, "station string, day string, start_time string, minutes int, title string, program_id string, error string", ("11", "2026-01-01", "9:00", 30, "گفتگو", "p", None), ("11", "2026-01-02", "9:00", 30, "موسیقی", "q", "x"), ("11", "2026-01-09", "9:00", 30, "گفتگو", "p", None))
    programs = frame(spark, "program_id string, title string", ("p", "برنامه"))
    episodes, days = P.radio_episodes(entries, programs, F.lit("2026-01-05 00:00:00").cast("timestamp"))
    assert rows(episodes, "title", "eligible") == [("موسیقی", False), ("گفتگو", True)] and rows(days) == [("11", "2026-01-01"), ("11", "2026-01-09")]
    tracks = frame(spark, "book_id long, track int, url string, is_full boolean, is_sample boolean, bytes long", (1, 0, "s", False, True, 1), (1, 1, "f", True, False, 5), (1, 2, "c", False, False, 3), (2, 0, " ", True, False, 1), (2, 1, "a", False, False, 4), (2, 2, "b", False, False, 4))
    have = frame(spark, "url string, length long", ("a", 4), ("b", 0))
    assert rows(P.download_plan(tracks, have, 100), "url") == [("b",), ("f",)] and rows(P.download_plan(tracks, have, 8), "url") == [("f",)]
    audio = frame(spark, "page string, url string, label string, entity string, copied string, language_service string, content_type string", ("1", "u1", "64k", "VOA", "no", "VOA Persian", "audio"), ("1", "u2", "128k", "VOA", "no", "VOA Persian", "audio"), ("2", "u3", "128k", "AP", "no", "VOA Persian", "audio"))
    assert rows(P.best_audio(audio)) == [("1", "u2")]


def test_evaluation(spark):
    ddl = "path string, sentence string"
    predictions, rates, skipped = P.evaluation({"x": frame(spark, ddl, ("good", "سلام دنیا"), ("", "سلام")), "y": frame(spark, ddl, ("good2", "سلام"), ("z", "hello"))}, make)
    assert rows(rates, "dataset", "examples", "wer") == [("all", 2, pytest.approx(1 / 3)), ("x", 1, 0.5), ("y", 1, 0.0)]
    assert rows(skipped) == [("x", "", "empty"), ("y", "z", "empty")] and predictions.count() == 2


def test_release_splits(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 20)
    good, bad = P.release_splits(df, F.col("g").cast("string"), "s", {"train": 0.8, "test": 0.2}, [("small", F.col("id") < 10)])
    assert bad.count() == 10 and good.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
