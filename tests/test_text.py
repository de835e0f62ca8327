"""Text expressions: exact cases."""

import pytest
from pyspark.sql import functions as F

from nava.functions import dates as D
from nava.functions import html as H
from nava.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("خب ، تو چیكار می كنی؟", "خب تو چیکار می کنی"),
        ("أۀك ي ى ﯽ ﻮ ے ﺒ ﻢ ٬", "اهک ی ی ی و ی ب م"),
        ("سلام! «دوست»؛", "سلام دوست"),
        ("سلام [دوست] / امروز", "سلام دوست امروز"),
        ("سلام #خوانده_نمیشود دنیا", "سلام دنیا"),
        ("  سلام    دنیا  ", "سلام دنیا"),
        ("hello سلام", None),
        ("", ""),
    ],
)
def test_persian_normalizer(spark, text, expected):
    assert one(spark, T.normalize_persian(F.col("t")), t=text) == expected


def test_null_text_stays_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(T.normalize_persian(F.col("t"))).first()[0] is None


@pytest.mark.parametrize("a, b, expected", [("abc", "adc", 1 / 3), ("", "", 0.0), ("a", "", 1.0), ("سلام", "سلام", 0.0)])
def test_edit_distance(spark, a, b, expected):
    assert one(spark, T.edit_distance(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(expected)


@pytest.mark.parametrize("r, h, edits", [("سلام دنیا", "سلام", 1), ("سلام دنیا", "سلام امروز", 1), ("سلام دنیا", "سلام دنیا اضافه", 1), ("a b c d", "b c d a", 2), ("", "x", 1)])
def test_word_distance(spark, r, h, edits):
    assert one(spark, T.word_distance(F.col("r"), F.col("h")), r=r, h=h) == edits


@pytest.mark.parametrize("text, seconds", [("259:49", 15589), ("32:49", 1969), ("2:46", 166), ("1:02:03", 3723), ("5", None), ("a:1", None)])
def test_durations(spark, text, seconds):
    assert one(spark, D.duration_seconds(F.col("t")), t=text) == seconds


def test_mail_date(spark):
    assert one(spark, D.iso_with_offset(F.col("t")), t="Tue, 14 Jul 2026 19:00:00 +0330") == "2026-07-14T19:00:00+03:30"


@pytest.mark.parametrize("text, out", [("a b/ج.wav", "a-b-.wav"), ("...", "source"), ("x" * 120, "x" * 96)])
def test_safe_id(spark, text, out):
    assert one(spark, T.safe_id(F.col("t")), t=text) == out


@pytest.mark.parametrize("text, out", [("A" * 64, "sha256:" + "a" * 64), ("md5:" + "b" * 32, "md5:" + "b" * 32), ("xyz", None)])
def test_checksum(spark, text, out):
    assert one(spark, T.checksum(F.col("t")), t=text) == out


@pytest.mark.parametrize("text, out", [("16k", 16000), ("128 kbps", 128000), ("12200", 12200), ("none", None)])
def test_bitrate(spark, text, out):
    assert one(spark, T.bitrate(F.col("t")), t=text) == out


@pytest.mark.parametrize("size, out", [(10, "10 B"), (2048, "2.0 KB"), (int(10.5 * 2**20), "10.5 MB")])
def test_human_bytes(spark, size, out):
    assert one(spark, T.human_bytes(F.col("n")), n=size) == out


def test_gib(spark):
    assert one(spark, T.gib_bytes(F.col("t")), t="1.5") == 3 * 2**29


@pytest.mark.parametrize("station, name, out", [("11", "x", "included_default"), ("501", "x", "included_default"), ("21", "x", "explicit_music_station"), ("202", "x", "non_persian_station"), ("22", "رادیو نمایش", "included_default"), ("23", "رادیو نما", "radio_visual_station"), ("9", "x", None)])
def test_stations(spark, station, name, out):
    assert one(spark, T.station_reason(F.col("s"), F.col("n")), s=station, n=name) == out


@pytest.mark.parametrize("text, out", [("گفتگو با مهمان", "broad_speech_default"), ("موسیقی و آگهی", "explicit_music"), ("آگهی", "advertisement_or_promo"), ("میان برنامه", "station_filler")])
def test_episode_rules(spark, text, out):
    assert one(spark, T.first_rule(F.col("t"), T.EPISODE_RULES), t=text) == out


def test_pages(spark):
    page = '<title>T</title><meta content="O" property="og:title"><a href="/a.mp4">MP4</a> <a href=\'/b.mp3\'>MP3 &amp; more 10.5 MB</a><dt>Author</dt><dd><a>A</a><a>B</a><a>A</a></dd>'
    assert one(spark, H.title(F.col("t")), t=page) == "O"
    assert one(spark, H.links(F.col("t")), t=page) == ["/a.mp4", "/b.mp3"]
    assert one(spark, H.download_link(F.col("t")), t=page).asDict() == {"url": "/b.mp3", "size": "10.5 MB"}
    assert one(spark, H.field_values(F.col("t"), "Author"), t=page) == ["A", "B"]
    assert one(spark, H.unescape(F.col("t")), t="&eacute;&#x41;") == "éA"
    assert one(spark, H.absolute_url(F.col("b"), F.col("t")), b="https://x.org/a/b", t="../c") == "https://x.org/c"
    assert one(spark, H.normalized_url(F.col("t")), t="https://x.org:8080/a") is None
    assert one(spark, H.normalized_url(F.col("t")), t="https://x.org/a?b=1#c") == "https://x.org/a?b=1"


def test_prompt_and_numbers(spark):
    out = one(spark, T.prompt(F.lit(None).cast("string"), F.lit("d"), F.array().cast("array<string>"), F.col("t"), F.array(F.lit("n"))), t="x")
    assert out == "Title: (omitted)\nDescription: d\nPreceding:\n(none)\nTarget:\nx\nFollowing:\nn"
    assert one(spark, T.number_tokens(F.col("t")), t="a۱۲ b34 ³") == ["۱۲", "34"]
    assert one(spark, T.number_tokens(F.col("t"), strict=True), t="x³") == ["³"]


def test_error_text(spark):
    assert one(spark, T.error_text(F.col("t"), "unknown"), t='{"error": "bad"}') == "bad"
    assert one(spark, T.error_text(F.col("t"), "unknown"), t="plain ") == "plain"
    assert one(spark, T.error_text(F.col("t"), "unknown"), t=" ") == "unknown"
