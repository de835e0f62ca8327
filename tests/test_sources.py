"""Sources, sinks and streams on small files."""

import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nava.sources import files, sinks
from nava.streaming import incremental


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('path\tsentence\tspeaker\na.wav\t"say ""x"""\ts1\nb.wav\t\ts2\n')
    df = files.delimited(spark, str(tmp_path / "a.tsv"))
    assert [tuple(r) for r in df.collect()] == [("a.wav", 'say "x"', "s1"), ("b.wav", "", "s2")]
    assert [r.source_index for r in files.numbered(df).orderBy("source_index").collect()] == [1, 2]
    with pytest.raises(files.SourceError):
        files.delimited(spark, str(tmp_path / "a.tsv"), required=("path", "text"))


def test_overflow_belongs_to_the_text(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿file_name,sentence\nx/one,سلام, دوست\ntwo.mp3,b\n", encoding="utf-8")
    assert [tuple(r) for r in files.overflowing(spark, str(tmp_path / "m.csv"), ",").collect()] == [("one.mp3", "سلام, دوست"), ("two.mp3", "b")]
    (tmp_path / "t.tsv").write_text("\tfile_name\tsentence\n0\ta.mp3\tx\n", encoding="utf-8")
    assert [tuple(r) for r in files.overflowing(spark, str(tmp_path / "t.tsv"), "\t").collect()] == [("a.mp3", "x")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n long").collect()] == [("a", 1), ("b", None)]
    (tmp_path / "b.jsonl").write_text('{"id": "a"}\n[1]\n')
    with pytest.raises(files.SourceError):
        files.json_lines(spark, str(tmp_path / "b.jsonl"), "id string")
    assert files.json_lines(spark, str(tmp_path / "b.jsonl"), "id string", strict=False).count() == 1


def test_pattern_lines(spark, tmp_path):
    (tmp_path / "o.txt").write_text('"001-A.wav" "a b"\n\n')
    assert [tuple(r) for r in files.pattern_lines(spark, str(tmp_path / "o.txt")).collect()] == [("001-A.wav", "a b")]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "x_10.tar", "w") as tar:
        for name in ("nested/a.mp3", "b.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    with zipfile.ZipFile(tmp_path / "x_2.zip", "w") as z:
        z.writestr("c.mp3", b"de")
    out = files.archive_members(spark, str(tmp_path), r"\.mp3$").select("member", "content").orderBy("member").collect()
    assert [(r.member, bytes(r.content)) for r in out] == [("c.mp3", b"de"), ("nested/a.mp3", b"abc")]
    listed = files.listing(spark, str(tmp_path)).withColumn("n", files.shard_number(F.col("path"))).orderBy("n").collect()
    assert [r.n for r in listed] == [2, 10]
    assert files.unsafe_member("../x") and files.unsafe_member("/x") and not files.unsafe_member("a/b")


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>audio</t></si><si><r><t>te</t></r><r><t>xt</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>a.wav</t></is></c><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    assert [r.cells for r in files.sheets(spark, str(tmp_path / "s.xlsx")).orderBy("row").collect()] == [["audio", "", "text"], ["a.wav", "5"]]
    assert files.choose_column(["Audio file", "Text"], ("text",), default=0) == 1


def test_audio(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(files.wav_bytes(np.linspace(-1, 1, 8000), 16000))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    facts = files.audio_facts(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.rate, r.channels, r.frames, r.seconds, r.error) for r in facts] == [(16000, 1, 8000, 0.5, None), (None, None, None, None, "invalid_audio")]
    own = files.audio_samples(spark, str(tmp_path)).collect()
    assert len(own) == 1 and np.allclose(own[0].samples, np.linspace(-1, 1, 8000), atol=1e-4)


def test_feed(spark):
    item = '<item><title>T</title><link>https://x.org/1</link><guid>g</guid><pubDate>Tue, 14 Jul 2026 19:00:00 +0330</pubDate><enclosure url="https://x.org/i.jpg"/></item>'
    feed = spark.createDataFrame([("u", f"<rss><channel>{item}{item}<item><title>x</title></item></channel></rss>")], "url string, payload string")
    out = files.feed_items(feed, "url", F.col("payload"), 1).collect()
    assert [(r.title, r.guid, r.enclosure) for r in out] == [("T", "g", "https://x.org/i.jpg")]


def test_paths_resolve_by_name_then_stem(spark):
    own = spark.createDataFrame([("x/a.wav",), ("b.wav",), ("c.wav",)], "path string")
    there = spark.createDataFrame([("/d/a.wav",), ("/d/b.mp3",), ("/e/b.mp3",)], "path string")
    assert [r.found for r in files.resolve_paths(own, there, "path").orderBy("path").collect()] == ["/d/b.mp3", None, "/d/a.wav"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "y"), ("a", "x")], "path string, sentence string")
    sinks.split_file(df, str(tmp_path / "s"), "path")
    assert [r.path for r in files.delimited(spark, str(tmp_path / "s")).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.replace(df, str(tmp_path / "s"), lambda rows, at: rows.write.parquet(at), guard=lambda rows: False)
    assert files.delimited(spark, str(tmp_path / "s")).count() == 2
    sinks.json_lines(df, str(tmp_path / "j"), "path")
    assert files.json_lines(spark, str(tmp_path / "j"), "path string").count() == 2
    assert sinks.canonical_digest({"b": 1, "a": 2}) == sinks.canonical_digest({"a": 2, "b": 1})
    with pytest.raises(ValueError):
        sinks.digest_gate("a", "b")


def test_settings():
    assert files.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert files.dotenv("# x\nexport A='1'\nB = two\n") == {"A": "1", "B": "two"}


def test_available_now_goes_on_where_it_stopped(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.range(3).write.parquet(at)
    run = lambda: incremental.run_available(incremental.stream_of(spark, at, "id long"), str(tmp_path / "c"), path=str(tmp_path / "out"))
    run()
    spark.range(3, 5).write.mode("append").parquet(at)
    run()
    assert sorted(r.id for r in spark.read.schema("id long").parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_recent_texts_are_state(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.createDataFrame([("a", t) for t in "wxyz"], "k string, t string").coalesce(1).write.parquet(at)
    stream = incremental.recent_texts(incremental.stream_of(spark, at, "k string, t string"), "k", "t", keep=2)
    incremental.run_available(stream, str(tmp_path / "c"), path=str(tmp_path / "out"))
    out = {r.text: r.preceding for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {"w": [], "x": ["w"], "y": ["w", "x"], "z": ["x", "y"]}
