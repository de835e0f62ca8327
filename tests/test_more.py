"""Orders, pairings, uploads, codecs and page records."""

import pytest
from pyspark.sql import functions as F

from nava.functions import html as H
from nava.operators import constraints as C
from nava.operators import metrics as M
from nava.operators import relational as R
from nava.sources import sinks


def test_resumable_order(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    whole = [r.k for r in R.resumable_order(df, "k", "s", 1).orderBy("position").collect()]
    rest = [r.k for r in R.resumable_order(df.repartition(7), "k", "s", 1, skip=20).orderBy("position").collect()]
    assert sorted(whole) == list(range(50)) and rest == whole[20:]
    assert whole != [r.k for r in R.resumable_order(df, "k", "s", 2).orderBy("position").collect()]
    sizes = [r["count"] for r in R.dealt(df, "k", 3, "s").groupBy("hand").count().collect()]
    assert sorted(sizes) == [16, 17, 17]


def test_zip_and_lookup(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "i long, a string")
    b = spark.createDataFrame([(1, "q"), (0, "p")], "i long, b string")
    assert sorted(tuple(r) for r in R.zipped(a, b, "i").collect()) == [(0, "x", "p"), (1, "y", "q")]
    with pytest.raises(ValueError):
        R.zipped(a, b.limit(1), "i")
    out = R.lookup(a, F.col("a"), {"x": {"rate": 8000}}, ["rate"]).orderBy("i").collect()
    assert [r.rate for r in out] == [8000, None]
    assert R.readable_until(a, "i", F.col("a") == "y", 3, "s").count() == 1


def test_uploads_and_codecs(spark):
    df = spark.createDataFrame([("WAV", 10, 1.0), ("exe", 10, 1.0), ("mp3", 99, 1.0), ("mp3", 0, 1.0), ("mp3", 10, None)], "e string, n long, s double")
    assert [r[0] for r in df.select(C.upload_reason(F.col("e"), F.col("n"), F.col("s"), ["wav", "mp3"], 50, 9.0)).collect()] == [None, "extension", "size", "empty", "duration"]
    codecs = spark.createDataFrame([("gsm", "narrow"), ("gsm", "wide"), ("pass_through", "wide"), ("?", "wide")], "c string, p string")
    assert [r[0] for r in codecs.select(C.codec_fits(F.col("c"), F.col("p"))).collect()] == [True, False, True, False]
    assert M.throughput(spark.createDataFrame([(4, 1.0), (2, 2.0)], "n long, s double"), "n", "s").first()[0] == 2.0


def test_page_records(spark):
    page = '<h1 itemprop="name">B</h1><meta property="og:description" content="D"><dt>Author</dt><dd><a>X</a></dd><ul><li>Sample 2:46</li><li><a href="/f.mp3">Full book 259:49</a></li><li>about</li></ul>'
    out = spark.createDataFrame([(page,)], "t string").select(H.book_page(F.col("t")).alias("b")).first()["b"]
    assert (out.title, out.description, out.authors) == ("B", "D", ["X"])
    assert [(t.url, t.length, t.is_sample, t.is_full) for t in out.tracks] == [(None, "2:46", True, False), ("/f.mp3", "259:49", False, True)]
    audio = "<audio data-sources='[{&quot;src&quot;:&quot;https://x/a.mp3&quot;,&quot;label&quot;:&quot;128k&quot;}]'></audio><audio src='https://x/b.mp3'>"
    got = spark.createDataFrame([(audio,)], "t string").select(H.audio_candidates(F.col("t")).alias("a")).first()["a"]
    assert [(x.src, x.label) for x in got] == [("https://x/a.mp3", "128k"), ("https://x/b.mp3", None)]


def test_each_file(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "name string, content binary")
    top = str(tmp_path)

    def write(name, content):
        with open(f"{top}/{name}", "wb") as file:
            file.write(content)

    sinks.each_file(df, "name", "content", write)
    assert (tmp_path / "b").read_bytes() == b"2"


def test_budgets_of_any_key(spark):
    """Negative and text keys stand in their own order."""
    rows = spark.createDataFrame([(k, str(k), 10) for k in (-5, 1, 2, 1000, -2000)], "k long, t string, v long").repartition(3)
    assert sorted(r["k"] for r in R.budget_stop(rows, "k", "v", 30).collect()) == [-2000, -5, 1]
    assert sorted(r["t"] for r in R.budget_stop(rows, "t", "v", 20).collect()) == ["-2000", "-5"]
    assert R.budget_stop(rows.limit(0), "k", "v", 20).count() == 0


def test_context_is_bounded_and_skips_what_is_not_accepted(spark):
    from nava.operators import context as X

    rows = [("s", i, f"t{i}", None if i % 7 == 0 else i % 3 != 0) for i in range(60)] + [(None, 0, "x", True), (None, 1, None, True), (None, 2, "y", True)]
    df = spark.createDataFrame(rows, "s string, i long, t string, ok boolean").repartition(4)
    for before in (0, 1, 3):
        out = {(r["s"], r["i"]): r for r in X.context(df, "s", ["i"], "t", F.col("ok"), before, 2).collect()}
        for s, i, _, _ in rows:
            own = [x for x in rows if x[0] == s]
            past = [x[2] for x in own if x[1] < i and x[3] and x[2] is not None]
            assert out[s, i]["preceding"] == (past[-before:] if before else []) and out[s, i]["following"] == [x[2] for x in own if i < x[1] <= i + 2 and x[2] is not None]


def test_shared_folder_on_a_cluster():
    from nava import session

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)


def test_guard_sees_what_was_written(spark, tmp_path):
    at, seen = f"{tmp_path}/t", []
    write = lambda df, path: df.limit(1).write.parquet(path)
    sinks.replace(spark.range(5), at, write, guard=lambda df: seen.append(df.count()) or True)
    assert seen == [1]
    sinks.document(spark, {"a": 1}, f"{tmp_path}/s.json")
    assert sinks.update_document(spark, f"{tmp_path}/s.json", b=[2]) == {"a": 1, "b": [2]}
    assert not sinks.inside("/a/bc", "/a/b") and sinks.inside("/a/b/../b/c", "file:///a/b")
    (tmp_path / "tree/x").mkdir(parents=True)
    (tmp_path / "tree/x/f").write_text("1")
    (tmp_path / "tree/skip").write_text("1")
    assert sinks.copied_tree(spark, f"{tmp_path}/tree", f"{tmp_path}/copy", ("skip",)) == 1 and (tmp_path / "copy/x/f").read_text() == "1"
    with pytest.raises(ValueError):
        sinks.copied_tree(spark, f"{tmp_path}/tree", f"{tmp_path}/tree/x/y")


def test_configs_and_roots(spark, tmp_path):
    from nava.sources import configs
    from nava.sources.files import SourceError

    (tmp_path / "b/data/wav").mkdir(parents=True)
    (tmp_path / "a/z/wav").mkdir(parents=True)
    assert configs.data_root(spark, str(tmp_path), "wav").endswith("/a/z")
    with pytest.raises(SourceError):
        configs.data_root(spark, str(tmp_path), "none")
    (tmp_path / "c.json").write_text('{"x": {"y": 2}}')
    assert configs.load(spark, f"{tmp_path}/c.json", {"x": {"y": 1, "z": 3}, "w": 4}) == {"x": {"y": 2, "z": 3}, "w": 4}
    with pytest.raises(SourceError):
        configs.dataset_kind(spark, str(tmp_path))
    assert configs.datasets(spark, {"dataset_dir": "d"}) == [("d", "degraded")] and configs.of_kind([("a", "x"), ("b", "y")], "y") == ["b"]


def test_strict_lines_are_told_by_number(spark, tmp_path):
    from nava.sources import files

    (tmp_path / "b.jsonl").write_text('{"id": "a"}\n\n{"id": "b"} x\n')
    with pytest.raises(files.SourceError, match="3"):
        files.json_lines(spark, f"{tmp_path}/b.jsonl", "id string")
    with pytest.raises(files.SourceError):
        files.required(spark.createDataFrame([(1, None)], "a int, b string"), "a", "b")


def test_long_variants_take_each_clip_once(spark):
    from nava.plans import pipelines as P

    clips = spark.createDataFrame([(s, f"{s}{i}", f"w{i}", 1.5) for s, n in (("train", 8), ("dev", 5), ("test", 2)) for i in range(n)], "split string, path string, sentence string, seconds double")
    made = lambda df, **kw: sorted((r["split"], r["variant"], tuple(r["paths"]), r["seconds"]) for r in P.long_variants(df, 20, "s", target=3.0, **kw).collect())
    out, few = made(clips), made(clips.repartition(3), draws=2)
    assert len(out) == len(few) == 60 and out == made(clips.repartition(2))
    assert all(len(set(p)) == len(p) >= 2 and s >= 3.0 and all(x.startswith(split) for x in p) for split, _, p, s in out + few)


def test_stored_tables_are_discarded(spark):
    from nava import session

    old = session.stored(spark.range(3), "old")
    before = session.written(spark)
    kept, gone = session.stored(spark.range(4), "kept"), session.stored(spark.range(5), "gone")
    session.discard(spark, kept, before=before)
    assert old.count() == 3 and kept.count() == 4 and session.written(spark) == before | {kept._nava_path}
    with pytest.raises(Exception):
        gone.count()


def test_streamed_files_and_arrays(tmp_path):
    import hashlib
    import io

    import numpy as np

    at = str(tmp_path / "a.mp3")
    found = sinks.streamed([b"ab", b"", b"c"], "audio/mpeg; q=1", at, ("audio/mpeg",))
    assert found == {"bytes": 3, "checksum": f"sha256:{hashlib.sha256(b'abc').hexdigest()}", "media_type": "audio/mpeg"}

    def failing():
        yield b"x"
        raise OSError("gone")

    for chunks, kind in (([], "audio/mpeg"), ([b"x"], "text/html"), (failing(), "audio/mpeg")):
        with pytest.raises((ValueError, OSError)):
            sinks.streamed(chunks, kind, str(tmp_path / "b.mp3"), ("audio/mpeg",))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.mp3"]
    values = np.arange(6.0).reshape(2, 3)
    assert np.array_equal(np.load(io.BytesIO(sinks.npy_bytes(values))), values)
