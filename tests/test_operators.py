"""Relational operators, intervals, context, metrics and arrays: exact cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nava.functions import arrays as A
from nava.functions import signal as S
from nava.functions import text as T
from nava.operators import constraints as C
from nava.operators import context as X
from nava.operators import intervals as I
from nava.operators import metrics as M
from nava.operators import relational as R


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_split_construction(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    out = R.rebuild_splits(ids("a", "b", "c", "d", "d"), ids("b", "t1", "x"), ids("t1", "t2", "c"), "path")
    assert rows(out) == [("dev", "b"), ("test", "c"), ("test", "t1"), ("test", "t2"), ("train", "a"), ("train", "d")]


def test_group_completeness_and_closest_prefix(spark):
    segments = spark.createDataFrame([("a", "a-0", 40.0), ("a", "a-1", 20.0), ("b", "b-0", 50.0), ("c", "c-0", 70.0), ("p", "p-0", 30.0), ("p", "p-1", 30.0)], "source string, id string, seconds double")
    usable = spark.createDataFrame([("a-0",), ("a-1",), ("b-0",), ("c-0",), ("p-0",)], "id string")
    groups = R.complete_groups(segments, usable, "source", "id", "seconds")
    assert [r for r in rows(groups) if not r[3]] == [("p", 60.0, 2, False)]
    two = spark.createDataFrame([("x", 60), ("y", 60)], "source string, seconds long")
    count = lambda target: R.closest_prefix(two, "source", "seconds", target, "s").count()
    assert [count(100), count(90), count(1)] == [2, 1, 1]
    with pytest.raises(ValueError):
        count(0)


def test_budget_choice_and_samples(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 5, 20, 1])], "k long, v long")
    assert rows(R.budget_stop(df, "k", "v", 12).select("k")) == [(0,), (1,)]
    lines = spark.createDataFrame([("x", 1, "S"), ("x", 2, "F"), ("x", 3, "F"), ("y", 1, "A"), ("y", 2, "N")], "b string, n long, kind string")
    out = R.preferred_else_all(lines, ["b"], F.col("kind") == "F", F.col("kind") != "N", ["n"])
    assert rows(out.select("b", "n")) == [("x", 2), ("y", 1)]
    marks = spark.createDataFrame([(i, i < 3) for i in range(20)], "k long, yes boolean")
    picked = R.balanced_sample(marks, F.col("yes"), "k", 10, "s")
    assert rows(picked.groupBy("yes").count()) == [(False, 7), (True, 3)]
    assert rows(R.seeded_sample(marks, "k", 5, "s")) == rows(R.seeded_sample(marks.repartition(7), "k", 5, "s"))


def test_ledgers(spark):
    prior = spark.createDataFrame([(1, "d", False), (2, "d", True), (3, "old", False)], "k long, digest string, operational boolean")
    work = spark.createDataFrame([(i, "d") for i in (1, 2, 3, 4)], "k long, digest string")
    assert rows(R.reuse(work, prior, "k", ["digest"])) == [(1, "d", True), (2, "d", False), (3, "d", False), (4, "d", False)]
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, u string, v string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "k long, u string, v string")
    assert rows(R.overlay(old, new, "k"), "k") == [(1, "a", "x"), (2, None, "z"), (3, "c", "w")]
    assert rows(R.upsert_groups(old, new, "k"), "k") == [(1, "a", "x"), (2, None, "z"), (3, "c", "w")]
    assert rows(R.table_diff(old, new, "k", ["u", "v"])) == [(1, "only_left"), (2, "changed"), (3, "only_right")]


def test_constraints(spark):
    df = spark.createDataFrame([("a b", 1.0), ("a-b", float("nan")), ("c", -1.0), ("c", None)], "id string, v double")
    assert rows(C.duplicates(df, "id")) == [("c", 2)]
    assert rows(C.safe_id_collisions(df, "id")) == [("a-b", 2)]
    assert C.not_positive(df, "v").count() == 3
    with pytest.raises(C.ConstraintError):
        C.require(C.duplicates(df, "id"), "duplicate ids")
    weights = spark.createDataFrame([(0.0,), (0.0,)], "w double")
    assert C.invalid_weights(weights, "w").count() == 1 and C.invalid_weights(weights.limit(0), "w").count() == 1
    row = spark.createDataFrame([(None, 1, 2)], "a long, b long, c long")
    assert row.select(C.missing_fields("a", "b")).first()[0] == ["a"]
    url = spark.createDataFrame([("https://x.org/a",), ("https://x.org:1/a",), ("http://x.org/a",), ("https://u@x.org/a",), ("bad url",)], "u string")
    assert [r[0] for r in url.select(C.allowed_url(F.col("u"), ["x.org"], ["/a"])).collect()] == [True, False, False, False, False]
    late = spark.createDataFrame([("2026-01-01", "9:30", 30), ("2026-01-01", "9:31", 30), ("x", "9:00", 1)], "d string, s string, m int")
    done = C.completed(F.col("d"), F.col("s"), F.col("m"), F.lit("2026-01-01 10:00:00").cast("timestamp"))
    assert [r[0] for r in late.select(done).collect()] == [True, False, False]


def test_speech_intervals(spark):
    values = [0.9, 0.8, 0.1, 0.7, 0.2, 0.6, 0.6]
    frames = spark.createDataFrame([("s", i, p, 3.3) for i, p in enumerate(values)], "k string, i long, p double, d double")
    out = rows(I.speech_intervals(frames, "k", "i", "p", "d", 0.5, least=0.75))
    assert out == [("s", 0.0, 1.0, pytest.approx(0.85), 0.9), ("s", 2.5, 3.3, pytest.approx(0.6), 0.6)]
    merged = spark.createDataFrame([("s", 0.0, 1.0, 1.0, 1.0), ("s", 1.4, 2.0, 2.0, 2.0), ("s", 2.4, 3.0, 4.0, 4.0), ("s", 3.5, 4.0, 9.0, 9.0)], "k string, start_sec double, end_sec double, mean_probability double, max_probability double")
    assert rows(I.merge_pairwise(merged, "k", 0.5)) == [("s", 0.0, 3.0, 2.75, 4.0), ("s", 3.5, 4.0, 9.0, 9.0)]


def test_overlap(spark):
    left = spark.createDataFrame([("s", 0.0, 10.0), ("s", 20.0, 30.0)], "k string, start_sec double, end_sec double")
    right = spark.createDataFrame([("s", 5.0, 25.0), ("s", 8.0, 9.0), ("t", 0.0, 9.0)], "k string, start_sec double, end_sec double")
    assert rows(I.overlap(left, right, "k", 3.0)) == [("s", 0.0, 10.0, 6.0), ("s", 20.0, 30.0, 5.0)]


def test_segmentation():
    near = pytest.approx
    two = I.segment(40, [(0.2, 18.0), (18.6, 39.0)], energy=lambda s, e, w: (21.0, 8.0))
    assert [(c["boundary_type"], c["start_sec"], c["end_sec"]) for c in two] == [("silence", near(0.05), near(18.3)), ("source_end", near(18.3), near(39.15))]
    first = I.segment(60, [(0, 60)], energy=lambda s, e, w: (s + 1.5, 9.0))[0]
    assert (first["boundary_type"], first["end_sec"]) == ("energy_fallback", near(19.5))
    first = I.segment(60, [(0, 60)], energy=lambda s, e, w: (s + 1.5, 2.0))[0]
    assert (first["boundary_type"], first["end_sec"]) == ("hard_cut", near(25.0))
    only = I.segment(8, [(0.5, 7.0)])
    assert [(c["start_sec"], c["end_sec"]) for c in only] == [(near(0.35), near(7.15))]
    assert all(c["speech_seconds"] >= 2 for c in I.segment(30, [(0, 20), (28.5, 29)], energy=lambda s, e, w: (20.0, 8.0)))
    assert I.segment(5, []) == []
    for bad in (lambda: I.segment(0, []), lambda: I.segment(5, [(2, 1)]), lambda: I.Settings(target=5)):
        with pytest.raises(ValueError):
            bad()


def test_grouped_segmentation(spark):
    df = spark.createDataFrame([("a", 0.2, 18.0, 40.0), ("a", 18.6, 39.0, 40.0), ("b", 0.5, 1.0, 8.0)], "k string, start_sec double, end_sec double, d double")
    assert [r[0] for r in rows(I.segments(df, "k", "d"))] == ["a", "a"]


def test_batches():
    assert I.pack_batches([1, 5, 3, 3], 2, 100) == [[1, 2], [3, 0]]
    assert I.pack_batches([4, 4, 1], 9, 5) == [[0], [1], [2]]
    assert I.pack_batches([], 2, 1) == []


def test_context_and_validation(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate("abcde")], "k string, i long, t string")
    out = X.context(df, "k", ["i"], "t", F.col("t") != "b", 2, 1).orderBy("i").collect()
    assert [(r.preceding, r.following) for r in out] == [([], ["b"]), (["a"], ["c"]), (["a"], ["d"]), (["a", "c"], ["e"]), (["c", "d"], [])]
    answer = lambda text, unsure=False: json.dumps({"cleaned_text": text, "uncertain": unsure}, ensure_ascii=False)
    cases = [
        (answer("سلام، ۱۲!"), "سلام ۱۲", 0.35, None), (answer("سلام", True), "سلام", 0.35, "model_uncertain"),
        (answer("hello"), "سلام", 1.0, "persian_normalization_rejected"), (answer("سلام ۱۳"), "سلام ۱۲", 1.0, "numeric_tokens_changed"),
        (answer("کاملا متفاوت"), "سلام دنیا", 0.1, "edit_distance_exceeded"), ('{"cleaned_text": "x", "uncertain": false, "y": 1}', "سلام", 1.0, "invalid_schema"),
        ("not json", "سلام", 1.0, "invalid_json"), ('{"cleaned_text": "سلام", "uncertain": "no"}', "سلام", 1.0, "invalid_schema"),
    ]
    for response, target, threshold, reason in cases:
        one = spark.createDataFrame([(response, target)], "r string, t string")
        assert X.validate(one, "r", "t", T.normalize_persian, threshold).first()["reason"] == reason, response


def test_causal_refinement(spark):
    df = spark.createDataFrame([("s", i, f"t{i}") for i in range(3)], "k string, i long, t string")
    out = X.refine(df, "k", "i", "t", lambda prompts: [p.replace("\n", "|") for p in prompts], lambda answer, target: target.upper(), 1, 1).orderBy("i").collect()
    assert out[1]["response"] == "Preceding:|T0|Target:|t1|Following:|t2"


def test_transcription_falls_back_to_single_rows(spark):
    def make():
        def model(paths):
            if "bad" in paths:
                raise ValueError("unreadable")
            return [p.upper() for p in paths]

        return model

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "path string").coalesce(1)
    assert [(r.transcript, r.error) for r in X.transcribe(df, "path", make).collect()] == [("A", None), (None, "inference_failed: unreadable"), ("C", None)]


def test_error_rates(spark):
    df = spark.createDataFrame([("x", "ab", "ac"), ("x", "cd", "cd"), ("y", "ef", "eg")], "d string, r string, h string")
    out = M.error_rates(M.error_counts(df, F.col("r"), F.col("h")), "d")
    assert rows(out) == [("x", 2, 0.5, 0.25), ("y", 1, 1.0, 0.5)]


def test_summaries(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    r = M.summary(df, "v").first()
    assert (r.n, r.mean, r.median, r.p90, r.least, r.most) == (4, 4.0, 2.5, pytest.approx(7.9), 1.0, 10.0)
    assert rows(M.value_counts(spark.createDataFrame([("", 0), ("a", 2)], "s string, n long"), {"s": F.col("s"), "n": F.col("n")})) == [("n", "2", 1), ("n", "none", 1), ("s", "a", 1), ("s", "none", 1)]
    assert M.macro_batch_mean(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "b long, v double"), F.col("b"), "v").first()[0] == 6.0


def test_arrays(spark):
    df = spark.createDataFrame([([3.0, -4.0], [0.0, 2.0], ["_", "a", "a", "_", "a", "b"])], "x array<double>, y array<double>, t array<string>")
    x, y = F.col("x"), F.col("y")
    out = df.select(
        A.rms(x), A.peak_scale(x, 2.0), A.pair_peak_scale(F.array(F.lit(0.4)), y, 0.5), A.fit_length(x, 3), A.repeat_or_crop(x, 5), A.rolled(x, F.lit(1)), A.shifted(x, F.lit(-1)),
        A.ctc_collapse(F.col("t"), F.lit("_")), A.clipped_fraction(x, 3.0), A.l1(x, y), A.mono(F.array(x, y)), A.within(x, y, 6.0), A.frames(x, 3), A.hard_clip(x, 1.0),
    ).first()
    assert out[0] == pytest.approx(np.sqrt(12.5)) and out[1] == 0.5 and out[2] == 0.25
    assert list(out)[3:] == [[3.0, -4.0, 0.0], [3.0, -4.0, 3.0, -4.0, 3.0], [-4.0, 3.0], [-4.0, 0.0], ["a", "a", "b"], 0.5, 4.5, [1.5, -1.0], True, [[3.0, -4.0, 0.0]], [1.0, -1.0]]


def test_low_energy_boundary(spark):
    wave = [1.0] * 40 + [0.001] * 20 + [1.0] * 40
    out = spark.createDataFrame([(wave,)], "x array<double>").select(A.low_energy_boundary(F.col("x"), 100, F.lit(10.0)).alias("r")).first()["r"]
    assert out["at"] == pytest.approx(10.5) and out["dip_db"] > 20


def test_signal():
    random = np.random.default_rng(1)
    base = random.standard_normal(400)
    delayed = np.concatenate([np.zeros(37), base])[:400]
    assert S.alignment_lag(base, delayed, 100) == 37
    lag, corr = S.best_lag(base, np.roll(base, 7), 20)
    assert lag == -7 and corr > 0.9
    tone = np.sin(2 * np.pi * 300 * np.arange(16000) / 16000)
    assert S.high_fraction(tone, 16000, 3400) < 0.01
    lost = S.burst_mask(50, 0.2, 3, np.random.default_rng(3))
    out, share = S.drop_frames(np.ones(16000), lost, 320)
    assert 0 < lost.sum() < 50 and share == lost.mean() and (out == 0).sum() == lost.sum() * 320
    assert S.stable_seed(1, "train", "x", 0) == S.stable_seed(1, "train", "x", 0) != S.stable_seed(1, "train", "x", 1)
    a, b = S.degrade(tone, base, 16000, 5), S.degrade(tone, base, 16000, 5)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1] and len(a[0]) == len(tone) and np.abs(a[0]).max() <= 0.99 + 1e-9
    assert np.abs(S.mu_law(tone) - tone).max() < 0.05 and np.abs(S.a_law(tone) - tone).max() < 0.05
    assert S.log_mel(tone).shape == (80, 101) and len(S.resample(tone, 16000, 8000)) == 8000
