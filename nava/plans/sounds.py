"""Catalogue, fourth part: waveforms. The embeddings stand for waveforms of 64 samples at 16,000 a second."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from nava.functions import arrays as A
from nava.functions import signal as S
from nava.operators import intervals as I
from nava.operators import relational as R
from nava.plans import pipelines as P
from nava.plans.catalogue import _SQUARES, _UNIT, _V, _waves
from nava.plans.registry import long, query, rounded
from nava.session import table
from nava.sources import files

_PAIR = f"{_V}, p as (select a.vec_id, a.x, b.x as y from v a join v b on b.vec_id = a.vec_id + 1)"
_RMS = "sqrt({q} / len({x}) + 1e-12)"


def _rms(x: str) -> str:
    return _RMS.format(q=_SQUARES.format(x=x), x=x)


def _sum(x: str) -> str:
    return f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * i))"


def _pairs(spark, sf_dir):
    """Each vector x and the next one y."""
    a = _waves(spark, sf_dir)
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


def _weighted(x):
    """A sum in which each place weighs differently."""
    return F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)


@query(f"with {_PAIR}, m as (select vec_id, list_max(list_transform(list_concat(x, y), lambda q: abs(q))) as peak from p) select vec_id, round(case when peak > 0.2 then 0.2 / peak else 1.0 end, 6) as scale from m")
def shared_peak(spark, sf_dir):
    """One peak-safe factor for both of a pair."""
    return _pairs(spark, sf_dir).select("vec_id", rounded(A.pair_peak_scale(F.col("x"), F.col("y"), 0.2), "scale"))


@query(f"""with {_PAIR}, m as (select vec_id, list_transform(list_zip(x, y), lambda z: z[1] + z[2] * ({_rms('x')} / ({_rms('y')} * pow(10, 6 / 20.0::double)))) as z from p) select vec_id, round({_sum('z')}, 6) as total, round({_rms('z')}, 6) as level from m""")
def noise_mix(spark, sf_dir):
    """Each vector with the next one as noise, 6 dB below."""
    rows = _pairs(spark, sf_dir).select("vec_id", A.mix_at_snr(F.col("x"), F.col("y"), 6.0).alias("z"))
    return rows.select("vec_id", rounded(_weighted(F.col("z")), "total"), rounded(A.rms(F.col("z")), "level"))


@query(f"""with {_V}, n as (select vec_id, x, (vec_id % 150)::int as n from v), m as (select vec_id, n, list_transform(range(0, n), lambda i: x[(i % len(x))::int + 1]) as r, list_transform(range(0, n), lambda i: coalesce(x[i + 1], 0.0)) as f from n)
select vec_id, n::bigint as n, round(coalesce({_sum('r')}, 0.0), 6) as repeated, round(coalesce({_sum('f')}, 0.0), 6) as fitted from m""")
def fitted_lengths(spark, sf_dir):
    """Repeated or cropped, and cut or padded, to a length."""
    n = (F.col("vec_id") % 150).cast("int")
    rows = _waves(spark, sf_dir).select("vec_id", n.alias("n"), A.repeat_or_crop(F.col("x"), n).alias("r"), A.fit_length(F.col("x"), n).alias("f"))
    return rows.select("vec_id", long(F.size("r"), "n"), rounded(_weighted(F.col("r")), "repeated"), rounded(_weighted(F.col("f")), "fitted"))


@query(f"""with {_V}, m as (select vec_id, x, (vec_id % 41 - 20)::int as lag from v), s as (select vec_id, list_transform(range(0, len(x)), lambda i: case when i - lag between 0 and len(x) - 1 then x[(i - lag)::int + 1] else 0.0 end) as z from m) select vec_id, round({_sum('z')}, 6) as total from s""")
def shifted_waves(spark, sf_dir):
    """Moved by a lag, zeros coming in."""
    lag = (F.col("vec_id") % 41 - 20).cast("int")
    return _waves(spark, sf_dir).select("vec_id", rounded(_weighted(A.shifted(F.col("x"), lag)), "total"))


@query(f"with {_PAIR} select vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] + y[i]) / 2 * i)), 6) as total from p")
def mono_mix(spark, sf_dir):
    """The mean of two channels."""
    return _pairs(spark, sf_dir).select("vec_id", rounded(_weighted(A.mono(F.array("x", "y"))), "total"))


@query(f"with {_PAIR} select vec_id, list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) <= 0.45 as same from p")
def equal_within(spark, sf_dir):
    """No sample of a pair further apart than a tolerance."""
    return _pairs(spark, sf_dir).select("vec_id", A.within(F.col("x"), F.col("y"), 0.45).alias("same"))


@query(f"""with {_V}, d as (select vec_id, list_transform(range(1, len(x) + 1), lambda i: case when (vec_id + i) % 9 = 0 then 'nan'::double when (vec_id + i) % 17 = 0 then 'inf'::double else x[i] end) as x from v), g as (select vec_id, len(x) as n, list_filter(x, lambda q: isfinite(q)) as x from d)
select vec_id, round(len(x) / n::double, 6) as finite, round(list_min(x), 6) as least, round(list_max(x), 6) as most, round(list_sum(x) / len(x), 6) as mean, round(list_max(list_transform(x, lambda q: abs(q))), 6) as peak from g""")
def tensor_stats(spark, sf_dir):
    """Facts of the finite values of arrays that hold others."""
    at = lambda i: F.col("vec_id") + i + 1
    broken = F.transform("x", lambda v, i: F.when(at(i) % 9 == 0, float("nan")).when(at(i) % 17 == 0, float("inf")).otherwise(v))
    rows = _waves(spark, sf_dir).select("vec_id", A.tensor_stats(broken).alias("s"))
    return rows.select("vec_id", *[rounded(f"s.{c}", c) for c in ("finite", "least", "most", "mean", "peak")])


@query(f"""with {_V}, w as (select vec_id, o, sqrt(list_sum(list_transform(x[o + 1:o + 8], lambda q: q * q)) / 8 + 1e-12) as level from v, unnest(list_concat(range(0, 57, 2))) t(o)),
f as (select vec_id, median(level) as middle, min_by(o, (level, o)) as o, min(level) as least from w group by vec_id) select vec_id, round(3.0 + (o + 4) / 1000.0::double, 6) as at, round(greatest(0, 20 * log10(middle / least)), 6) as dip from f""")
def quiet_boundary(spark, sf_dir):
    """The middle of the quietest window of eight samples, windows two apart, and how far it lies below their median."""
    rows = _waves(spark, sf_dir).select("vec_id", A.low_energy_boundary(F.col("x"), 1000, F.lit(3.0), 0.008).alias("b"))
    return rows.select("vec_id", rounded("b.at", "at"), rounded("b.dip_db", "dip"))


@query(f"with {_V}, f as (select vec_id, k, list_transform(range(0, 10), lambda i: coalesce(x[k * 10 + i + 1], 0.0)) as f from v, range(0, 7) t(k)) select vec_id, k::int as frame, round({_sum('f')}, 6) as total from f")
def fixed_frames(spark, sf_dir):
    """Frames of ten samples, the last one padded."""
    rows = _waves(spark, sf_dir).select("vec_id", F.posexplode(A.frames(F.col("x"), 10)).alias("frame", "f"))
    return rows.select("vec_id", "frame", rounded(_weighted(F.col("f")), "total"))


@query(f"with {_V}, m as (select vec_id, list_transform(range(0, len(x)), lambda i: case when (vec_id + i // 16) % 3 = 0 then 0.0 else x[i + 1] end) as z from v) select vec_id, round({_sum('z')}, 6) as total from m")
def dropped_frames(spark, sf_dir):
    """Frames that a mask names are silent."""
    lost = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("vec_id") + i) % 3 == 0)
    return _waves(spark, sf_dir).select("vec_id", rounded(_weighted(A.drop_frames(F.col("x"), lost, 16)), "total"))


@query(f"with {_V}, m as (select vec_id, x[s + 1:s + 20] as z from (select vec_id, x, floor({_UNIT.format(key=chr(39) + 'crop|' + chr(39) + ' || vec_id')} * 45)::bigint as s from v)) select vec_id, len(z)::bigint as n, round({_sum('z')}, 6) as total from m")
def random_crops(spark, sf_dir):
    """Twenty samples from a seeded start."""
    rows = _waves(spark, sf_dir).select("vec_id", A.crop(F.col("x"), 20, R.hash_unit("crop", F.col("vec_id"))).alias("z"))
    return rows.select("vec_id", long(F.size("z"), "n"), rounded(_weighted(F.col("z")), "total"))


@query("""with d as (select conv_id, turn, len(string_split(text, ' ')) as n from conversations) select conv_id, turn, n::int as valid, (max(n) over (partition by conv_id))::bigint as width, -100::bigint * (max(n) over (partition by conv_id) - n) as padding from d""")
def collated_labels(spark, sf_dir):
    """Labels padded with -100 to the longest of their batch."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.lit(1)).alias("labels"))
    rows = A.collated(rows, "conv_id", "labels", -100)
    padding = F.aggregate("labels", F.lit(0), lambda s, v: s + v) - F.col("valid")
    return rows.select("conv_id", "turn", "valid", long(F.size("labels"), "width"), long(padding, "padding"))


@query("select vec_id, 16000::bigint as rate, 1::bigint as channels, 64::bigint as frames, 0.004::double as seconds, case when vec_id % 10 = 0 then 'invalid_audio' end as error, 0.0::double as off from embeddings where vec_id % 10 <> 0 union all select vec_id, null, null, null, null, 'invalid_audio', null from embeddings where vec_id % 10 = 0")
def audio_headers(spark, sf_dir):
    """Waveforms as PCM files and back: header, and no sample further off than a step; others are invalid."""

    def write(parts):
        for part in parts:
            yield pd.DataFrame({"path": part["vec_id"].astype(str), "x": part["x"], "content": [b"none" if i % 10 == 0 else files.wav_bytes(x, 16000) for i, x in zip(part["vec_id"], part["x"])]})

    rows = _waves(spark, sf_dir).mapInPandas(write, "path string, x array<double>, content binary")
    facts = files.facts_of(rows.select("path", "content"))
    back = files.samples_of(rows.select("path", "content")).select("path", F.col("samples").alias("y"))
    off = F.floor(F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b))) * 16384).cast("double")
    return facts.join(rows.select("path", "x"), "path").join(back, "path", "left").select(F.col("path").cast("long").alias("vec_id"), "rate", "channels", "frames", "seconds", "error", F.abs(off).alias("off"))


@query("select vec_id, case vec_id % 4 when 0 then 'missing' when 1 then 'rate' when 2 then 'samples' end as problem from embeddings where vec_id % 4 <> 3")
def conversions(spark, sf_dir):
    """Converted files against their sources: missing ones, other rates, samples beyond a tolerance."""
    left = _waves(spark, sf_dir).select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), F.lit(16000).alias("rate"), F.col("x").alias("samples"), "vec_id")
    rate = F.when(F.col("vec_id") % 4 == 1, 8000).otherwise(16000)
    samples = F.transform("samples", lambda v: v + F.when(F.col("vec_id") % 4 == 2, 0.01).otherwise(1e-6))
    right = left.where("vec_id % 4 <> 0").select(F.regexp_replace("path", "wav$", "flac").alias("path"), rate.alias("rate"), samples.alias("samples"))
    return P.conversion_report(left.drop("vec_id"), right, 1e-4).select(F.col("stem").cast("long").alias("vec_id"), "problem")


@query(f"""with {_V}, m as (select vec_id, x, list_transform(range(0, len(x)), lambda i: 0.8 * x[((i - 5 + len(x)) % len(x))::int + 1]) as y from v),
l as (select vec_id, list_transform(list_zip(x, y), lambda z: z[2] - z[1]) as d, x from m)
select vec_id, round(sqrt({_SQUARES.format(x='d')}) / (sqrt({_SQUARES.format(x='x')}) + 1e-12), 6) as relative, list_filter([case when sqrt({_SQUARES.format(x='d')}) / (sqrt({_SQUARES.format(x='x')}) + 1e-12) < 0.5 then 'no_op' end], lambda f: f is not null) as flags from l""")
def validated_pairs(spark, sf_dir):
    """Clean and degraded waves: relative change, and the flag of pairs in which nothing happened."""
    rows = _waves(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("degraded_id"), F.lit("wide").alias("target_bandwidth"), F.lit(16000).alias("rate"), F.col("x").alias("clean"), A.scaled(A.rolled(F.col("x"), F.lit(5)), F.lit(0.8)).alias("degraded")
    )
    found = P.pair_validation(rows, no_op=0.5, high_tolerance=2.0)
    return found.select(F.col("degraded_id").cast("long").alias("vec_id"), rounded("relative", "relative"), F.filter("flags", lambda f: f == "no_op").alias("flags"))


@query("""with r as (select *, sum((active and not was)::int) over (partition by user_id order by i) as run from (select *, coalesce(lag(active) over (partition by user_id order by i), false) as was from (select user_id, i, value, value >= 30 as active from (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as i from events)))),
g as (select user_id, run, min(i) * 0.5 as s, least((max(i) + 1) * 0.5, 20.0) as e, avg(value) as mean, max(value) as most from r where active group by user_id, run)
select user_id, round(s::double, 4) as start_sec, round(e::double, 4) as end_sec, round(mean, 6) as mean, most from g where e - s >= 1.0""")
def speech_spans(spark, sf_dir):
    """Intervals of frames at or above a threshold, of at least a second, within the duration."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    frames = table(spark, sf_dir, "events").withColumn("frame", order).withColumn("duration_sec", F.lit(20.0))
    rows = I.speech_intervals(frames, "user_id", "frame", "value", "duration_sec", 0.5, 30.0, 1.0)
    return rows.select("user_id", rounded("start_sec", "start_sec", 4), rounded("end_sec", "end_sec", 4), rounded("mean_probability", "mean"), F.col("max_probability").alias("most"))


_CONFIG = {
    "profiles": [{"name": "legacy", "weight": 2}, {"name": "lossy", "weight": 1, "network_impairment": {"probability": 1.0}}],
    "noise": {"probability": 0.6, "second_scene_probability": 0.3, "snr_buckets": [[0, 10], [10, 25]]},
    "level": {"gain_db": [-6, 6], "clipping": {"enabled": True, "probability": 0.3, "threshold": [0.2, 0.5]}},
    "codec_distribution": [{"codec": "g711_alaw"}, {"codec": "g711_mulaw"}, {"codec": "pass_through", "weight": 2}],
    "channel": {"paths": [{"path": "narrow"}, {"path": "wide"}]},
    "network_impairment": {"probability": 0.2, "loss_rate_buckets": [[0.05, 0.1], [0.1, 0.2]], "burst_length": [1, 3], "frame_ms": 1},
}


@query()
def degraded_items(spark, sf_dir):
    """Every vector through the whole chain of a configuration, with its target; equal seeds give equal rows."""

    def run(parts):
        for part in parts:
            out = []
            for vec_id, x in zip(part["vec_id"], part["x"]):
                noise = {"id": "n", "scene": "s", "samples": x[::-1], "rate": 16000}
                y, target, facts = S.degrade_item(x, 16000, S.stable_seed(7, "train", str(vec_id), 0), _CONFIG, [noise])
                out.append((vec_id, facts["profile"], facts["codec"], facts["channel_path"], facts["snr_db"], facts["observed_loss"], len(y), float(abs(target).max())))
            yield pd.DataFrame(out, columns=["vec_id", "profile", "codec", "path", "snr_db", "observed_loss", "samples", "target_peak"])

    return _waves(spark, sf_dir).mapInPandas(run, "vec_id long, profile string, codec string, path string, snr_db double, observed_loss double, samples long, target_peak double")


@query("select vec_id, label, 'a' as noisy, 'a' as clean from embeddings")
def identical_views(spark, sf_dir):
    """A clean wave as both sides of a pair; the same wave, so the same view."""
    rows = _waves(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", "label", *P.identical_views("x"))
    name = lambda c: F.when(F.col(c) == F.col("clean"), "a").otherwise("b").alias(c)
    return rows.select("vec_id", "label", name("noisy"), name("clean"))
