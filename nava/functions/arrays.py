"""Waveforms as arrays of doubles: level, scale, mix and distance, in the JVM.

Sums run over the array in order, so results repeat exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def clean(x: Column) -> Column:
    """NaN becomes 0, infinities the largest finite values of a float."""
    top = 3.4028234663852886e38
    return F.transform(x, lambda v: F.when(F.isnan(v), 0.0).otherwise(F.greatest(F.least(v, F.lit(top)), F.lit(-top))))


def rms(x: Column) -> Column:
    """Root mean square with 1e-12 inside the root; 0 of an empty array."""
    return F.when(F.size(x) == 0, 0.0).otherwise(F.sqrt(squares(x) / F.size(x) + 1e-12))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def scaled(x: Column, factor: Column) -> Column:
    return F.transform(x, lambda v: v * factor)


def peak_scale(x: Column, most: float = 0.99) -> Column:
    """The factor that brings the peak down to most; never up."""
    return F.when(peak(x) > most, F.lit(most) / peak(x)).otherwise(1.0)


def pair_peak_scale(a: Column, b: Column, most: float = 0.5) -> Column:
    """One factor for both, from the larger peak."""
    return peak_scale(F.concat(a, b), most)


def rms_gain(x: Column, target: float = 0.05, most: float = 20.0) -> Column:
    """The gain to a target level, at most `most`; silence keeps its level."""
    return F.when(rms(x) <= 1e-6, 1.0).otherwise(F.least(F.lit(target) / rms(x), F.lit(most)))


def mix_at_snr(speech: Column, noise: Column, snr_db: Column | float) -> Column:
    gain = rms(speech) / (rms(noise) * F.pow(F.lit(10.0), F.lit(snr_db) / 20 if not isinstance(snr_db, Column) else snr_db / 20))
    return F.zip_with(speech, noise, lambda s, v: s + v * gain)


def fit_length(x: Column, n: Column | int) -> Column:
    """Cut or padded with zeros on the right."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(x), F.lit(0)))), F.lit(1), n)


def repeat_or_crop(x: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    times = F.ceil(n / F.greatest(F.size(x), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(x, times)), F.lit(1), n)


def gained(x: Column, db: float) -> Column:
    factor = 10 ** (db / 20)
    return F.transform(x, lambda v: v * factor)


def hard_clip(x: Column, level: float) -> Column:
    return F.transform(x, lambda v: F.greatest(F.least(v, F.lit(level)), F.lit(-level)))


def clipped_fraction(x: Column, level: float) -> Column:
    """Samples strictly above the level, of all."""
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.filter(x, lambda v: F.abs(v) > level)) / F.size(x))


def mono(channels: Column) -> Column:
    """The mean of an array of channels, sample by sample."""
    added = F.aggregate(channels, F.transform(F.element_at(channels, 1), lambda v: v * 0.0), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    return F.transform(added, lambda v: v / F.size(channels))


def shifted(x: Column, lag: Column) -> Column:
    """Moved right by lag samples (left if negative), zeros coming in; same length."""
    n = F.size(x)
    right = F.slice(F.concat(F.array_repeat(F.lit(0.0), F.greatest(lag, F.lit(0))), x), F.lit(1), n)
    left = fit_length(F.slice(x, F.least(F.abs(lag), n).cast("int") + 1, n), n)
    return F.when(lag >= 0, right).otherwise(left)


def rolled(x: Column, lag: Column) -> Column:
    """Circular shift to the right by lag."""
    n = F.size(x)
    k = F.pmod(lag, F.greatest(n, F.lit(1))).cast("int")
    return F.concat(F.slice(x, n - k + 1, k), F.slice(x, F.lit(1), n - k))


def common(a: Column, b: Column) -> tuple[Column, Column]:
    """Both cut to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def l1(a: Column, b: Column) -> Column:
    """Mean distance over the common length; 0 without samples."""
    x, y = common(a, b)
    return F.when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(total(F.zip_with(x, y, lambda p, q: F.abs(p - q))) / F.least(F.size(a), F.size(b)))


def relative_l2(a: Column, b: Column) -> Column:
    """|a - b| over |a|, with 1e-12 below, over the common length."""
    x, y = common(a, b)
    return F.sqrt(squares(F.zip_with(x, y, lambda p, q: p - q))) / (F.sqrt(squares(x)) + 1e-12)


def waveform_snr(clean_: Column, other: Column, lag: Column) -> Column:
    """Decibels of the clean signal, shifted circularly by the lag, over the difference; 0 for silence."""
    x, y = common(rolled(clean_, lag), other)
    level, noise = squares(x), squares(F.zip_with(x, y, lambda p, q: q - p)) + 1e-12
    return F.when(level <= 1e-12, 0.0).otherwise(10 * F.log10(level / noise))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Equal lengths and no sample further apart than the tolerance."""
    return (F.size(a) == F.size(b)) & (F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0)) <= tolerance)


def frames(x: Column, size: int) -> Column:
    """Frames of a fixed size, the last padded with zeros."""
    n = F.ceil(F.size(x) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: fit_length(F.slice(x, i * size + 1, F.lit(size)), size))


def ctc_collapse(tokens: Column, blank: Column) -> Column:
    """Repeats go, then blanks."""
    return F.filter(tokens, lambda v, i: (v != blank) & ((i == 0) | (v != F.coalesce(F.get(tokens, i - 1), blank))))


def low_energy_boundary(x: Column, rate: int, start: Column, window: float = 0.2) -> Column:
    """struct(at, dip_db): the quietest window's middle, windows a quarter apart with the last offset forced, and how far it lies below the median."""
    size = max(1, int(window * rate))
    step = max(1, size // 4)
    last = F.greatest(F.size(x) - size, F.lit(0))
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    levels = F.transform(offsets, lambda o: F.struct(rms(F.slice(x, o + 1, F.lit(size))).alias("level"), o.alias("offset")))
    sorted_levels = F.array_sort(levels)
    n = F.size(levels)
    level_at = lambda i: F.element_at(sorted_levels, i)["level"]
    median = (level_at(F.floor((n + 1) / 2).cast("int")) + level_at(F.floor((n + 2) / 2).cast("int"))) / 2
    least = F.element_at(sorted_levels, 1)
    dip = F.greatest(F.lit(0.0), 20 * F.log10(median / least["level"]))
    return F.struct((start + (least["offset"] + size / 2) / rate).alias("at"), dip.alias("dip_db"))


def tensor_stats(x: Column) -> Column:
    """struct(finite, least, most, mean, peak) over finite values."""
    good = F.filter(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.struct(
        (F.size(good) / F.size(x)).alias("finite"), F.array_min(good).alias("least"), F.array_max(good).alias("most"),
        (total(good) / F.size(good)).alias("mean"), peak(good).alias("peak"),
    )


def crop(x: Column, width: int, unit: Column) -> Column:
    """width items from a start drawn by a number in [0, 1); arrays that aren't longer stay whole."""
    start = F.floor(unit * (F.size(x) - width + 1)).cast("int")
    return F.when(F.size(x) <= width, x).otherwise(F.slice(x, F.greatest(start, F.lit(0)) + 1, F.lit(width)))


def drop_frames(x: Column, lost: Column, frame: int) -> Column:
    """Frames that a mask names are silent; a mask that is too short loses nothing behind its end."""
    return F.transform(x, lambda v, i: F.when(F.coalesce(F.get(lost, F.floor(i / frame).cast("int")), F.lit(False)), 0.0).otherwise(v))


def collated(df: DataFrame, batch: str, column: str, pad: float | int) -> DataFrame:
    """Arrays padded on the right to the longest of their batch, and valid: the number of their own items."""
    most = F.max(F.size(column)).over(Window.partitionBy(batch))
    rows = df.withColumn("valid", F.size(column)).withColumn("__most", most)
    fill = F.array_repeat(F.lit(pad), F.col("__most") - F.col("valid"))
    return rows.withColumn(column, F.concat(column, fill)).drop("__most")
