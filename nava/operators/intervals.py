"""Runs of frames, merged intervals, overlaps, boundaries and greedy clip segmentation."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(frames: DataFrame, key: str, order: str, value: str, threshold: float) -> DataFrame:
    """Islands of frames at or above a threshold: key, run, first, last, frames, mean, most."""
    w = Window.partitionBy(key).orderBy(order)
    active = F.col(value) >= threshold
    change = (active & ~F.coalesce(F.lag(active).over(w), F.lit(False))).cast("int")
    rows = frames.withColumn("__active", active).withColumn("run", F.sum(change).over(w))
    return rows.where("__active").groupBy(key, "run").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"), F.avg(value).alias("mean"), F.max(value).alias("most")
    )


def speech_intervals(frames: DataFrame, key: str, index: str, probability: str, duration: str, hop: float, threshold: float = 0.5, least: float = 0.25) -> DataFrame:
    """Intervals of runs: start_sec, end_sec (not beyond the duration), mean and max; shorter ones go, `least` itself stays."""
    durations = frames.groupBy(key).agg(F.max(duration).alias("__duration"))
    found = runs(frames, key, index, probability, threshold).join(durations, key)
    found = found.withColumn("start_sec", F.col("first") * hop).withColumn("end_sec", F.least((F.col("last") + 1) * hop, F.col("__duration")))
    return found.where(F.col("end_sec") - F.col("start_sec") >= least).select(
        key, "start_sec", "end_sec", F.col("mean").alias("mean_probability"), F.col("most").alias("max_probability")
    )


def islands(intervals: DataFrame, key: str, start: str, end: str, gap: Column | float) -> DataFrame:
    """Adds island: intervals whose distance to all before them is below the gap go together."""
    w = Window.partitionBy(key).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) - reached < gap, 0).otherwise(1)
    return intervals.withColumn("island", F.sum(fresh).over(w))


def merge_pairwise(intervals: DataFrame, key: str, gap: float) -> DataFrame:
    """Merged intervals whose mean is the mean of the mean so far and the next one: a fold in order."""
    rows = islands(intervals, key, "start_sec", "end_sec", gap)
    item = F.struct("start_sec", "end_sec", "mean_probability", "max_probability")
    lists = rows.groupBy(key, "island").agg(F.array_sort(F.collect_list(item)).alias("items"))
    first = F.element_at("items", 1)["mean_probability"]
    folded = F.aggregate(F.slice("items", F.lit(2), F.size("items")), first, lambda m, x: (m + x["mean_probability"]) / 2)
    return lists.select(
        key, F.array_min("items.start_sec").alias("start_sec"), F.array_max("items.end_sec").alias("end_sec"),
        folded.alias("mean_probability"), F.array_max("items.max_probability").alias("max_probability"),
    )


def overlap(left: DataFrame, right: DataFrame, key: str, bucket: float) -> DataFrame:
    """key, start_sec, end_sec of left with the seconds that right's intervals cover. Meeting buckets make it an equi-join."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / bucket), F.floor(e / bucket)))
    a = left.select(key, "start_sec", "end_sec").distinct()
    x = a.withColumn("__cell", cells(F.col("start_sec"), F.col("end_sec")))
    y = right.select(key, F.col("start_sec").alias("s"), F.col("end_sec").alias("e")).withColumn("__cell", cells(F.col("s"), F.col("e")))
    # A pair that meets in several buckets counts in the one where its common part begins.
    begins = F.floor(F.greatest("start_sec", "s") / bucket)
    pairs = x.join(y, [key, "__cell"]).where("start_sec < e and s < end_sec").where(begins == F.col("__cell"))
    sums = pairs.groupBy(key, "start_sec", "end_sec").agg(F.sum(F.least("end_sec", "e") - F.greatest("start_sec", "s")).alias("seconds"))
    return a.join(sums, [key, "start_sec", "end_sec"], "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def silences(intervals: DataFrame, key: str, least: float) -> DataFrame:
    """Gaps between neighbouring intervals: midpoint and gap."""
    w = Window.partitionBy(key).orderBy("start_sec", "end_sec")
    rows = intervals.withColumn("gap", F.lead("start_sec").over(w) - F.col("end_sec"))
    return rows.where(F.col("gap") >= least).select(key, (F.col("end_sec") + F.col("gap") / 2).alias("midpoint"), "gap")


@dataclass(frozen=True)
class Settings:
    """Lengths in seconds; fixed defaults."""

    target: float = 20.0
    least: float = 15.0
    most: float = 25.0
    hard: float = 28.0
    least_speech: float = 2.0
    silence: float = 0.3
    padding: float = 0.15
    search_from: float = 18.0
    window: float = 0.2
    dip_db: float = 6.0

    def __post_init__(self) -> None:
        lengths = (self.target, self.least, self.most, self.hard, self.least_speech, self.silence, self.padding, self.search_from, self.window)
        if not all(math.isfinite(x) and x > 0 for x in lengths):
            raise ValueError("lengths must be finite and positive")
        if not (self.least <= self.target <= self.most <= self.hard and self.least_speech <= self.least and self.search_from < self.most):
            raise ValueError("lengths are out of order")
        if not (math.isfinite(self.dip_db) and self.dip_db >= 0):
            raise ValueError("the dip must be finite and not negative")


Energy = Callable[[float, float, float], tuple[float, float]]


class _Recording:
    """Speech intervals in order, a place among them that only moves on, and the pauses between them by their middles."""

    def __init__(self, speech: list[tuple[float, float]], settings: Settings):
        self.speech, self.settings, self.first = speech, settings, 0
        between = ((left[1] + (right[0] - left[1]) / 2.0, right[0] - left[1]) for left, right in zip(speech, speech[1:]))
        self.pauses = sorted(p for p in between if p[1] >= settings.silence)

    def move(self, at: float) -> float | None:
        """To the first interval that ends behind at. A pause longer than a clip is skipped; None when nothing is left."""
        while self.first < len(self.speech) and self.speech[self.first][1] <= at:
            self.first += 1
        if self.first == len(self.speech):
            return None
        begins = self.speech[self.first][0]
        return max(at, begins - self.settings.padding) if begins - at > self.settings.most else at

    def pause_near(self, wanted: float, low: float, high: float) -> tuple[float, float] | None:
        """Middle and length of the pause nearest to a place, of equally near ones the earlier, within low and high."""
        right = bisect_left(self.pauses, (wanted,))
        near = [p for p in self.pauses[max(0, right - 1) : right + 1] if low <= p[0] <= high]
        return min(near, key=lambda p: (abs(p[0] - wanted), p)) if near else None

    def ends_early(self, low: float, high: float) -> float | None:
        """Where speech ends before low, if no more begins up to high."""
        after = bisect_left(self.speech, (low,), self.first)
        if after == self.first or self.speech[after - 1][1] > low or after < len(self.speech) and self.speech[after][0] <= high:
            return None
        return self.speech[after - 1][1]

    def spoken(self, at: float, end: float) -> float:
        inside = takewhile(lambda x: x[0] < end, islice(self.speech, self.first, None))
        return sum((max(0.0, min(end, stops) - max(at, begins)) for begins, stops in inside), 0.0)


def segment(duration: float, speech: list[tuple[float, float]], settings: Settings = Settings(), energy: Energy | None = None) -> list[dict]:
    """Clips from one source's speech intervals, which don't overlap, cut after cut.

    A cut is where speech ends, where a pause nearest the target length has its middle, at an energy dip, or at the longest
    preferred length. Clips with too little speech are left out. The work is linear in intervals and clips.
    """
    if not math.isfinite(duration) or duration <= 0:
        raise ValueError("the duration must be finite and positive")
    speech = sorted(speech)
    if any(s < 0 or e <= s for s, e in speech):
        raise ValueError("intervals must begin at 0 or later and end after they begin")
    if not speech:
        return []
    own = _Recording(speech, settings)
    last = min(duration, speech[-1][1])
    stop = min(duration, last + settings.padding)
    clips: list[dict] = []
    at = own.move(max(0.0, speech[0][0] - settings.padding))
    while at is not None and at < last:
        end, kind, pause, dip = _cut(own, at, stop, duration, settings, energy)
        end = min(end, duration, at + settings.hard)
        if end <= at:
            raise RuntimeError("a cut didn't advance")
        seconds = own.spoken(at, end)
        if seconds >= settings.least_speech:
            clips.append({
                "start_sec": at, "end_sec": end, "speech_seconds": seconds, "speech_ratio": seconds / (end - at),
                "boundary_type": kind, "boundary_silence_sec": pause, "energy_dip_db": dip,
            })
        at = own.move(end)
    return clips


def _cut(own: _Recording, at: float, stop: float, duration: float, settings: Settings, energy: Energy | None) -> tuple[float, str, float | None, float | None]:
    """End, kind, pause and dip of the clip that begins at at: the first of the possible cuts that there is."""
    if stop - at <= settings.most:
        return stop, "source_end", None, None
    low, high = at + settings.least, min(at + settings.most, duration)
    if (ended := own.ends_early(low, high)) is not None:
        return min(duration, ended + settings.padding), "natural_short", None, None
    if (pause := own.pause_near(at + settings.target, low, high)) is not None:
        return pause[0], "silence", pause[1], None
    end, dip = energy(min(high, at + settings.search_from), high, settings.window) if energy else (high, 0.0)
    return (high, "hard_cut", None, dip) if dip < settings.dip_db else (end, "energy_fallback", None, dip)


SEGMENT_COLUMNS = "start_sec double, end_sec double, speech_seconds double, speech_ratio double, boundary_type string, boundary_silence_sec double, energy_dip_db double"


def segments(intervals: DataFrame, key: str, duration: str, settings: Settings = Settings(), energy: Energy | None = None) -> DataFrame:
    """Clips of every source; each cut depends on the one before, so a source is one group. Its intervals are one recording's."""
    kind = dict(intervals.dtypes)[key]

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        speech = list(zip(rows["start_sec"], rows["end_sec"]))
        out = pd.DataFrame(segment(float(rows[duration].max()), speech, settings, energy))
        if not len(out):
            return pd.DataFrame(columns=[key, *[c.split()[0] for c in SEGMENT_COLUMNS.split(", ")]])
        out.insert(0, key, rows[key].iloc[0])
        return out

    return intervals.select(key, "start_sec", "end_sec", duration).groupBy(key).applyInPandas(own, f"{key} {kind}, {SEGMENT_COLUMNS}")


def pack_batches(lengths: list[float], size: int, budget: float) -> list[list[int]]:
    """Indices in batches, longest first: a batch closes when another row would exceed size, or rows * longest**2 the budget squared."""
    batches: list[list[int]] = []
    longest = 0.0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        own = max(longest, lengths[i])
        if not batches or len(batches[-1]) + 1 > size or (len(batches[-1]) + 1) * own * own > budget * budget:
            batches.append([])
            own = lengths[i]
        longest = own
        batches[-1].append(i)
    return batches


def packed(df: DataFrame, group: str, key: str, length: str, size: int, budget: float) -> DataFrame:
    """group, key, batch by pack_batches within each group."""
    kinds = dict(df.dtypes)

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True)
        out = [(rows[group][0], rows[key][i], b) for b, batch in enumerate(pack_batches(rows[length].tolist(), size, budget)) for i in batch]
        return pd.DataFrame(out, columns=[group, key, "batch"])

    return df.select(group, key, length).groupBy(group).applyInPandas(own, f"{group} {kinds[group]}, {key} {kinds[key]}, batch long")
