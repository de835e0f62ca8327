"""Error rates, distributions, summaries and audits: partial aggregates, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nava.functions import edits as E
from nava.functions import text as T


def error_counts(df: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """Adds word and character edits and the reference's words and characters, of whole texts with white space squeezed."""
    rows = df.withColumn("__counts", E.counted(T.squeeze(reference), T.squeeze(hypothesis)))
    return rows.select(*df.columns, "__counts.*")


def error_rates(df: DataFrame, *groups: str, overall: bool = False) -> DataFrame:
    """Examples, wer, cer by group: edits over reference units of the whole group. overall adds a row of all, in the same pass."""
    rate = lambda e, n: F.when(F.sum(n) > 0, F.sum(e) / F.sum(n)).otherwise(F.when(F.sum(e) > 0, 1.0).otherwise(0.0))
    grouped = df.rollup(*groups) if overall else df.groupBy(*groups)
    return grouped.agg(F.count("*").alias("examples"), rate("word_edits", "words").alias("wer"), rate("char_edits", "chars").alias("cer"))


def value_counts(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """dimension, value, rows: one pass over the table; empty, zero and null values are "none"."""
    pairs = [F.struct(F.lit(n).alias("dimension"), F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), "none").otherwise(c.cast("string")).alias("value")) for n, c in dimensions.items()]
    return df.select(F.explode(F.array(*pairs)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("rows"))


def summary(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """count, mean, median, p10, p90, least, most; percentiles interpolate and are exact."""
    p = lambda q: F.percentile(value, F.lit(q))
    return df.groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), p(0.5).alias("median"), p(0.1).alias("p10"), p(0.9).alias("p90"),
        F.min(value).alias("least"), F.max(value).alias("most"),
    )


def hours(df: DataFrame, seconds: str, error: Column, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(
        (F.sum(F.when(~error, F.col(seconds))) / 3600).alias("hours"), F.count_if(~error).alias("ok"), F.count_if(error).alias("failed")
    )


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))


def captured(identity: Column, distance: Column) -> Column:
    """The share of the identity's distance that is gone; 0 where there was none."""
    return F.when(identity <= 0, 0.0).otherwise((identity - distance) / identity)


def grouped_means(df: DataFrame, sets: list[list[str]], identity: str, distance: str) -> DataFrame:
    """Means at several granularities in one pass; `level` names the columns of a row's grouping."""
    columns = sorted({c for s in sets for c in s})
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    level = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    means = grouped.agg(F.count("*").alias("rows"), F.avg(identity).alias("identity"), F.avg(distance).alias("distance"), level.alias("level"))
    return means.withColumn("captured", captured(F.col("identity"), F.col("distance")))


def macro_batch_mean(df: DataFrame, batch: Column, value: str) -> DataFrame:
    """The mean of batch means; a short last batch weighs as much as the others."""
    return df.groupBy(batch.alias("batch")).agg(F.avg(value).alias("mean")).agg(F.avg("mean").alias("macro_mean"))


def usage(df: DataFrame, weight: str) -> DataFrame:
    other = 1 - F.col(weight)
    return df.agg(F.avg(weight).alias("mean"), F.median(weight).alias("median"), F.avg(other).alias("other_mean"), F.median(other).alias("other_median"))


def audit(df: DataFrame, *groups: str, **counts: Column) -> DataFrame:
    """Named conditional counts in one pass."""
    return df.groupBy(*groups).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def best(df: DataFrame, key: str, score: str, *groups: str) -> DataFrame:
    """The key of the lowest score; of equal scores the smallest key."""
    return df.groupBy(*groups).agg(F.min_by(key, F.struct(score, key)).alias(key), F.min(score).alias(score))


def space_saved(df: DataFrame, before: str, after: str) -> DataFrame:
    saved = F.sum(before) - F.sum(after)
    return df.agg(saved.alias("saved"), F.when(F.sum(before) > 0, 100 * saved / F.sum(before)).otherwise(0.0).alias("percent"))


def common(df: DataFrame, column: str) -> DataFrame:
    """Values by falling count, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), column)


def no_leak(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows in more than one split; empty if nothing leaks."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def throughput(df: DataFrame, items: str, seconds: str, *groups: str) -> DataFrame:
    """Items a second of whole groups; null where no time passed."""
    return df.groupBy(*groups).agg(F.when(F.sum(seconds) > 0, F.sum(items) / F.sum(seconds)).alias("rate"))


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounded, halves to the even digit, by the number's shortest decimal text."""
    return F.bround(value, digits)
