"""Constraints: each gives the rows that break it, so an empty result is a pass; require() raises instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nava.functions import text as T


class ConstraintError(ValueError):
    """A constraint is broken; the message has a few of the rows."""


def require(broken: DataFrame, message: str) -> None:
    if rows := broken.take(5):
        raise ConstraintError(f"{message}: {[r.asDict() for r in rows]}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def blank(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNull() | (F.length(F.trim(F.col(key).cast("string"))) == 0))


def collisions(df: DataFrame, source: str, target: Column) -> DataFrame:
    """Targets that different sources would share."""
    return df.groupBy(target.alias("target")).agg(F.countDistinct(source).alias("sources")).where("sources > 1")


def safe_id_collisions(df: DataFrame, key: str) -> DataFrame:
    return collisions(df, key, T.safe_id(F.col(key)))


def not_positive(df: DataFrame, column: str) -> DataFrame:
    """Null, NaN, infinite, zero or negative values."""
    c = F.col(column).cast("double")
    return df.where(~F.coalesce((c > 0) & ~F.isnan(c) & (c < float("inf")), F.lit(False)))


def orphans(children: DataFrame, parents: DataFrame, on: list[str] | str) -> DataFrame:
    return children.join(parents, on, "left_anti")


def invalid_weights(df: DataFrame, weight: str) -> DataFrame:
    """One row if a distribution is empty, has a negative weight or adds up to nothing."""
    facts = df.agg(F.count("*").alias("rows"), F.min(weight).alias("least"), F.sum(weight).alias("total"))
    return facts.where("rows = 0 or least < 0 or total <= 0 or total is null")


def missing_fields(*names: str) -> Column:
    """Names of the columns that are null, as an array."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))


def flags(**conditions: Column) -> Column:
    """Names of the conditions that hold, as an array in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def first_reason(*pairs: tuple[str, Column], default: str | None = None) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(default).cast("string")
    for name, condition in reversed(pairs):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def completed(day: Column, start: Column, minutes: Column, now: Column) -> Column:
    """Whether an entry that starts on a day at H:M and lasts some minutes is over; what can't be read isn't."""
    begins = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), start), F.lit("yyyy-MM-dd H:mm"))
    return F.coalesce(begins + F.make_dt_interval(mins=minutes.cast("int")) <= now, F.lit(False))


def allowed_url(url: Column, hosts: list[str], path_prefixes: list[str] | None = None) -> Column:
    """https, a listed host, no user or port, and one of the path prefixes."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    good = (part("PROTOCOL") == "https") & part("HOST").isin(hosts) & part("USERINFO").isNull() & ~F.coalesce(part("AUTHORITY"), F.lit("")).rlike(r":\d+$")
    if path_prefixes:
        begins = F.lit(False)
        for p in path_prefixes:
            begins = begins | F.coalesce(part("PATH"), F.lit("")).startswith(p)
        good = good & begins
    return F.coalesce(good, F.lit(False))


def duration_window(df: DataFrame, column: str, least: float, most: float) -> DataFrame:
    return df.where(F.col(column).between(least, most))


def split_by_limit(df: DataFrame, size: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows within a size limit, and the others with their reason."""
    return df.where(size <= most), df.where(~F.coalesce(size <= most, F.lit(False))).withColumn("reason", F.lit("too_long"))


def upload_reason(extension: Column, size: Column, seconds: Column, extensions: list[str], most_bytes: int, most_seconds: float) -> Column:
    """Why an upload is refused, or null."""
    return first_reason(
        ("extension", ~F.coalesce(F.lower(extension).isin(extensions), F.lit(False))), ("empty", F.coalesce(size, F.lit(0)) <= 0),
        ("size", size > most_bytes), ("duration", ~F.coalesce((seconds > 0) & (seconds <= most_seconds), F.lit(False))),
    )


def digits(text: Column) -> Column:
    """The text if it is digits only, else null."""
    return F.when(text.rlike(r"^\d+$"), text)


#: What the codecs need; "drawn" fits either path.
CODEC_PATHS = {
    "g711_alaw": "narrow", "g711_mulaw": "narrow", "gsm": "narrow", "amr_nb": "narrow", "opus_nb": "narrow", "amr_wb": "wide", "opus_wb": "wide", "pass_through": "drawn",
}


def codec_fits(codec: Column, path: Column) -> Column:
    """Whether a codec may stand in a channel path; unknown codecs don't."""
    needed = F.try_element_at(F.create_map(*[F.lit(x) for pair in CODEC_PATHS.items() for x in pair]), codec)
    return F.coalesce((needed == path) | (needed == "drawn"), F.lit(False))


def unequal_reason(*pairs: tuple[str, Column]) -> Column:
    """The name of the first condition that doesn't hold; what is unknown doesn't. Null if all hold."""
    return first_reason(*[(name, ~F.coalesce(condition, F.lit(False))) for name, condition in pairs])
