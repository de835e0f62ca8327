"""Text expressions: normalization with rejection, identifiers, edit distance, prompts and formats.

All are Column expressions that stay in the JVM; only NFKC, which has no built-in, is an Arrow function, and it is applied where a
pattern shows that a text may change.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nava.functions import edits as E

# Fixed values of the Persian pack: letters that reject a text, ordered replacements, discarded marks.
PERSIAN_REJECT = r"[A-Za-z=āšة]"
PERSIAN_REPLACE = (
    ("أ", "ا"), ("ۀ", "ە"), ("ك", "ک"), ("ي", "ی"), ("ى", "ی"), ("ﯽ", "ی"), ("ﻮ", "و"), ("ے", "ی"), ("ﺒ", "ب"), ("ﻢ", "ﻡ"), ("٬", " "), ("ە", "ه"),
)
PERSIAN_DISCARD_WORD = "(خنده)"
PERSIAN_DISCARD = "!\"#&'(),-.:;–¬“”…؟،؛ـًٌَُِّْٔ«»"

#: Fixed values of the Latin pack, for texts in Latin letters: digits and '=' reject.
LATIN_REJECT = r"[0-9=]"
LATIN_REPLACE = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("’", "'"))
LATIN_DISCARD = "!\"#&'(),-.:;–¬“”…«»"

SPACES = r"(?U)\s+"


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def squeeze_zwnj(text: Column) -> Column:
    """As squeeze, with the zero-width non-joiner as a space."""
    return squeeze(F.translate(text, "‌", " "))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return texts.str.normalize("NFKC")


#: Texts of these characters alone don't change under NFKC.
STABLE = r"^[\x00-\x7FÀ-ıĴ-ľŁ-ňŊ-žء-ي٠-٩پ-ۓ۰-۹‌]*$"


def needs_nfkc(text: Column) -> Column:
    return ~text.rlike(STABLE)


def drop_hash_words(text: Column) -> Column:
    """Words that begin with # go."""
    return F.array_join(F.filter(F.split(squeeze(text), " "), lambda w: ~w.startswith("#")), " ")


def strip_punctuation(text: Column) -> Column:
    """Category P goes, symbols stay; white space is squeezed."""
    return squeeze(F.regexp_replace(text, r"\p{P}", ""))


def normalize(text: Column, reject: str, replace: tuple[tuple[str, str], ...], discard: str, discard_word: str | None = None, compose: bool = False) -> Column:
    """Normalized text, or null where a rejected character occurs. The empty text isn't null."""
    out = drop_hash_words(text)
    out = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), replace, out)
    if discard_word:
        out = F.replace(out, F.lit(discard_word), F.lit(""))
    out = F.translate(out, discard, "")
    if compose:
        out = F.when(needs_nfkc(out), nfkc(out)).otherwise(out)
        out = F.translate(out, "ء", "")
    return F.when(~text.rlike(reject), strip_punctuation(out))


def normalize_persian(text: Column) -> Column:
    return normalize(text, PERSIAN_REJECT, PERSIAN_REPLACE, PERSIAN_DISCARD, PERSIAN_DISCARD_WORD, compose=True)


def normalize_latin(text: Column) -> Column:
    return normalize(text, LATIN_REJECT, LATIN_REPLACE, LATIN_DISCARD)


def with_fallback(text: Column, normalized: Column, keep: Column) -> Column:
    """The normalized text; where it was rejected and keep holds, the raw text without punctuation; else null."""
    return F.coalesce(normalized, F.when(keep, strip_punctuation(text)))


def safe_id(text: Column, default: str = "source", most: int = 96) -> Column:
    """ASCII letters, digits, dot, underscore and hyphen; other runs become a hyphen; ends are trimmed."""
    cleaned = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), F.lit("-._"))
    return F.substring(F.when(F.length(cleaned) > 0, cleaned).otherwise(default), 1, most)


def generated_id(text: Column) -> Column:
    return F.concat(safe_id(text), F.lit("-"), F.substring(F.sha2(text, 256), 1, 10))


def pair_id(split: Column, clip: Column, variant: Column) -> Column:
    return F.concat(split, F.lit("_"), clip, F.lit("_v"), variant.cast("string"))


def item_id(split: Column, path: Column, index: Column) -> Column:
    """split-stem-000001"""
    return F.concat_ws("-", split, stem(path), F.lpad(index.cast("string"), 6, "0"))


def prefixed_id(prefix: str, value: Column) -> Column:
    """prefix-value, unless the value has the prefix."""
    return F.when(value.startswith(prefix), value).otherwise(F.concat(F.lit(f"{prefix}-"), value))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^./]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def scene_of(path: Column) -> Column:
    """The folder whose name ends in _16K, without that ending; else the parent folder's name."""
    parts = F.split(path, "/")
    named = F.get(F.filter(parts, lambda x: F.upper(x).endswith("_16K")), F.lit(0))
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return F.coalesce(F.regexp_replace(named, "(?i)_16k$", ""), parent)


def unsafe_path(path: Column, root: str = "clips/") -> Column:
    """Absolute paths, paths with .. and paths outside root."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | ~path.startswith(root)


def edit_distance(a: Column, b: Column) -> Column:
    """Character edits over the longer length; 0 for equal texts, 1 if only one is empty."""
    return E.distance(a, b)


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Word edits of two texts, whatever their number of distinct words."""
    return E.word_edits(squeeze(reference), squeeze(hypothesis))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(text), " "), lambda w: w != ""))


def number_tokens(text: Column, strict: bool = False) -> Column:
    """Runs of digits of any script; strict counts superscript and circled digits too."""
    own = r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨" if strict else r"\p{Nd}"
    return F.regexp_extract_all(text, F.lit(f"([{own}]+)"), F.lit(1))


def human_bytes(size: Column) -> Column:
    """1023 B, 1.5 KB, 2.0 MB, ... with one decimal."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return out


def checksum(text: Column) -> Column:
    """algorithm:hex in lower case from a prefixed or bare digest; null for anything else."""
    low = F.lower(F.trim(text))
    bare = F.regexp_replace(low, "^(sha256|md5):", "")
    fits = lambda n: bare.rlike(f"^[0-9a-f]{{{n}}}$")
    return F.when(fits(64) & ~low.startswith("md5:"), F.concat(F.lit("sha256:"), bare)).when(
        fits(32) & ~low.startswith("sha256:"), F.concat(F.lit("md5:"), bare)
    )


def bitrate(text: Column) -> Column:
    """Bits a second from texts such as 16k, 128 kbps, 12200; null without a number."""
    number = F.regexp_extract(F.lower(text), r"(\d+(?:\.\d+)?)\s*(k?)", 1)
    kilo = F.regexp_extract(F.lower(text), r"(\d+(?:\.\d+)?)\s*(k?)", 2)
    return F.when(number != "", (number.cast("double") * F.when(kilo == "k", 1000).otherwise(1)).cast("long"))


def gib_bytes(text: Column) -> Column:
    """Bytes of a decimal number of GiB, exact and cut off."""
    return F.floor(F.try_to_number(text, F.lit("999999999D999999999")).cast("decimal(28,9)") * F.lit(2**30).cast("decimal(10,0)")).cast("long")


def prompt(title: Column, description: Column, before: Column, target: Column, after: Column) -> Column:
    """The refinement prompt: metadata, context before and after, and the target."""
    joined = lambda c: F.when(F.size(c) == 0, F.lit("(none)")).otherwise(F.array_join(c, "\n"))
    return F.concat(
        F.lit("Title: "), F.coalesce(title, F.lit("(omitted)")), F.lit("\nDescription: "), F.coalesce(description, F.lit("(omitted)")),
        F.lit("\nPreceding:\n"), joined(before), F.lit("\nTarget:\n"), target, F.lit("\nFollowing:\n"), joined(after),
    )


def error_text(body: Column, fallback: str) -> Column:
    """A JSON body's error, else its text, else the fallback."""
    return F.coalesce(F.expr("null") if body is None else F.get_json_object(F.when(F.is_variant_null(F.try_parse_json(body)) == False, body), "$.error"), F.nullif(F.trim(body), F.lit("")), F.lit(fallback))  # noqa: E712


def split_name(text: Column, suffix: str = ".tsv") -> Column:
    return F.when(text.endswith(suffix), text).otherwise(F.concat(text, F.lit(suffix)))


#: Exclusion rules in order; the first that matches decides.
EPISODE_RULES = (
    ("explicit_music", ("موسیقی", "ترانه", "آهنگ", "تصنیف", "کنسرت")),
    ("explicit_recitation", ("تلاوت", "ترتیل", "قرائت قرآن", "جزء خوانی", "جزءخوانی")),
    ("advertisement_or_promo", ("پیام بازرگانی", "آگهی", "تبلیغ", "تیزر", "پرومو")),
    ("station_filler", ("میان برنامه", "میان‌برنامه", "شناسه شبکه", "اعلام برنامه", "پخش برنامه های")),
    ("non_persian", ("به زبان عربی", "به زبان انگلیسی", "به زبان کردی", "به زبان ترکی", "به زبان آذری")),
)


def first_rule(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str = "broad_speech_default") -> Column:
    """The reason of the first rule of which a keyword occurs."""
    out = F.lit(default)
    for reason, keywords in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords]), reason).otherwise(out)
    return out


#: Stations by number.
STATION_RANGES = ((11, 29), (50, 66), (101, 203), (501, 538))
STATION_EXCLUDED = (
    ("15", "explicit_recitation_station"), ("21", "explicit_music_station"), ("101", "explicit_recitation_station"), ("201", "non_persian_station"),
    ("202", "non_persian_station"), ("203", "explicit_recitation_station"), ("901", "non_persian_station"), ("902", "non_persian_station"),
)
VISUAL_RANGE = (50, 66)
VISUAL_NAME = r"رادیو\s*نما(?:\s|[-–—]|$)"


def station_reason(station: Column, name: Column, overrides: list[str] | None = None) -> Column:
    """included_default, included_override, a reason of exclusion, or null for numbers outside the ranges."""
    if overrides:
        return F.when(station.isin(overrides), F.lit("included_override"))
    number = station.try_cast("int")
    inside = reduce(lambda a, b: a | b, [number.between(*r) for r in STATION_RANGES])
    out = F.lit("included_default")
    for own, reason in STATION_EXCLUDED:
        out = F.when(station == own, reason).otherwise(out)
    out = F.when(number.between(*VISUAL_RANGE) | name.rlike(VISUAL_NAME), "radio_visual_station").otherwise(out)
    return F.when(inside, out)


def unknown_overrides(stations: DataFrame, station: str, overrides: list[str]) -> DataFrame:
    """Override numbers that no station has; an empty result is a pass."""
    wanted = stations.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(overrides)], f"{station} string")
    return wanted.join(stations.select(F.col(station).cast("string").alias(station)), station, "left_anti")


def built_url(base: str, parts: list[Column], parameters: dict[str, Column]) -> Column:
    """A URL of a base, quoted path parts and quoted parameters; spaces are quoted as in forms' successors (%20)."""
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    path = F.concat_ws("/", F.lit(base.rstrip("/")), *map(quoted, parts))
    query = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), quoted(v)) for k, v in parameters.items()])
    return F.concat(path, F.lit("?"), query) if parameters else path
