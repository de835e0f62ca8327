"""Values from web pages and URLs, by patterns; entities beyond the five basic ones need unescape()."""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nava.functions import text as T


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All HTML character references."""
    return texts.map(entities.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def absolute_url(bases: pd.Series, links: pd.Series) -> pd.Series:
    """A link resolved against its page."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(bases, links)])


def basic_unescape(text: Column) -> Column:
    """&lt; &gt; &quot; &#39; &nbsp; and last &amp;"""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_tags(text: Column) -> Column:
    return T.squeeze(basic_unescape(F.regexp_replace(text, r"<[^>]+>", " ")))


def element_text(page: Column, tag: str) -> Column:
    """The text of the first element of this name; null without one or without text."""
    return F.nullif(strip_tags(F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))


def meta(page: Column, key: str) -> Column:
    """content of the first meta element whose property or name is key, in any order of attributes."""
    tags = F.regexp_extract_all(page, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1))
    own = F.filter(tags, lambda t: t.rlike(rf"(?i)\b(?:property|name)=[\"']{key}[\"']"))
    return F.nullif(basic_unescape(F.regexp_extract(F.get(own, F.lit(0)), r"(?i)\bcontent=[\"']([^\"']*)[\"']", 1)), F.lit(""))


def title(page: Column) -> Column:
    """h1, else og:title, else title."""
    return F.coalesce(element_text(page, "h1"), meta(page, "og:title"), element_text(page, "title"))


def links(page: Column) -> Column:
    """Distinct link targets in page order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"(?i)href=[\"']([^\"']+)"), F.lit(1)))


def list_items(page: Column) -> Column:
    items = F.regexp_extract_all(page, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    return F.transform(items, strip_tags)


def field_values(page: Column, label: str) -> Column:
    """Distinct values of a labelled dd: its anchors' texts, else its text cut at commas."""
    body = F.regexp_extract(page, rf"(?is)<dt[^>]*>\s*{label}\s*:?\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1)
    anchors = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), strip_tags)
    plain = F.transform(F.split(strip_tags(body), "[،,]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.when(F.size(anchors) > 0, anchors).otherwise(plain), lambda x: x != ""))


def download_link(page: Column, word: str = "mp3") -> Column:
    """struct(url, size) of the first anchor whose text holds the word."""
    anchors = F.regexp_extract_all(page, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    own = F.get(F.filter(anchors, lambda a: F.lower(strip_tags(a)).contains(word)), F.lit(0))
    return F.struct(
        F.nullif(F.regexp_extract(own, r"(?i)href=[\"']([^\"']+)", 1), F.lit("")).alias("url"),
        F.nullif(F.regexp_extract(strip_tags(own), r"(?i)(\d+(?:\.\d+)?\s*[KMG]B)", 1), F.lit("")).alias("size"),
    )


def blocks_after(page: Column, marker: str) -> Column:
    """What follows each match of a pattern, up to the next one."""
    return F.slice(F.split(page, marker), F.lit(2), F.size(F.split(page, marker)))


def query_value(url: Column, key: str, digits: bool = False) -> Column:
    value = F.try_parse_url(url, F.lit("QUERY"), F.lit(key))
    return F.when(value.rlike(r"^\d+$"), value) if digits else value


def normalized_url(url: Column) -> Column:
    """Without fragment; null with a user, a port, or another scheme than http and https."""
    bare = F.regexp_replace(url, "#.*$", "")
    authority = F.try_parse_url(bare, F.lit("AUTHORITY"))
    good = F.lower(F.try_parse_url(bare, F.lit("PROTOCOL"))).isin("http", "https") & ~authority.contains("@") & ~authority.rlike(r":\d+$")
    return F.when(good, bare)


def book_page(page: Column) -> Column:
    """struct(title, description, authors, tracks): tracks are list items with a length, samples and full books marked."""
    items = F.regexp_extract_all(page, F.lit(r"(?is)(<li\b[^>]*>.*?</li>)"), F.lit(1))
    lengths = F.filter(items, lambda i: strip_tags(i).rlike(r"\d+:\d{2}"))

    def track(item: Column) -> Column:
        text = strip_tags(item)
        return F.struct(
            F.nullif(F.regexp_extract(item, r"(?i)href=[\"']([^\"']+)", 1), F.lit("")).alias("url"), text.alias("label"),
            F.regexp_extract(text, r"(\d+(?::\d{2}){1,2})", 1).alias("length"),
            text.rlike("(?i)sample|نمونه").alias("is_sample"), text.rlike("(?i)full|کامل").alias("is_full"),
        )

    return F.struct(title(page).alias("title"), meta(page, "og:description").alias("description"), field_values(page, "(?:Author|نویسنده)").alias("authors"), F.transform(lengths, track).alias("tracks"))


def audio_candidates(page: Column) -> Column:
    """Sources of audio elements: a JSON list in data-sources, with entities, or a src."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)(<audio\b[^>]*>)"), F.lit(1))
    listed = F.flatten(F.transform(tags, lambda t: F.coalesce(F.from_json(basic_unescape(F.regexp_extract(t, r"(?is)data-sources=[\"']([^\"']*)[\"']", 1)), "array<struct<src:string,label:string>>"), F.array().cast("array<struct<src:string,label:string>>"))))
    plain = F.transform(tags, lambda t: F.struct(F.nullif(F.regexp_extract(t, r"(?i)\bsrc=[\"']([^\"']+)", 1), F.lit("")).alias("src"), F.lit(None).cast("string").alias("label")))
    return F.filter(F.concat(listed, plain), lambda x: x["src"].isNotNull())


#: Roles of the people that a page names.
ROLES = r"(تهیه\s*کننده|تهیه‌کننده|گوینده|کارشناس|مهمان|مجری|سردبیر|نویسنده)"


def _described(page: Column) -> Column:
    """The longest of a page's descriptions, of equally long ones the first; "" without one."""
    found = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<p\b[^>]*itemprop=[\"']description[\"'][^>]*>(.*?)</p>"), F.lit(1)), strip_tags)
    ordered = F.array_sort(F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.coalesce(F.get(ordered, F.lit(0))["t"], F.lit(""))


def _heading(page: Column) -> Column:
    return F.nullif(strip_tags(F.regexp_extract(page, r"(?is)<h1\b[^>]*itemprop=[\"']name[\"'][^>]*>(.*?)</h1>", 1)), F.lit(""))


def program_page(page: Column) -> Column:
    """struct(title, description): the named heading, else the page's title; the longest description."""
    return F.struct(F.coalesce(_heading(page), element_text(page, "title"), F.lit("")).alias("title"), _described(page).alias("description"))


def archive_page(page: Column, title: Column) -> Column:
    """struct(title, program_id, program_url, mp3_url, description, people): the entry's title stands in for a missing heading."""
    program = r"""(?i)href=["']([^"']*/Program/\?[^"']*\bm=(\d+)[^"']*)["']"""
    part = lambda k: F.nullif(F.regexp_extract(page, program, k), F.lit(""))
    pattern = ROLES + r"\s*:?\s*(?:</?[^>]*>)?\s*([^<]{2,200})"
    named = F.transform(
        F.regexp_extract_all(page, F.lit(f"(?i)({pattern})"), F.lit(1)),
        lambda t: F.concat(T.squeeze(F.regexp_extract(t, pattern, 1)), F.lit(": "), T.squeeze(basic_unescape(F.regexp_extract(t, pattern, 2)))),
    )
    return F.struct(
        F.coalesce(_heading(page), title).alias("title"), part(2).alias("program_id"), basic_unescape(part(1)).alias("program_url"),
        basic_unescape(download_link(page, "mp3")["url"]).alias("mp3_url"), _described(page).alias("description"), F.array_join(F.array_distinct(named), " | ").alias("people"),
    )


def robots_allow(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether a path may be read by a site's rules ("allow" or "disallow", pattern): the longest pattern that fits decides, allow on a tie.

    In patterns * stands for any characters and a last $ for the path's end; an empty pattern is no rule.
    """
    used = sorted(((p, kind) for kind, p in rules if p), key=lambda r: (-len(r[0]), r[1]))
    out = F.lit(True)
    for pattern, kind in reversed(used):
        ends = pattern.endswith("$")
        text = ".*".join(map(re.escape, (pattern[:-1] if ends else pattern).split("*")))
        out = F.when(path.rlike(f"^{text}{'$' if ends else ''}"), kind == "allow").otherwise(out)
    return out


def confirm_url(page: Column, base: Column) -> Column:
    """The address behind a download's confirmation page: its form's action with the hidden fields as parameters; null without a form."""
    form = F.regexp_extract(page, r"(?is)(<form\b[^>]*>.*?</form>)", 1)
    action = F.nullif(basic_unescape(F.regexp_extract(form, r"(?i)<form\b[^>]*\baction=[\"']([^\"']+)", 1)), F.lit(""))
    fields = F.filter(F.regexp_extract_all(form, F.lit(r"(?i)(<input\b[^>]*>)"), F.lit(1)), lambda t: t.rlike(r"(?i)\btype=[\"']hidden[\"']"))
    part = lambda t, name: basic_unescape(F.regexp_extract(t, rf"(?i)\b{name}=[\"']([^\"']*)[\"']", 1))
    pairs = F.transform(fields, lambda t: F.concat(F.url_encode(part(t, "name")), F.lit("="), F.url_encode(part(t, "value"))))
    return F.when(action.isNotNull(), F.concat(absolute_url(base, action), F.lit("?"), F.array_join(pairs, "&")))


def content_problem(kind: Column, size: Column, allowed: list[str]) -> Column:
    """Why a response is no file of the wanted kinds: its type without parameters isn't listed, or it is empty; null if it is one."""
    bare = F.lower(F.trim(F.split_part(F.coalesce(kind, F.lit("")), F.lit(";"), F.lit(1))))
    return F.when(~bare.isin([a.lower() for a in allowed]), "content_type").when(F.coalesce(size, F.lit(0)) <= 0, "empty")
