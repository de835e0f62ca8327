"""Sources: delimited text, JSON lines, line patterns, listings, archives, sheets, feeds and PCM audio.

Everything is read by Spark's readers, so inputs may lie in any store Spark reads. Binary formats are parsed in Arrow batches.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nava.sources import audio
from nava.sources.audio import wav_bytes, wav_facts, wav_samples  # noqa: F401


class SourceError(ValueError):
    """An input isn't as its format says."""


def delimited(spark: SparkSession, path: str, required: tuple[str, ...] = ("path", "sentence"), sep: str = "\t", columns: list[str] | None = None) -> DataFrame:
    """Quoted, delimited text with a header; all strings, empty cells are "". Extra columns and their order are kept."""
    df = spark.read.option("sep", sep).option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise SourceError(f"{path} lacks the columns {missing}")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in (columns or df.columns)])


def numbered(df: DataFrame, name: str = "source_index") -> DataFrame:
    """1-based numbers in the order of the file's rows: positions within partitions after the sizes of those before."""
    rows = df.withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumn("__part", F.shiftrightunsigned("__id", 33))
    sizes = rows.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + within).drop("__id", "__part", "__before")


def overflowing(spark: SparkSession, path: str, sep: str, key: str = "file_name", text: str = "sentence", suffix: str = ".mp3") -> DataFrame:
    """Two-column metadata whose text may hold the separator: what overflows belongs to the text. An unnamed first column is an index.

    Keys lose their folder and get the suffix if they have none.
    """
    lines = spark.read.text(path)
    head = lines.select("value").first()
    if head is None:
        return spark.createDataFrame([], f"{key} string, {text} string")
    names = [x.strip().strip('"') for x in head[0].lstrip("﻿").split(sep)]
    if key not in names or text not in names:
        raise SourceError(f"{path} lacks {key} or {text}")
    at = names.index(key)
    body = lines.where((F.col("value") != head[0]) & (F.trim("value") != ""))
    parts = F.split("value", re.escape(sep), at + 2)
    unquoted = F.replace(F.regexp_replace(F.trim(F.get(parts, F.lit(at + 1))), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    name = F.regexp_extract(F.trim(F.get(parts, F.lit(at))), r"([^/]*)$", 1)
    name = F.when(name.rlike(r"\.[A-Za-z0-9]+$"), name).otherwise(F.concat(name, F.lit(suffix)))
    return body.select(name.alias(key), F.coalesce(unquoted, F.lit("")).alias(text))


def one_value(text: Column) -> Column:
    """Whether a text is one JSON value. Parsers stop at the end of the first one, so it is read as the only member of a list."""
    members = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce(F.size(members) == 1, F.lit(False)) & F.try_parse_json(text).isNotNull()


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON objects, one a line; blank lines don't count. Strict: a line that isn't such an object is an error."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wide = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    broken = F.col("j._corrupt_record").isNotNull() | ~F.trim("value").startswith("{") | ~one_value(F.col("value"))
    if not strict:
        rows = rows.where(~broken)
    elif not rows.where(broken).isEmpty():
        every = numbered(spark.read.text(path), "line").where(F.trim("value") != "")
        bad = every.select("line", "value", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j")).where(broken).take(3)
        raise SourceError(f"{path} has lines that aren't objects of this shape: {[(r['line'], r['value'][:80]) for r in bad]}")
    return rows.select(*[F.col(f"j.{f.name}").alias(f.name) for f in fields.fields])


def mapping(spark: SparkSession, path: str, schema: str, defaults: dict[str, str], split: str | None = None) -> DataFrame:
    """JSON lines whose fields have defaults; with a split, only its rows. A line without a field, or with null, has the default."""
    rows = json_lines(spark, path, schema)
    rows = rows.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in rows.columns])
    return rows.where(F.col("split") == split) if split is not None else rows


def required(rows: DataFrame, *fields: str) -> DataFrame:
    """rows, if each has all fields; else an error with the first that lack some."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    if bad := rows.where(F.size(missing) > 0).select(missing.alias("missing"), F.to_json(F.struct(*rows.columns)).alias("row")).take(3):
        raise SourceError(f"rows lack fields: {[(r['missing'], r['row'][:80]) for r in bad]}")
    return rows


def pattern_lines(spark: SparkSession, path: str, pattern: str = r'^\s*"([^"]+)"\s+"(.*)"\s*$', names: tuple[str, ...] = ("path", "sentence")) -> DataFrame:
    """One row a line by a pattern's groups; other lines than blank ones that don't match are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if bad := lines.where(~F.col("value").rlike(pattern)).take(3):
        raise SourceError(f"{path} has lines of another form: {[r[0][:80] for r in bad]}")
    return lines.select(*[F.regexp_extract("value", pattern, k).alias(n) for k, n in enumerate(names, 1)])


def listing(spark: SparkSession, root: str, glob: str = "*", exclude: str | None = None) -> DataFrame:
    """path, length, modified of files below root; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    df = df.select("path", "length", F.col("modificationTime").alias("modified"))
    return df.where(~F.col("path").contains(exclude)) if exclude else df


def shard_number(path: Column) -> Column:
    """The number at a file name's end, for natural order."""
    return F.regexp_extract(path, r"_(\d+)(?:\.[^./]*)?$", 1).try_cast("int")


def stems(files: DataFrame) -> DataFrame:
    """stem, path: of files with equal stems the first path."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^./]*$", "")
    return files.groupBy(stem.alias("stem")).agg(F.min("path").alias("path"))


def resolve_paths(rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Adds found: the file of this path, else of this stem, else null."""
    exact = files.select(F.col("path").alias("found_path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("__name")).dropDuplicates(["__name"])
    by_stem = stems(files).select(F.col("stem").alias("__stem"), F.col("path").alias("stem_path"))
    own = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    rows = rows.withColumn("__name", own).withColumn("__stem", F.regexp_replace(own, r"\.[^./]*$", ""))
    rows = rows.join(exact, "__name", "left").join(by_stem, "__stem", "left")
    return rows.withColumn("found", F.coalesce("found_path", "stem_path")).drop("__name", "__stem", "found_path", "stem_path")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def unsafe_member(name: str) -> bool:
    return name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/")


def open_uri(uri: str):
    """A file opened for reading where the task runs, through Arrow's file systems (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return system.open_input_file(path)


def archive_members(spark: SparkSession, path: str, pattern: str = "", opened: Callable[[str], io.IOBase] = open_uri) -> DataFrame:
    """archive, member, content of tar and zip archives; members whose path leaves the archive are an error.

    Archives are listed by Spark and read as streams where the task runs, a member at a time, so their size doesn't matter. `opened`
    reads from a store that Arrow doesn't know.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive in part["path"]:
                with opened(archive) as file:
                    if file.read(4)[:2] == b"PK":
                        file.seek(0)
                        book = zipfile.ZipFile(file)
                        members = ((i.filename, lambda i=i: book.read(i)) for i in book.infolist() if not i.is_dir())
                    else:
                        file.seek(0)
                        tar = tarfile.open(fileobj=file, mode="r|*")
                        members = ((m.name, lambda m=m: tar.extractfile(m).read()) for m in tar if m.isfile())
                    for name, read in members:
                        if unsafe_member(name):
                            raise SourceError(f"{archive} holds {name}")
                        if re.search(pattern, name):
                            yield pd.DataFrame({"archive": [archive], "member": [name], "content": [read()]})

    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return paths.repartition("path").mapInPandas(run, "archive string, member string, content binary")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str]]:
    """The first sheet's rows: shared, inline and plain cells at their columns; rows without text go."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        if not sheets:
            raise SourceError("the workbook has no sheet")
        rows = []
        for row in ElementTree.fromstring(book.read(sheets[0])).iter(f"{_SHEET}row"):
            cells: dict[int, str] = {}
            for position, cell in enumerate(row.iter(f"{_SHEET}c")):
                letters = re.match(r"[A-Z]+", cell.get("r", ""))
                at = position
                if letters:
                    at = -1
                    for letter in letters[0]:
                        at = (at + 1) * 26 + ord(letter) - 65
                value = cell.find(f"{_SHEET}v")
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                else:
                    text = "" if value is None or value.text is None else value.text
                    text = shared[int(text)] if cell.get("t") == "s" and text else text
                cells[at] = text
            line = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            if any(x.strip() for x in line):
                rows.append(line)
        return rows


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells of workbooks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                rows = sheet_rows(content)
                yield pd.DataFrame({"path": name, "row": range(len(rows)), "cells": rows})

    return _contents(spark, path).mapInPandas(run, "path string, row long, cells array<string>")


def choose_column(headers: list[str], names: tuple[str, ...], default: int) -> int:
    """The header that equals a name, else one that holds a name, else the default."""
    low = [h.strip().lower() for h in headers]
    for fits in (lambda h, n: h == n, lambda h, n: n in h):
        for name in names:
            for i, header in enumerate(low):
                if fits(header, name):
                    return i
    return default


def feed_items(feeds: DataFrame, url: str, payload: str, most: int) -> DataFrame:
    """url, position, title, link, guid, published, enclosure of RSS items with title and link; at most `most` of each feed."""
    items = F.regexp_extract_all(payload, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    rows = feeds.select(url, F.posexplode(items).alias("position", "item"))
    plain = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"^\s*<!\[CDATA\[|\]\]>\s*$", "")), F.lit(""))
    rows = rows.select(
        url, "position", plain("title").alias("title"), plain("link").alias("link"), F.coalesce(plain("guid"), plain("link")).alias("guid"),
        plain("pubDate").alias("published"), F.nullif(F.regexp_extract("item", r"(?i)<enclosure\b[^>]*\burl=[\"']([^\"']+)", 1), F.lit("")).alias("enclosure"),
    ).where("title is not null and link is not null")
    order = F.row_number().over(Window.partitionBy(url).orderBy("position"))
    return rows.withColumn("__row", order).where(F.col("__row") <= most).drop("__row")


def facts_of(contents: DataFrame) -> DataFrame:
    """path, rate, channels, frames, seconds, error from path and content."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            facts = [audio.facts(c) for c in part["content"]]
            frame = pd.DataFrame([f or (None, None, None, None) for f in facts], columns=["rate", "channels", "frames", "seconds"]).astype({"rate": "Int64", "channels": "Int64", "frames": "Int64", "seconds": float})
            frame.insert(0, "path", part["path"].to_numpy())
            yield frame.assign(error=["invalid_audio" if f is None else None for f in facts])

    return contents.select("path", "content").mapInPandas(run, "path string, rate long, channels long, frames long, seconds double, error string")


def samples_of(contents: DataFrame) -> DataFrame:
    """path, rate, samples (mono) of readable audio, from path and content."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                if audio.facts(content):
                    rate, samples = audio.samples(content)
                    yield pd.DataFrame({"path": [path], "rate": [rate], "samples": [samples]})

    return contents.select("path", "content").mapInPandas(run, "path string, rate long, samples array<double>")


def audio_facts(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, channels, frames, seconds, error of audio files."""
    return facts_of(_contents(spark, path))


def audio_samples(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples of readable audio files."""
    return samples_of(_contents(spark, path))


def dotenv(text: str) -> dict[str, str]:
    """Names and values of an environment file; comments, export and quotes are understood."""
    out = {}
    for line in text.splitlines():
        match = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if match and not line.lstrip().startswith("#"):
            value = match[2]
            out[match[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def merged(defaults: dict, own: dict) -> dict:
    """own over defaults, mappings merged in depth."""
    both = {k: merged(v, own[k]) if isinstance(v, dict) and isinstance(own.get(k), dict) else own.get(k, v) for k, v in defaults.items()}
    return both | {k: v for k, v in own.items() if k not in defaults}


def split_listing(listing_: DataFrame, root: str, content: str) -> DataFrame:
    """Adds kind: content for files below the folder of this name in root, metadata for the others."""
    prefix = root.rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.instr(F.col("path"), F.lit(prefix)) + F.lit(len(prefix)))
    return listing_.withColumn("kind", F.when(F.get(F.split(relative, "/"), F.lit(0)) == content, F.lit("content")).otherwise("metadata"))


def record_files(records: DataFrame, payload: str, suffix: str = "") -> DataFrame:
    """name, size, checksum, url of the files that JSON records list, those of one ending, each name once (the first record's)."""
    kind = "struct<files:array<struct<key:string,size:bigint,checksum:string,links:struct<self:string>>>>"
    rows = records.select(F.monotonically_increasing_id().alias("__record"), F.from_json(payload, kind).alias("r")).select("__record", F.posexplode("r.files").alias("__at", "f"))
    rows = rows.select("__record", "__at", F.col("f.key").alias("name"), F.col("f.size").alias("size"), F.col("f.checksum").alias("checksum"), F.col("f.links.self").alias("url"))
    order = Window.partitionBy("name").orderBy("__record", "__at")
    return rows.where(F.col("name").endswith(suffix)).withColumn("__row", F.row_number().over(order)).where("__row = 1").select("name", "size", "checksum", "url")
