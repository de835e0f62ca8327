"""Configurations and data folders, through Spark's file systems: small documents that the driver reads."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from nava.sources.files import SourceError, merged

#: The file that makes a folder a degraded dataset, and the splits of a clean one.
MAPPING = "degraded_to_clean.jsonl"
SPLITS = ("train", "dev", "test")


def load(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """A JSON or YAML mapping over defaults, merged in depth. YAML needs its library where this runs."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        own = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError as error:
            raise SourceError(f"{path} is YAML, and no library reads it here") from error
        own = yaml.safe_load(text)
    if own is None:
        own = {}
    if not isinstance(own, dict):
        raise SourceError(f"{path} holds no mapping")
    return merged(defaults or {}, own)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def dataset_kind(spark: SparkSession, folder: str) -> str:
    """degraded where a mapping is, also beside splits; clean where a split is; anything else is an error."""
    if _exists(spark, f"{folder}/{MAPPING}"):
        return "degraded"
    if any(_exists(spark, f"{folder}/{split}.tsv") for split in SPLITS):
        return "clean"
    raise SourceError(f"{folder} has neither {MAPPING} nor a split")


def datasets(spark: SparkSession, config: dict) -> list[tuple[str, str]]:
    """path, kind of each entry of `datasets` (a path, or a mapping with path and perhaps kind); without any, the one degraded dataset_dir."""
    entries = config.get("datasets")
    if not entries:
        return [(str(config["dataset_dir"]), "degraded")]
    out = []
    for entry in entries:
        if not isinstance(entry, (str, dict)):
            raise SourceError(f"{entry!r} is neither a path nor a mapping")
        path, kind = (entry.strip(), None) if isinstance(entry, str) else (str(entry.get("path", "")).strip(), entry.get("kind"))
        if not path:
            raise SourceError("an entry has no path")
        out.append((path, str(kind).strip() if kind is not None else dataset_kind(spark, path)))
    return out


def of_kind(resolved: list[tuple[str, str]], kind: str) -> list[str]:
    return [path for path, own in resolved if own == kind]


def data_root(spark: SparkSession, root: str, name: str) -> str:
    """The folder that holds a sub-folder of this name: the first in order of the paths below root."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, open_ = [], [at]
    while open_:
        for status in fs.listStatus(open_.pop()):
            if status.isDirectory():
                own = status.getPath()
                open_.append(own)
                if own.getName() == name:
                    found.append(own.getParent().toString())
    if not found:
        raise SourceError(f"no folder below {root} holds {name}")
    return min(found)
