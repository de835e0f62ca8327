"""Session settings, package shipping and reliable intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with this engine's defaults; conf overrides them."""
    builder = SparkSession.builder.master(master).appName("nava")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers import it wherever they start."""
    context = spark.sparkContext
    bytes_key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not context.getConf().contains(bytes_key):
        spark.conf.set(bytes_key, "8m")  # whole texts: a batch is bounded by its bytes, not by its rows alone
    if getattr(context, "_nava_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="nava-"), "nava_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._nava_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and all runs on one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(context, "_nava_shared", None)
        if folder is None:
            folder = context._nava_shared = tempfile.mkdtemp(prefix="nava-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    context = spark.sparkContext
    context._nava_stored = [*getattr(context, "_nava_stored", []), path]
    out._nava_path = path
    return out


def written(spark: SparkSession) -> frozenset[str]:
    """The tables that stored() has written in this application."""
    return frozenset(getattr(spark.sparkContext, "_nava_stored", []))


def discard(spark: SparkSession, *kept: DataFrame, before: frozenset[str] = frozenset()) -> None:
    """Remove the tables of stored() but for those given and those of before. Results that still read them must be done."""
    context = spark.sparkContext
    keep = {getattr(df, "_nava_path", None) for df in kept} | before
    for path in getattr(context, "_nava_stored", []):
        if path not in keep:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    context._nava_stored = [path for path in getattr(context, "_nava_stored", []) if path in keep]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
