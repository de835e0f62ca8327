"""Structured Streaming: one run over the files that are there, window families, and the last accepted texts as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> None:
    """Process what is there now and stop; the checkpoint makes the next run go on from here."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path)
    writer.start().awaitTermination()


def tumbling(df: DataFrame, at: str, width: str, *groups: Column, late: str | None = None) -> DataFrame:
    df = df.withWatermark(at, late) if late else df
    return df.groupBy(F.window(at, width), *groups).agg(F.count("*").alias("rows"))


def sliding(df: DataFrame, at: str, width: str, step: str, *groups: Column, late: str | None = None) -> DataFrame:
    df = df.withWatermark(at, late) if late else df
    return df.groupBy(F.window(at, width, step), *groups).agg(F.count("*").alias("rows"))


def sessions(df: DataFrame, at: str, gap: str, *groups: Column, late: str | None = None) -> DataFrame:
    """Events at most a gap apart; two exactly a gap apart are one session, unlike in merged intervals."""
    df = df.withWatermark(at, late) if late else df
    return df.groupBy(F.session_window(at, gap), *groups).agg(F.count("*").alias("rows"))


def recent_texts(stream: DataFrame, key: str, text: str, keep: int = 3) -> DataFrame:
    """key, text, preceding: the last texts of a key before each row, held as state between micro-batches."""

    def update(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        history = list(state.get[0]) if state.exists else []
        for part in parts:
            before = []
            for own in part[text]:
                before.append(list(history))
                history = [*history, own][-keep:]
            yield pd.DataFrame({key: keys[0], "text": part[text].to_numpy(), "preceding": before})
        state.update((history,))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, text string, preceding array<string>", "history array<string>", "append", "NoTimeout"
    )
