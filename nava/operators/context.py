"""Ordered sessions, context windows and the ledger of model responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from nava.functions import text as T
from nava.operators.constraints import first_reason
from nava.sources.files import one_value


def session_key(source: Column, row_id: Column) -> Column:
    """Rows of a source are one session; a row without one is its own."""
    has = source.isNotNull() & (F.length(F.trim(source)) > 0)
    return F.when(has, F.concat(F.lit("source:"), source)).otherwise(F.concat(F.lit("orphan:"), row_id))


def context(df: DataFrame, session: str, order: list, text: str, accepted: Column, before: int, after: int) -> DataFrame:
    """Adds preceding (the last `before` accepted texts) and following (the next `after` texts).

    Accepted rows gather their last texts in a bounded frame, and every row takes what the accepted row before it gathered, so
    nothing grows with the session.
    """
    none = F.array().cast("array<string>")
    rows = df.withColumn("__accepted", F.coalesce(accepted & F.col(text).isNotNull(), F.lit(False)))
    w = Window.partitionBy(session).orderBy(*order)
    if before:
        own = Window.partitionBy(session, "__accepted").orderBy(*order).rowsBetween(1 - before, 0)
        rows = rows.withColumn("__last", F.when(F.col("__accepted"), F.collect_list(text).over(own)))
        rows = rows.withColumn("preceding", F.coalesce(F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), none))
    else:
        rows = rows.withColumn("preceding", none)
    following = F.collect_list(text).over(w.rowsBetween(1, after)) if after else none
    return rows.withColumn("following", following).drop("__accepted", "__last")


def contract_reason(response: Column, keys: tuple[str, ...]) -> Column:
    """invalid_json, invalid_schema, or null for an object with exactly these keys."""
    found = F.array_sort(F.json_object_keys(response))
    return first_reason(
        ("invalid_json", ~one_value(response)),
        ("invalid_schema", ~F.coalesce(found == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))),
    )


def validate(df: DataFrame, response: str, target: str, normalize: Callable[[Column], Column], threshold: float = 0.35) -> DataFrame:
    """Adds cleaned_text, distance and reason (null: accepted): the ladder of checks, the first that fails decides."""
    j = F.col(response)
    uncertain = F.get_json_object(j, "$.uncertain")
    cleaned = normalize(F.get_json_object(j, "$.cleaned_text"))
    wanted = normalize(F.col(target))
    distance = T.edit_distance(wanted, cleaned)
    shape = contract_reason(j, ("cleaned_text", "uncertain"))
    typed = uncertain.isin("true", "false") & F.get_json_object(j, "$.cleaned_text").isNotNull()
    reason = F.coalesce(
        shape,
        first_reason(
            ("invalid_schema", ~F.coalesce(typed, F.lit(False))),
            ("model_uncertain", uncertain == "true"),
            ("persian_normalization_rejected", F.coalesce(F.length(cleaned), F.lit(0)) == 0),
            ("target_normalization_rejected", F.coalesce(F.length(wanted), F.lit(0)) == 0),
            ("numeric_tokens_changed", ~T.number_tokens(wanted).eqNullSafe(T.number_tokens(cleaned))),
            ("edit_distance_exceeded", distance > threshold),
        ),
    )
    return df.withColumn("cleaned_text", cleaned).withColumn("distance", distance).withColumn("reason", reason)


def input_fingerprint(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _wider(df: DataFrame, *names: str) -> StructType:
    """df's schema with further texts."""
    return StructType([*df.schema.fields, *[StructField(n, StringType()) for n in names]])


#: A scorer takes prompts and gives responses; it is called on batches within a worker.
Scorer = Callable[[list[str]], list[str]]


def refine(df: DataFrame, session: str, order: str, text: str, scorer: Scorer, accept: Callable[[str, str], str | None], before: int = 3, after: int = 3) -> DataFrame:
    """Adds response and cleaned: each prompt sees the accepted refined texts before it, so a session is scored in order.

    Sessions are independent and rows of a session are one recording's, so a session is one group.
    """
    schema = _wider(df, "response", "cleaned")

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)
        history: list[str] = []
        responses, cleaned = [], []
        for i, target in enumerate(rows[text]):
            following = rows[text].iloc[i + 1 : i + 1 + after].tolist()
            prompt = "\n".join(["Preceding:", *(history[-before:] if before else []), "Target:", target, "Following:", *following])
            answer = scorer([prompt])[0]
            good = accept(answer, target)
            if good is not None:
                history.append(good)
            responses.append(answer)
            cleaned.append(good)
        return rows.assign(response=responses, cleaned=cleaned)

    return df.groupBy(session).applyInPandas(own, schema)


def waves(df: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Round-robin batches: the n-th row of each session is in wave n."""
    return df.withColumn("wave", (F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1).cast("long"))


def transcribe(df: DataFrame, path: str, make: Callable[[], Callable[[list[str]], list[str | None]]], batch: int = 16) -> DataFrame:
    """Adds transcript and error: a model made once for each worker; a failing batch is tried again row by row."""
    schema = _wider(df, "transcript", "error")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for start in range(0, len(part), batch):
                paths = part[path].iloc[start : start + batch].tolist()
                try:
                    texts += model(paths)
                    errors += [None] * len(paths)
                except Exception:
                    for own in paths:
                        try:
                            texts += model([own])
                            errors.append(None)
                        except Exception as error:
                            texts.append(None)
                            errors.append(f"inference_failed: {error}")
            yield part.assign(transcript=texts, error=errors)

    return df.mapInPandas(run, schema)


def choices(requests: DataFrame, answers: DataFrame, request: str, index: str, choice: str) -> DataFrame:
    """request, choice, problem of every request: an index answered twice, not at all, or never asked for. Only whole requests are good."""
    asked = requests.select(request, index, F.lit(1).alias("__asked"))
    given = answers.groupBy(request, index).agg(F.count("*").alias("__given"), F.min(choice).alias(choice))
    rows = asked.join(given, [request, index], "full")
    facts = rows.groupBy(request).agg(
        F.max(F.col("__asked").isNull()).alias("__unknown"), F.max(F.col("__given").isNull()).alias("__none"), F.max(F.coalesce(F.col("__given") > 1, F.lit(False))).alias("__twice")
    )
    problem = first_reason(("unknown", F.col("__unknown")), ("incomplete", F.col("__none")), ("repeated", F.col("__twice")))
    return rows.where("__asked is not null").join(facts, request).select(request, F.col(choice).cast("long").alias(choice), problem.alias("problem"))
