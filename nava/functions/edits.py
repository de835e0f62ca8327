"""Edit distances of whole sequences: exact, without a cap, in Arrow functions.

A column of the distance matrix is kept as two bit vectors of vertical steps (Myers, in the form of Hyyrö); Python's integers hold them at any
length, so a pair of n and m items takes m steps over n bits.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("word_edits", "words", "char_edits", "chars")])


def edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Insertions, deletions and replacements between two sequences."""
    shorter = min(len(a), len(b))
    start = 0
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return len(b)
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, top, distance = (1 << n) - 1, 1 << n - 1, n
    up, down = whole, 0  # rows at which the column rises by one, or falls
    for x in b:
        same = places.get(x, 0)
        level = (((same & up) + up) ^ up) | same | down
        rises = down | ~(level | up) & whole
        falls = up & level
        if rises & top:
            distance += 1
        elif falls & top:
            distance -= 1
        rises = rises << 1 & whole | 1
        falls = falls << 1 & whole
        up = falls | ~(level | rises) & whole
        down = rises & level
    return distance


@F.pandas_udf(COUNTS)
def counted(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
    """Word and character edits, and the reference's words and characters; null where a side is null."""
    rows = []
    for r, h in zip(references, hypotheses):
        if r is None or h is None:
            rows.append((None,) * 4)
            continue
        own = r.split()
        rows.append((edits(own, h.split()), len(own), edits(r, h), len(r)))
    return pd.DataFrame(rows, columns=["word_edits", "words", "char_edits", "chars"]).astype("Int64")


@F.pandas_udf(T.LongType())
def char_edits(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edits(a, b) for a, b in zip(left, right)], dtype="Int64")


@F.pandas_udf(T.LongType())
def word_edits(left: pd.Series, right: pd.Series) -> pd.Series:
    """Between the words of two texts, by white space."""
    return pd.Series([None if a is None or b is None else edits(a.split(), b.split()) for a, b in zip(left, right)], dtype="Int64")


def distance(left: Column, right: Column) -> Column:
    """Character edits over the longer length; 0 for equal texts, 1 if only one is empty."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(left == right, 0.0).when((F.length(left) == 0) | (F.length(right) == 0), 1.0).otherwise(char_edits(left, right) / longest)
