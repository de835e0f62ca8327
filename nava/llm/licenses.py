"""Licence scan with a positional rare-token index. DataFrame functions only.

The words of all licence templates form one vocabulary. One pass over the texts keeps each file's places of vocabulary words. A
word's weight falls with the share of files that hold it (counted over all files); the rarest word of each template's mandatory
phrase is the index: no alignment counts without it. Files with an index word look up the template postings (template, position), and
a posting's place in the file minus its place in the template names an alignment, scored by all its words: the weight
that it matches over the template's weight. An alignment counts if its score reaches MIN_SCORE and the template's mandatory phrase stands at its place in the same alignment.

Nulls, ties and edges: a null text is an empty one; without a match the labels are "" and the score 0; repeated rows give equal
rows; an empty table gives an empty result; other columns are ignored. Very long files cost in proportion to their vocabulary
words, as alignments are counted, never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nava.session import stored

#: Phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, notice, mandatory phrase of it.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: Share of a template's weight that an alignment must match.
MIN_SCORE = 0.7

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the text before lower-casing: the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] and A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def vocabulary() -> list[str]:
    return sorted({w for text in [t for _, t, _ in TEMPLATES] + [p for p, _ in BASE] for w in text.split()})


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def hits(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, n_words and the places of vocabulary words, from one pass over whole texts."""
    known = vocabulary()
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    longest = max(map(len, known))

    def found(word: Column) -> Column:
        return (F.octet_length(word) <= longest) & lower_ascii(word).isin(known)

    placed = F.transform("words", lambda w, i: F.when(found(w), F.struct(i.alias("pos"), lower_ascii(w).alias("word"))))
    return docs.select("doc_id", words.alias("words")).select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.array_compact(placed).alias("hits"),
    )


def base_places(found: DataFrame) -> DataFrame:
    """row_id, n_base, first_word, last_word, base labels: where a phrase's words stand consecutively."""
    rows = [(k, label, len(p.split()), i, w) for k, (p, label) in enumerate(BASE) for i, w in enumerate(p.split())]
    phrases = found.sparkSession.createDataFrame(rows, "phrase int, label string, length int, tpos int, word string")
    own = sorted({w for p, _ in BASE for w in p.split()})
    places = found.select("row_id", F.explode(F.filter("hits", lambda h: h["word"].isin(own))).alias("h")).select("row_id", "h.pos", "h.word")
    starts = (
        places.join(F.broadcast(phrases), "word")
        .groupBy("row_id", "phrase", "label", "length", (F.col("pos") - F.col("tpos")).alias("start"))
        .agg(F.count("*").alias("n"))
        .where("n = length")
    )
    return starts.groupBy("row_id").agg(
        F.count("*").alias("n_base"),
        F.min("start").cast("long").alias("first_word"),
        F.max("start").cast("long").alias("last_word"),
        F.collect_set("label").alias("base"),
    )


def word_weights(found: DataFrame) -> dict[str, int]:
    """A weight for each vocabulary word: the binary digits of (files / files that hold it), counted over all files.

    Whole numbers, so sums don't depend on their order. The result has a row for each word of the fixed lists.
    """
    words = F.array_distinct(F.transform("hits", lambda h: h["word"]))
    held = found.select(F.explode(words).alias("word")).groupBy("word").count()
    files = found.count()
    counts = {r["word"]: r["count"] for r in held.collect()}
    return {w: (files // max(1, counts.get(w, 0))).bit_length() for w in vocabulary()}


def matches(found: DataFrame) -> DataFrame:
    """row_id, score, labels of the templates that the file matches.

    The index holds the highest-weighted word of each template's mandatory phrase, so files without any of these have no match; of the
    others all alignments are scored by all vocabulary words.
    """
    spark = found.sparkSession
    weights = word_weights(found)
    rows = []
    for k, (label, text, phrase) in enumerate(TEMPLATES):
        words, need = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        whole = sum(weights[w] for w in words)
        rows += [(k, label, whole, len(need), i, w, weights[w], at <= i < at + len(need)) for i, w in enumerate(words)]
    index = spark.createDataFrame(
        rows, "template int, label string, whole long, must long, tpos int, word string, weight long, needed boolean"
    )
    rare = sorted({max(phrase.split(), key=lambda w: (weights[w], w)) for _, _, phrase in TEMPLATES})
    exploded = (
        found.where(F.exists("hits", lambda h: h["word"].isin(rare)))
        .select("row_id", F.explode("hits").alias("h"))
        .select("row_id", "h.pos", "h.word")
    )
    aligned = (
        exploded.join(F.broadcast(index), "word")
        .groupBy("row_id", "template", "label", "whole", "must", (F.col("pos") - F.col("tpos")).alias("start"))
        .agg(F.sum("weight").alias("got"), F.sum(F.col("needed").cast("int")).alias("kept"))
        .where((F.col("kept") == F.col("must")) & (F.col("got") >= MIN_SCORE * F.col("whole")))
    )
    return aligned.groupBy("row_id").agg(
        F.max(F.col("got") / F.col("whole")).alias("score"), F.collect_set("label").alias("more")
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    found = stored(hits(docs), "license-hits")
    none = F.array().cast("array<string>")
    text = lambda labels: F.array_join(F.array_sort(labels), ",")
    base = F.coalesce("base", none)
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("n_base") > 0, MIN_SCORE).otherwise(0.0))
    return (
        found.select("row_id", "doc_id", "n_words")
        .join(base_places(found), "row_id", "left")
        .join(matches(found), "row_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            text(base).alias("base_labels"),
            text(F.array_union(base, F.coalesce("more", none))).alias("labels"),
            score.cast("double").alias("score"),
        )
    )
