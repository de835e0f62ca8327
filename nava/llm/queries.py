"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nava.llm import bpe, gif, htmltext, jaccard, licenses, lmscore, mixing, oracles, quality, tokencount, topk
from nava.session import table


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; the package that holds it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokens(spark, sf_dir):
    """Tokens of every line of all documents."""
    import public_tokenizers

    return tokencount.count(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_bpe(spark, sf_dir):
    """Encode and decode all documents."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_html(spark, sf_dir):
    """The main text of all pages."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


#: The source whose documents are the target of op4.
TARGET_SOURCE = "src1"


def op4_lmscore(spark, sf_dir):
    """How near all documents are to those of TARGET_SOURCE, against all others."""
    return lmscore.score(table(spark, sf_dir, "documents"), F.col("source") == TARGET_SOURCE)


def op5_mixing(spark, sf_dir):
    """Mix all documents to the sources' target weights."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_licenses(spark, sf_dir):
    """Licence phrases and notices of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    """A quality score for all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_topk(spark, sf_dir):
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_gif(spark, sf_dir):
    """Every document as a GIF, read back."""
    return gif.store(table(spark, sf_dir, "documents"))


def op10_jaccard(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def queries():
    return {"op1_tokens": op1_tokens, "op4_lmscore": op4_lmscore, "op10_jaccard": op10_jaccard, "op2_bpe": op2_bpe, "op3_html": op3_html, "op9_gif": op9_gif, "op5_mixing": op5_mixing, "op6_licenses": op6_licenses, "op7_quality": op7_quality, "op8_topk": op8_topk}


def oracle_sql():
    """SQL for op5, op6 and op8. Tokenizers, models, page and image codecs and the similarity join are held against brute force in the tests."""
    return {"op5_mixing": oracles.mixing_sql(), "op6_licenses": oracles.licenses_sql(), "op8_topk": oracles.topk_sql()}
