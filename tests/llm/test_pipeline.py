"""Each stage against a plain version, on the stage's own input."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from nava.llm import mixing
from tests.llm.test_spark import brute_groups, near_copies


def frame(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in near_copies()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long").repartition(4)


def test_stages_are_those_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "mixing", "bpe"]


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    repeated = docs.unionByName(docs.where("doc_id = 3"))
    out = corpus_pipeline.one_of_each_group(spark, repeated, "")
    assert out.columns == docs.columns
    groups = brute_groups(near_copies())
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_quality_stage_keeps_columns_and_drops_rejected(spark, tmp_path):
    docs = frame(spark).limit(60)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 60  # without labels every score is 0.5, and all stay


def test_mixing_stage_repeats_documents(spark):
    docs = frame(spark)
    out = collections.Counter(r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, "").collect())
    plan = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert out == {i: r["starts"] for i, r in plan.items() if r["starts"]}
    words, target = collections.Counter(), {}
    for i, t, source in docs.select("doc_id", "text", "source").collect():
        words[source] += out[i] * plan[i]["size"]
        target[source] = plan[i]["target"]
    assert all(abs(words[s] - target[s]) < 0.05 * target[s] + 300 for s in words)


def test_empty_input(spark, tmp_path):
    docs = frame(spark).limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_nulls_pass(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() == 2
    assert corpus_pipeline.encoded(spark, docs, "").select(F.sum("n_tokens")).first()[0] == 2


def test_one_of_each_group_without_ids(spark):
    """Rows without an id are deduplicated too; a repeated id with another text is another document; rows without words stay."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (None, a), (None, a + " z"), (None, b), (None, b), (None, b + " z"), (1, "other words of one"), (1, "other words of one"), (None, None), (None, None), (5, " ")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str)
    kept = [x for x in out if x[1] and x[1].startswith("b")]
    assert len(kept) == 1 and kept[0][0] is None
    assert sorted((x for x in out if x not in kept), key=str) == sorted([(1, a), (1, "other words of one"), (None, None), (None, None), (5, " ")], key=str)


def test_rows_without_id_reach_the_end(spark, tmp_path):
    """Through all stages: no row is lost for want of an id."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None if i % 3 == 0 else i, " ".join(f"w{i}_{j}" for j in range(30)), "en", "s", i) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out[None] == 10 and sum(out.values()) == 30


def test_mixing_stage_keeps_rows_without_id(spark):
    rows = [(None if i % 3 == 0 else i // 6, f"t{i} " * (20 + i), "en", [None, "a"][i % 2], i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mixed(spark, docs, "").collect())
    plan = mixing.mix(docs, body=F.col("text")).where("starts > 0").collect()
    assert got == {(r["doc_id"], r["body"]): r["starts"] for r in plan} and any(i is None for i, _ in got)
