"""The registered queries: columns of the contract, SQL where there is some."""

import os

import pytest

from nava.llm import queries
from tests import compared

pytestmark = pytest.mark.skipif(not os.path.isdir(compared.FOLDER), reason="the driver's tables aren't here")
COLUMNS = {
    "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op3_html": "page_id url text n_chars", "op5_mixing": "doc_id size source_size target taken",
    "op6_licenses": "doc_id n_words n_base first_word last_word base_labels labels score", "op7_quality": "doc_id held_out score predicted", "op8_topk": "query_id rank vec_id score",
    "op9_gif": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op10_jaccard": "doc_id n_shingles component_id",
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.queries()[name](spark, compared.FOLDER).columns == COLUMNS[name].split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_agree_with_sql(spark, name):
    assert compared.differences(spark, queries.queries()[name], queries.oracle_sql()[name]) == []
