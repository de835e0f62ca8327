"""Every query of the catalogue runs; those with SQL agree with it."""

import os

import pytest

from nava.plans import catalogue
from tests import compared

pytestmark = pytest.mark.skipif(not os.path.isdir(compared.FOLDER), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_agree_with_sql(spark, name):
    assert compared.differences(spark, catalogue.queries()[name], catalogue.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalogue.queries()[name](spark, compared.FOLDER).count() > 0


def test_flagship(spark):
    assert catalogue.flagship(spark, compared.FOLDER).count() > 0
