"""Tests find the package from the repository's top."""

import os
import sys

import pytest

TOP = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = f"{TOP}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from nava import session

    built = session.build(
        "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
