"""Every query with a SQL twin gives the same rows as the twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, duck
from conftest import SF
from shelfsense.registry.oracles import ORACLES
from shelfsense.registry.queries import QUERIES

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))
# trained models are checked in test_models.py
TRAINED = {"sentiment_train_predict", "language_id", "phase1_english"}


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if n not in TRAINED])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert "positive_count" in entry(spark).columns


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())
