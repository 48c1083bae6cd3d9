"""Queries of the operators against their SQL twins."""

import os

import pytest

from labelweave.llm.oracles import ORACLES
from labelweave.llm.queries import QUERIES
from tests.conftest import plan_of
from tests.test_queries import table

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


@pytest.mark.parametrize("name", ORACLES)
def test_twin(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, df.collect())
    cursor = duck.execute(ORACLES[name])
    assert got == table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[1], "no rows"


def test_quality_rules_stay_native(spark, sf_dir):
    plan = plan_of(QUERIES["op2_line_quality"](spark, sf_dir))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
