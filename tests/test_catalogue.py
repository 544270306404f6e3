"""Every catalogue query against its SQL oracle on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest
from conftest import SMALL

from quern.plans import catalogue, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 8) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(catalogue.REGISTRY))
def test_matches_oracle(spark, duck, name):
    got = catalogue.REGISTRY[name](spark, SMALL)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    if name not in oracles.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=str)
