"""Every registered query against its independent DuckDB SQL (the driver
does the same at sf0.01); queries without SQL must at least run."""

import pytest

from keelson.plans.catalog import QUERIES
from keelson.plans.compare import compare, duck
from keelson.plans.oracle import ORACLE
from paths import SMOKE

_con = None


def con():
    global _con
    if _con is None:
        _con = duck(SMOKE)
    return _con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, key):
    df = QUERIES[key](spark, SMOKE)
    if key not in ORACLE:
        assert df.count() >= 0
        return
    r = compare(df, con(), ORACLE[key])
    assert r["cols_match"], r
    assert r["rows"][0] == r["rows"][1], r
    assert r["hash_match"], r


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
