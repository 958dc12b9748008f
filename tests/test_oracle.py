"""Every SQL-checkable catalog query equals its DuckDB oracle on the smoke tables."""
import os

import pytest

from tests.oracle_runner import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert r["cols_ok"] and r["rows"][0] == r["rows"][1] and r["hash_ok"], r


def test_double_column_lists_match_schemas(spark):
    from pyspark.sql import types as T

    import __spark_entry__ as E
    from riskweave.plans.oracle_doubles import DOUBLE_COLUMNS
    q = E.queries()
    for name in ("enrich_applications", "threshold_sweep", "feature_summary", "roc_curve"):
        df = q[name](spark, SF)
        assert DOUBLE_COLUMNS[name] == [f.name for f in df.schema.fields
                                        if isinstance(f.dataType, (T.DoubleType, T.FloatType))], name


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "BUREAU_N_CREDITS" in df.columns
