"""Every registered query vs its SQL oracle on sf0.001 (the driver's check, in small)."""

import math

import pytest

import __spark_entry__ as entry
from cohortlens.plans import registry
from tests.conftest import SF_SMALL

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return "NULL" if v is None else str(v)


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def test_every_query_has_an_oracle_or_is_documented():
    missing = set(QUERIES) - set(ORACLE)
    assert missing == set(), missing
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    s_tab = QUERIES[name](spark, SF_SMALL).toArrow()
    d_tab = duck.sql(ORACLE[name]).to_arrow_table()
    s_cols, d_cols = s_tab.column_names, d_tab.column_names
    assert sorted(s_cols) == sorted(d_cols)
    # same Arrow type per column (int32 vs int64, date, double, string, bool)
    assert {f.name: str(f.type) for f in s_tab.schema} == {f.name: str(f.type) for f in d_tab.schema}
    s_rows = [tuple(r[c] for c in s_cols) for r in s_tab.to_pylist()]
    d_rows = [tuple(r[c] for c in d_cols) for r in d_tab.to_pylist()]
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)


def test_entry_registers_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["Group_Type", "Participant_Count", "Participants_With_Post_MHC_Charges",
                          "Participants_With_Post_MHC_Convictions", "Percentage_With_Post_MHC_Charges"]
    assert df.count() >= 0
