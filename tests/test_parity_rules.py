"""Explicit unit tests for the parity rules not covered elsewhere by name.

P1-P3: test_numeric.py; P10: test_reports_golden.py; P12, P13, P15, P16: test_cleaning.py.
"""

from pyspark.sql import functions as F

from cohortlens.functions.aggs import count_if_sum
from cohortlens.functions.text import combo_label, has_any_keyword, has_no_keyword
from cohortlens.operators.metrics import top_k, with_total_row
from cohortlens.plans.registry import reports
from tests.util import rows, tables


def test_p4_keyword_match_ignores_case(spark):
    df = spark.createDataFrame([("ptsd, bipolar disorder",), ("Bipolar, ANXIETY",)], "t string")
    got = [r[0] for r in df.select(combo_label("t")).collect()]
    assert got == ["PTSD + Bipolar", "Bipolar + Anxiety"]
    assert [r[0] for r in df.select(has_any_keyword("t", ["BIPOLAR"])).collect()] == [True, True]


def test_p6_none_of_on_null_text_is_not_counted(spark):
    df = spark.createDataFrame([(None,), ("depression",)], "t string")
    got = [r[0] for r in df.select(has_no_keyword("t", ["PTSD"])).collect()]
    assert got == [None, True]


def test_p7_sum_over_no_rows_is_null_count_is_zero(spark):
    empty = spark.createDataFrame([], "x string")
    r = empty.agg(count_if_sum(F.col("x") == "a").alias("s"), F.count("*").alias("n")).collect()[0]
    assert r.s is None and r.n == 0


def test_p8_null_group_keys_kept_and_in_total(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v long")
    assert sorted(rows(df.groupBy("k").count()), key=str) == sorted([("a", 1), (None, 2)], key=str)
    tot = {r.k: r.n for r in with_total_row(df, "k", {"n": F.count("*")}).collect()}
    assert tot == {"a": 1, "TOTAL": 3}


def test_p9_p11_top_k_is_deterministic_under_ties(spark):
    # sixteen offenses with equal frequency: the explicit tiebreak fixes the 15 kept
    df = spark.createDataFrame([(f"o{i:02d}", None if i % 2 else "F", 1) for i in range(16)],
                               "name string, class string, n long")
    a = [r.name for r in top_k(df, [F.desc("n"), F.asc("name"), F.asc_nulls_first("class")], 15).collect()]
    b = [r.name for r in top_k(df.repartition(5), [F.desc("n"), F.asc("name"),
                                                   F.asc_nulls_first("class")], 15).collect()]
    assert a == b == [f"o{i:02d}" for i in range(15)]


def test_p14_length_days_carried_as_given(spark):
    t = tables(spark, enrollment=[("a", "2020-01-01", "2020-01-31", "Graduated", 999.0)])
    got = {r[0]: r[1:] for r in reports()["r5_3"](t).collect()}
    assert got["Program Duration (Days)"] == (999.0, 999.0, 999.0, 1)  # not recomputed from dates


def test_charges_are_dealt_by_offense_and_by_class_and_participant_only(spark):
    from cohortlens.plans.registry import oracle_sql, reports
    from cohortlens.sources.bindings import report_body
    from tests.test_running import _exchanges
    from tests.util import tables
    import duckdb

    found, _ = _exchanges(spark, "with_total_row")
    assert not [x for x in found if "participant_id" in x and "offense_id" in x] and len(found) <= 5, found
    charges = [(p, o, c, "O", "Convicted") for p in ("a", "b", None) for o in (1, 1, 2, 3, 9, None) for c in ("2020-01-01", None)]
    t = tables(spark, participant_charge=charges, charge_offense=[(1, "A", "F"), (1, "A again", "F"), (2, "B", "M"), (3, "C", None), (None, "D", "T")])
    con = duckdb.connect()
    for k, v in t.items():
        con.register(k, v.toArrow())
    for name in ("with_total_row", "per_subject"):
        want = con.execute(report_body(oracle_sql()[name])).fetchall()
        assert sorted(map(str, map(tuple, reports()[name](t).collect()))) == sorted(map(str, want)), name
