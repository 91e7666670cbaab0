"""Golden mini-cohort with hand-computed answers (flagship outcome reports, fan-out rules)."""

from cohortlens.plans.registry import reports
from tests.util import rows, tables


def _cohort(spark):
    enrollment = [
        ("a", "2023-01-01", "2023-06-30", "Graduated", 180.0),
        ("b", "2023-02-01", "2023-05-31", "Terminated", 119.0),
        ("c", "2023-01-01", None, "Graduated", None),
        ("d", "2022-01-01", "2022-12-31", "Graduated", 364.0),   # two enrolments (P10)
        ("d", "2023-01-01", "2023-12-31", "Terminated", 364.0),
        ("e", "2023-03-01", "2023-04-01", "Discharged", 31.0),
        ("f", "2023-01-01", "2023-01-31", "Terminated", 30.0),
    ]
    charges = [
        ("a", 1, "2023-07-01", "O", "Convicted"),   # one day after end
        ("a", 1, "2023-06-30", "O", "Dismissed"),   # on the end day (during)
        ("b", 2, "2024-05-31", "O", "Dismissed"),   # 366 days after (leap year) -> outside
        ("b", 2, "2024-05-30", "O", "Dismissed"),   # 365 days after -> inside
        ("c", 1, "2023-05-01", "O", "Convicted"),   # open interval -> during
        ("d", 1, "2023-06-01", "O", "Convicted"),   # after the 2022 enrolment, during the 2023 one
        ("f", 2, "2022-12-01", "O", "Dismissed"),   # before f's start
    ]
    participant = [(p, "F", "L", "1980-01-01", g, "White")
                   for p, g in [("a", "Male"), ("b", "Female"), ("c", "Male"), ("d", None), ("e", "Male"),
                                ("f", "Female")]]
    offense = [(1, "Theft", "F"), (2, "Fraud", "M")]
    return tables(spark, enrollment=enrollment, participant_charge=charges, participant=participant,
                  charge_offense=offense)


def test_r4_9_post_programme_outcomes(spark):
    t = _cohort(spark)
    got = rows(reports()["r4_9"](t))
    assert got == [("Graduates", 2, 2, 2, 100.0), ("Terminated Participants", 3, 1, 0, 33.33)]


def test_r4_6_charge_free_during(spark):
    t = _cohort(spark)
    got = {r[0]: (r[1], r[2]) for r in reports()["r4_6"](t).collect()}
    assert got["Participants with NO Charges During MHC"] == (4, 4 * 100.0 / 7)
    assert got["Participants with Charges During MHC"] == (3, 3 * 100.0 / 7)


def test_r5_6_recidivism_total_counts_null_gender(spark):
    t = _cohort(spark)
    got = {r[0]: r[1:] for r in reports()["r5_6"](t).collect()}
    # d has NULL gender: absent from the groups, present in TOTAL
    assert got["Male"] == (1, 1, 100.0)
    assert got["Female"] == (2, 1, 50.0)
    assert got["TOTAL"] == (4, 3, 75.0)


def test_r4_4_convictions_before_during(spark):
    t = _cohort(spark)
    got = {r[0]: r[1:] for r in reports()["r4_4"](t).collect()}
    # during: c (open) and d (2023 enrolment); before within 365: d's charge is before none
    assert got["During MHC Participation"] == (2, 2, 1.0)
    assert got["Before MHC (12 months prior)"] == (0, 0, None)


def test_r3_5_fan_out_and_min_group(spark):
    t = _cohort(spark)
    # every class has fewer than 5 participants -> HAVING removes all groups
    assert reports()["r3_5"](t).count() == 0
    from cohortlens.plans.section3 import prior_class_outcome
    got = rows(prior_class_outcome(t, min_group_size=1))
    # only f (Terminated) has a charge before its start: class M
    assert got == [("M", 1, 0, 1, 0.0)]


def test_r2_6_sums_joined_rows(spark):
    dx = [("d", "X", "PTSD, bipolar", "2020-01-01"), ("d", "Y", "PTSD", "2020-01-01"),
          ("a", "X", "anxiety", "2020-01-01")]
    t = _cohort(spark)
    t.update(tables(spark, participant_diagnosis=dx, participant=[
        (p, "F", "L", "1980-01-01", "Male", None) for p in "abcdef"]))
    t["enrollment"] = _cohort(spark)["enrollment"]
    got = {r[0]: r[1:] for r in reports()["r2_6"](t).collect()}
    # d: 2 enrolments (1 graduated) x 2 PTSD rows -> Graduated sums 2 joined rows (P10)
    assert got["PTSD Present"] == (1, 2, 200.0)
    assert got["Bipolar Present"] == (1, 1, 100.0)
    assert got["Any MH Diagnosis"] == (2, 2, 100.0)


def test_r3_5_counts_the_exits_of_a_day_once(spark):
    """Several classes, charges and exits on one day, equal participants, and days without a charge or an exit."""
    from cohortlens.plans.registry import oracle_sql
    from cohortlens.sources.bindings import report_body
    import duckdb

    people = [(p, "F", "L", "1980-01-01", "Male", "White") for p in ("a", "a", "b", "c", "d", "e", "f", None)]
    days = ["2020-01-01", "2020-01-02", "2020-03-01", None]
    charges = [(p, o, c, "O", "Convicted") for p in ("a", "b", "c", "d", "e", "f", "gone", None) for o in (1, 2, 2, 3, 9) for c in days]
    exits = [(p, s, None, x, 1.0) for p in ("a", "b", "c", "d", "e", "e", "f", "gone", None) for s in [*days, "2020-01-02"]
             for x in ("Graduated", "Terminated", "Discharged", None)]
    t = tables(spark, participant=people, participant_charge=charges, enrollment=exits,
               charge_offense=[(1, "Theft", "F"), (2, "Fraud", "M"), (3, "Other", None)])
    con = duckdb.connect()
    for k, v in t.items():
        con.register(k, v.toArrow())
    want = con.execute(report_body(oracle_sql()["r3_5"])).fetchall()
    got = [tuple(r) for r in reports()["r3_5"](t).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3


def test_r3_5_reads_the_charges_once(spark):
    from tests.test_running import _exchanges

    found, plan = _exchanges(spark, "r3_5")
    assert len(found) <= 9 and "collect_list" not in plan, found
