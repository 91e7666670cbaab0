"""Measure the report's SQL shape against the rewritten DataFrame shape.

r4_9 in the SQL shape: LEFT JOIN + three COUNT(DISTINCT CASE ...) (Expand, two shuffles
of the joined rows) vs the library's flags-then-sum plan (inner interval join + zero row
per interval + grouped max, then sums).  r3_2 as UNION ALL arms (the join evaluated once
per arm) vs one aggregate pass exploded into labelled rows.  Prints best-of-3 seconds, exchange and Expand
counts for each.  Usage: python scripts/compare_shapes.py [sf_dir]
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortlens.plans.registry import reports, tables_for  # noqa: E402
from cohortlens.session import get_session  # noqa: E402

SQL_SHAPE = """
SELECT CASE WHEN e.end_status = 'Graduated' THEN 'Graduates'
            WHEN e.end_status = 'Terminated' THEN 'Terminated Participants' ELSE 'Other' END AS Group_Type,
       COUNT(DISTINCT e.participant_id) AS Participant_Count,
       COUNT(DISTINCT CASE WHEN pc.charge_date > e.end_date AND date_diff(pc.charge_date, e.end_date) <= 365
                           THEN pc.participant_id END) AS Participants_With_Post_MHC_Charges,
       COUNT(DISTINCT CASE WHEN pc.outcome = 'Convicted' AND pc.charge_date > e.end_date
                           AND date_diff(pc.charge_date, e.end_date) <= 365
                           THEN pc.participant_id END) AS Participants_With_Post_MHC_Convictions
FROM enrollment e LEFT JOIN participant_charge pc ON e.participant_id = pc.participant_id
WHERE e.end_status IN ('Graduated', 'Terminated') AND e.end_date IS NOT NULL
GROUP BY 1"""


ARMS_SHAPE = """
SELECT 'Before MHC Enrollment' AS Period, COUNT(*) AS Total_Charges,
       COUNT(DISTINCT pc.participant_id) AS Participants_With_Charges,
       SUM(CASE WHEN pc.outcome = 'Convicted' THEN 1 ELSE 0 END) AS Total_Convictions,
       SUM(CASE WHEN pc.charge_date < e.start_date THEN 1 ELSE 0 END) AS hits
FROM participant_charge pc JOIN enrollment e ON pc.participant_id = e.participant_id
WHERE pc.charge_date IS NOT NULL AND e.start_date IS NOT NULL
UNION ALL
SELECT 'During MHC Enrollment', COUNT(*), COUNT(DISTINCT pc.participant_id),
       SUM(CASE WHEN pc.outcome = 'Convicted' THEN 1 ELSE 0 END),
       SUM(CASE WHEN pc.charge_date >= e.start_date AND (pc.charge_date <= e.end_date OR e.end_date IS NULL)
           THEN 1 ELSE 0 END)
FROM participant_charge pc JOIN enrollment e ON pc.participant_id = e.participant_id
WHERE pc.charge_date IS NOT NULL AND e.start_date IS NOT NULL"""


def _best(df_fn, n=3):
    best = 9e9
    for _ in range(n):
        t0 = time.perf_counter()
        df_fn().collect()
        best = min(best, time.perf_counter() - t0)
    return round(best, 3)


def _stats(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Expand")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    t = tables_for(spark, sf_dir)
    t["enrollment"].createOrReplaceTempView("enrollment")
    t["participant_charge"].createOrReplaceTempView("participant_charge")
    sql_df = lambda: spark.sql(SQL_SHAPE)
    lib_df = lambda: reports()["r4_9"](t)
    a = sorted((r[0], r[1], r[2], r[3]) for r in sql_df().collect())
    b = sorted((r[0], r[1], r[2], r[3]) for r in lib_df().collect())
    assert a == b, (a, b)
    for label, fn in (("r4_9 sql shape (LEFT JOIN + COUNT DISTINCT CASE)", sql_df),
                      ("r4_9 flags-then-sum (library)", lib_df)):
        ex, expand = _stats(fn())
        print(f"{label:50s} best {_best(fn)} s  hash exchanges {ex}  Expand {expand}")
    arms_df = lambda: spark.sql(ARMS_SHAPE)
    one_df = lambda: reports()["r3_2"](t)
    a = sorted((r[0], r[1], r[2], r[3]) for r in arms_df().collect())
    b = sorted((r[0], r[1], r[2], r[3]) for r in one_df().collect())
    assert a == b, (a, b)
    for label, fn in (("r3_2 UNION ALL arms (join evaluated per arm)", arms_df),
                      ("r3_2 one pass + inline (library)", one_df)):
        ex, expand = _stats(fn())
        print(f"{label:50s} best {_best(fn)} s  hash exchanges {ex}  Expand {expand}")


if __name__ == "__main__":
    main()
