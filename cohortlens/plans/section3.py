"""Section 3 — criminal history and risk (r3_1 .. r3_5)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggs import ONE, flag
from ..functions.bands import RISK_NORMS, RISK_ORDER, band_rank, relabel
from ..functions.numeric import (pct, round_ratio, round_real, sql_pct, sql_round_ratio,
                                 sql_round_real)
from ..operators.metrics import metric_rows
from ..operators.running import calendar, calendar_sums, dealt, event_days, windowed_sums
from ..sources.bindings import sql_with
from ..sources.store import once
from .section1 import classed_charges

SPARK: dict = {}
SQL: dict = {}


def report(name):
    def deco(fn):
        SPARK[name] = fn
        return fn
    return deco


PID = "participant_id"
def convicted():
    return F.col("outcome") == "Convicted"


def charge_days(t, where=None) -> DataFrame:
    """Charges as one row per (id, day) with n and n_conv, for look-ups of running counts."""
    pc = t["participant_charge"]
    if where is not None:
        pc = pc.where(where)
    return event_days(pc, PID, "charge_date", {"n": F.lit(1), "n_conv": flag(convicted())})


FOLLOWUP_DAYS = 365


def _window_sums(followup_days: int) -> dict[str, tuple]:
    """The sums of charges that reports take per participant, over its enrolments of a kind."""
    each, left = F.lit(1), F.col("end_date").isNotNull()
    grad, term = (flag(left & (F.col("end_status") == v)) for v in ("Graduated", "Terminated"))
    exited = flag(left & F.col("end_status").isin("Graduated", "Terminated", "Discharged"))
    started = flag(F.col("start_date").isNotNull())
    return {"any n": ("any", None, "n", started), "any n_conv": ("any", None, "n_conv", started),
            "before n": ("before", None, "n", each), "during n": ("during", None, "n", each),
            "lookback n_conv": ("lookback", 365, "n_conv", each), "during n_conv": ("during", None, "n_conv", each),
            **{f"{k} {m}": ("followup", followup_days, m, w) for k, w in (("grad", grad), ("term", term)) for m in ("n", "n_conv")},
            **{f"{k} after {m}": ("after", None, m, w) for k, w in (("exited", exited), ("grad", grad)) for m in ("n", "n_conv")}}


def run_windows(t) -> DataFrame:
    """For a run of many reports: one row per participant with all of its sums and ``any_hit`` and ``all_hit`` (see
    ``held_intervals``).  The days of charges and enrolments are a table of their own, so that the shuffles which bring them
    together are gone before they are dealt by participant."""
    sums = _window_sums(FOLLOWUP_DAYS)
    days = lambda: calendar(t["enrollment"], charge_days(t), sums, held=True)
    return t.once("charge_windows", lambda: calendar_sums(t.once("charge_days", days), sums, held=True))


def charge_windows(t, names: list[str], followup_days: int = FOLLOWUP_DAYS) -> DataFrame:
    """One row per participant with the named sums (see ``windowed_sums``; 0 or no row where there is nothing).

    A run of many reports takes all of them in one pass; a report alone takes its own."""
    sums = _window_sums(followup_days)
    if followup_days == FOLLOWUP_DAYS and hasattr(t, "once"):
        return run_windows(t).select(PID, *names)
    asked = {k: sums[k] for k in names}
    e = t["enrollment"].where(reduce(or_, [w > 0 for _, _, _, w in asked.values()]))
    guilty = all(m == "n_conv" for _, _, m, _ in asked.values())
    return windowed_sums(e, charge_days(t, where=convicted() if guilty else None), asked)


# ---------------------------------------------------------------- r3_1 risk vs norms
@report("r3_1")
def risk_distribution(t) -> DataFrame:
    ra = t["risk_assessment"].where(F.col("risk_category").isNotNull() & F.col("risk_score").isNotNull())
    g = ra.groupBy("risk_category").agg(F.count(ONE).alias("Participant_Count"),
                                         F.avg("risk_score").alias("_avg"))
    return (g.select(F.col("risk_category").alias("Risk_Category"), "Participant_Count",
                     round_real("_avg", 2).alias("Average_Score"),
                     relabel("risk_category", RISK_NORMS, "Unknown").alias("US_Probation_Norms"))
            .orderBy(band_rank("Risk_Category", RISK_ORDER), "Risk_Category"))


SQL["r3_1"] = sql_with("risk_assessment") + f"""
, norms(category, norm) AS (VALUES ('Low', '0-3 (US Norm: 23%)'), ('Medium', '4-6 (US Norm: 38%)'),
                                   ('High', '7-9 (US Norm: 28%)'), ('Very High', '10+ (US Norm: 11%)')),
graded AS (SELECT risk_category AS category, list(risk_score) AS scores FROM risk_assessment
           WHERE risk_category IS NOT NULL AND risk_score IS NOT NULL GROUP BY ALL)
SELECT category AS Risk_Category, len(scores) AS Participant_Count,
       {sql_round_real('list_avg(scores)', 2)} AS Average_Score, coalesce(norm, 'Unknown') AS US_Probation_Norms
FROM graded LEFT JOIN norms USING (category)"""


# ---------------------------------------------------------------- r3_2 before / during
@report("r3_2")
def history_before_during(t) -> DataFrame:
    names = {"any n": "n", "any n_conv": "n_conv", "before n": "n_before", "during n": "n_during"}
    per = charge_windows(t, list(names)).withColumnsRenamed(names).where("n > 0")
    row = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(ONE).alias("ids"),
                  F.sum("n_conv").alias("n_conv"), F.sum("n_before").alias("n_before"),
                  F.sum("n_during").alias("n_during"))
    types = {"Period": "string", "Total_Charges": "long", "Participants_With_Charges": "long",
             "Total_Convictions": "long", "Percentage_Before_MHC": "double"}
    common = {"Total_Charges": F.col("n"), "Participants_With_Charges": F.col("ids"),
              "Total_Convictions": F.col("n_conv")}
    return metric_rows(row, [
        {"Period": "Before MHC Enrollment", **common, "Percentage_Before_MHC": pct("n_before", "n")},
        {"Period": "During MHC Enrollment", **common, "Percentage_Before_MHC": pct("n_during", "n")},
    ], types)


SQL["r3_2"] = sql_with("participant_charge", "enrollment") + f"""
, pairs AS (SELECT participant_id, outcome, charge_date < start_date AS earlier,
                   charge_date BETWEEN start_date AND coalesce(end_date, charge_date) AS inside
            FROM participant_charge JOIN enrollment USING (participant_id)
            WHERE charge_date IS NOT NULL AND start_date IS NOT NULL),
tally AS (SELECT count(*) AS n, count(DISTINCT participant_id) AS ids,
                 CAST(sum(CASE outcome WHEN 'Convicted' THEN 1 ELSE 0 END) AS BIGINT) AS guilty,
                 count(*) FILTER (earlier) AS b, count(*) FILTER (inside) AS d FROM pairs)
SELECT period AS Period, n AS Total_Charges, ids AS Participants_With_Charges, guilty AS Total_Convictions,
       CASE period WHEN 'Before MHC Enrollment' THEN {sql_pct('b', 'n')} ELSE {sql_pct('d', 'n')} END AS Percentage_Before_MHC
FROM tally, (VALUES ('Before MHC Enrollment'), ('During MHC Enrollment')) periods(period)"""


# ---------------------------------------------------------------- r3_3 per-participant history
@report("r3_3")
def history_per_participant(t) -> DataFrame:
    per = t["participant_charge"].groupBy(PID).agg(F.count(ONE).alias("c"),
                                                   F.sum(flag(convicted())).alias("v"))
    row = per.agg(F.count(ONE).alias("k"), F.sum("c").alias("c_sum"), F.min("c").alias("c_min"),
                  F.max("c").alias("c_max"), F.sum("v").alias("v_sum"), F.min("v").alias("v_min"),
                  F.max("v").alias("v_max"))
    types = {"Metric": "string", "Average": "double", "Minimum": "long", "Maximum": "long",
             "Total": "long"}
    return metric_rows(row, [
        {"Metric": "Charges Per Participant", "Average": round_ratio("c_sum", "k", 2),
         "Minimum": F.col("c_min"), "Maximum": F.col("c_max"), "Total": F.col("c_sum")},
        {"Metric": "Convictions Per Participant", "Average": round_ratio("v_sum", "k", 2),
         "Minimum": F.col("v_min"), "Maximum": F.col("v_max"), "Total": F.col("v_sum")},
    ], types)


SQL["r3_3"] = sql_with("participant_charge") + f"""
, people AS (SELECT count(*) AS charges, count(*) FILTER (outcome = 'Convicted') AS convictions
             FROM participant_charge GROUP BY participant_id),
long AS (SELECT unnest([{{'m': 'Charges Per Participant', 'x': charges}},
                        {{'m': 'Convictions Per Participant', 'x': convictions}}], recursive := true) FROM people)
SELECT metric AS Metric, {sql_round_ratio('sum(x)', 'count(x)', 2)} AS Average, min(x) AS Minimum, max(x) AS Maximum,
       CAST(sum(x) AS BIGINT) AS Total
FROM (VALUES ('Charges Per Participant'), ('Convictions Per Participant')) k(metric) LEFT JOIN long ON m = metric
GROUP BY metric"""


# ---------------------------------------------------------------- r3_4 risk by exit status
@report("r3_4")
def risk_by_exit_status(t) -> DataFrame:
    p = t["participant"].select(PID)
    e = t["enrollment"].where(F.col("end_status").isNotNull()).select(PID, "end_status")
    ra = t["risk_assessment"].where(F.col("risk_score").isNotNull()).select(PID, "risk_score")
    g = (p.join(e, PID).join(ra, PID)
         .groupBy("end_status").agg(F.count(ONE).alias("Participant_Count"),
                                    F.avg("risk_score").alias("_avg"),
                                    F.min("risk_score").alias("Min_Risk_Score"),
                                    F.max("risk_score").alias("Max_Risk_Score")))
    return (g.select(F.col("end_status").alias("End_Status"), "Participant_Count",
                     round_real("_avg", 2).alias("Average_Risk_Score"), "Min_Risk_Score",
                     "Max_Risk_Score")
            .orderBy(F.desc("Average_Risk_Score"), "End_Status"))


SQL["r3_4"] = sql_with("participant", "enrollment", "risk_assessment") + f"""
, exits AS (SELECT participant_id, end_status FROM participant JOIN enrollment USING (participant_id) WHERE end_status IS NOT NULL),
scored AS (SELECT participant_id, risk_score AS x FROM risk_assessment WHERE risk_score IS NOT NULL)
SELECT end_status AS End_Status, count(*) AS Participant_Count, {sql_round_real('avg(x)', 2)} AS Average_Risk_Score,
       min(x) AS Min_Risk_Score, max(x) AS Max_Risk_Score
FROM exits JOIN scored USING (participant_id) GROUP BY end_status"""


# ---------------------------------------------------------------- r3_5 prior class vs outcome
MIN_GROUP = 5


@report("r3_5")
def prior_class_outcome(t, min_group_size: int = MIN_GROUP) -> DataFrame:
    # turned round: a charge looks up the exits of its subject's enrolments that start after its day
    # (dealt by day, as they are joined: see event_days; charges of nobody have no participant to join below)
    pc = (dealt(classed_charges(t).where("known = 1 and charge_date is not null and participant_id is not null")
                .select(PID, "class", (-1 - F.unix_date("charge_date")).alias("_at")), PID, "_at")
          .groupBy(PID, "class", "_at").agg(F.count(ONE).alias("n")))
    e = (t["enrollment"].where(F.col("end_status").isin("Graduated", "Terminated") & F.col("start_date").isNotNull())
         .groupBy(PID, (-F.unix_date("start_date")).alias("_at"))
         .agg(F.sum(flag(F.col("end_status") == "Graduated")).alias("g"),
              F.sum(flag(F.col("end_status") == "Terminated")).alias("x")))
    # the exits of a day stand beside every class of it, and count once
    days = W.partitionBy(PID).orderBy("_at")
    upto = days.rangeBetween(W.unboundedPreceding, W.currentRow)
    both = dealt(e.join(pc, [PID, "_at"], "full_outer"), PID).withColumn("_new", ~F.lag("_at").over(days).eqNullSafe(F.col("_at")))
    exits = [F.sum(F.when(F.col("_new"), F.col(c))).over(upto).alias(c) for c in ("g", "x")]
    people = t["participant"].groupBy(PID).agg(F.count(ONE).alias("np"))
    per = (both.select(PID, "class", "n", *exits).where("n is not null and g + x > 0").groupBy(PID, "class")
           .agg(F.sum(F.col("n") * F.col("g")).alias("g"), F.sum(F.col("n") * F.col("x")).alias("x"))
           .join(people, PID).select("class", (F.col("np") * F.col("g")).alias("g"), (F.col("np") * F.col("x")).alias("x")))
    g = once(t, "prior_classes", lambda: per.groupBy("class").agg(
        F.count(ONE).alias("Total_Participants"), F.sum("g").alias("Graduated"), F.sum("x").alias("Terminated")))
    return (g.where(F.col("Total_Participants") >= min_group_size)
            .select(F.col("class").alias("Offense_Class"), "Total_Participants", "Graduated",
                    "Terminated", pct("Graduated", "Total_Participants").alias("Graduation_Rate"))
            .orderBy(F.desc("Total_Participants"), "Offense_Class"))


SQL["r3_5"] = sql_with("participant", "enrollment", "participant_charge", "charge_offense") + f"""
, prior AS (SELECT class, participant_id, count(*) FILTER (end_status = 'Graduated') AS g,
                   count(*) FILTER (end_status = 'Terminated') AS x
            FROM enrollment JOIN participant USING (participant_id) JOIN participant_charge USING (participant_id)
                 JOIN charge_offense USING (offense_id)
            WHERE end_status IN ('Graduated', 'Terminated') AND charge_date < start_date GROUP BY ALL)
SELECT class AS Offense_Class, count(*) AS Total_Participants, CAST(sum(g) AS BIGINT) AS Graduated,
       CAST(sum(x) AS BIGINT) AS Terminated, {sql_pct('sum(g)', 'count(*)')} AS Graduation_Rate
FROM prior GROUP BY class HAVING count(*) >= {MIN_GROUP}"""
