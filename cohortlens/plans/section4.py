"""Section 4 — programme performance and outcomes (r4_1 .. r4_9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import ONE, flag
from ..functions.bands import GRADUATION_YEAR_BANDS, year_band
from ..functions.numeric import (pct, pct_unrounded, round_ratio, round_real, sql_pct,
                                 sql_pct_unrounded, sql_round_ratio, sql_round_real)
from ..operators.metrics import (BEFORE_RATE_UPLIFT, DAILY_JAIL_COST, cost_model, metric_rows,
                                 one_row, per_subject_flags, with_total)
from ..operators.running import event_days, held_intervals, windowed_sums
from ..sources.bindings import sql_with
from ..sources.store import once
from .section1 import classed_charges
from .section3 import FOLLOWUP_DAYS, charge_days, charge_windows, run_windows

SPARK: dict = {}
SQL: dict = {}


def report(name):
    def deco(fn):
        SPARK[name] = fn
        return fn
    return deco


PID = "participant_id"


# ---------------------------------------------------------------- r4_1 phase progression
@report("r4_1")
def phase_progression(t) -> DataFrame:
    p = t["participant"].select(PID)
    e = t["enrollment"].where(F.col("end_status").isNotNull()).select(PID, "end_status")
    per = per_subject_flags(p.join(e, PID), [PID], {"grad": F.col("end_status") == "Graduated"})
    row = per.agg(F.count(ONE).alias("n"), F.coalesce(F.sum("grad"), F.lit(0)).cast("long").alias("g"))
    types = {"Phase_Transition": "string", "Attempted_Transition": "long",
             "Successful_Graduation": "long", "Success_Rate": "double"}
    common = {"Attempted_Transition": F.col("n"), "Successful_Graduation": F.col("g"),
              "Success_Rate": pct("g", "n")}
    return metric_rows(row, [{"Phase_Transition": "Phase 1 to 2", **common},
                             {"Phase_Transition": "Overall Program Completion", **common}], types)


SQL["r4_1"] = sql_with("participant", "enrollment") + f"""
, people AS (SELECT participant_id, max(CASE end_status WHEN 'Graduated' THEN 1 ELSE 0 END) AS done
             FROM enrollment SEMI JOIN participant USING (participant_id)
             WHERE end_status IS NOT NULL GROUP BY participant_id),
tally AS (SELECT count(*) AS n, CAST(coalesce(sum(done), 0) AS BIGINT) AS g FROM people)
SELECT step AS Phase_Transition, n AS Attempted_Transition, g AS Successful_Graduation, {sql_pct('g', 'n')} AS Success_Rate
FROM tally, (VALUES ('Phase 1 to 2'), ('Overall Program Completion')) steps(step)"""


# ---------------------------------------------------------------- r4_2 exit status
@report("r4_2")
def exit_status_distribution(t) -> DataFrame:
    e = t["enrollment"].where(F.col("end_status").isNotNull())
    g = e.groupBy("end_status").agg(F.count(ONE).alias("Participant_Count"),
                                    F.avg("length_days").alias("_avg"))
    total = g.agg(F.sum("Participant_Count").alias("_all"))
    return (with_total(g, total)
            .select(F.col("end_status").alias("End_Status"), "Participant_Count",
                    pct("Participant_Count", "_all").alias("Percentage"),
                    round_real("_avg", 1).alias("Average_Length_Days"))
            .orderBy(F.desc("Participant_Count"), "End_Status"))


SQL["r4_2"] = sql_with("enrollment") + f"""
SELECT e.end_status AS End_Status, COUNT(*) AS Participant_Count,
       {sql_pct('COUNT(*)', '(SELECT COUNT(*) FROM enrollment WHERE end_status IS NOT NULL)')} AS Percentage,
       {sql_round_real('AVG(e.length_days)', 1)} AS Average_Length_Days
FROM enrollment e WHERE e.end_status IS NOT NULL
GROUP BY e.end_status"""


# ---------------------------------------------------------------- r4_3 graduation by year
@report("r4_3")
def graduation_by_year(t) -> DataFrame:
    # a date range reaches the scan, year(start_date) would not
    e = t["enrollment"].where(F.col("end_status").isNotNull()
                              & F.col("start_date").between("2023-01-01", "2024-12-31"))
    g = (e.groupBy(year_band("start_date", GRADUATION_YEAR_BANDS, "Other Years").alias("Fiscal_Year"))
         .agg(F.count(ONE).alias("Total_Participants"),
              F.sum(flag(F.col("end_status") == "Graduated")).alias("Graduated"),
              F.sum(flag(F.col("end_status") == "Terminated")).alias("Terminated")))
    return (g.select("Fiscal_Year", "Total_Participants", "Graduated", "Terminated",
                     pct("Graduated", "Total_Participants").alias("Graduation_Rate"),
                     pct("Terminated", "Total_Participants").alias("Termination_Rate"))
            .orderBy("Fiscal_Year"))


_G = "SUM(CASE WHEN e.end_status = 'Graduated' THEN 1 ELSE 0 END)"
_T = "SUM(CASE WHEN e.end_status = 'Terminated' THEN 1 ELSE 0 END)"
SQL["r4_3"] = sql_with("enrollment") + f"""
SELECT CASE WHEN year(e.start_date) = 2023 THEN 'FY23' WHEN year(e.start_date) = 2024 THEN 'FY24'
            ELSE 'Other Years' END AS Fiscal_Year,
       COUNT(*) AS Total_Participants, CAST({_G} AS BIGINT) AS Graduated, CAST({_T} AS BIGINT) AS Terminated,
       {sql_pct(_G, 'COUNT(*)')} AS Graduation_Rate, {sql_pct(_T, 'COUNT(*)')} AS Termination_Rate
FROM enrollment e
WHERE e.end_status IS NOT NULL AND year(e.start_date) IN (2023, 2024)
GROUP BY 1"""


# ---------------------------------------------------------------- r4_4 / r4_5 convictions before vs during
def _before_during(per, rows_spec, types) -> DataFrame:
    row = per.agg(F.coalesce(F.sum("nb"), F.lit(0)).cast("long").alias("nb"),
                  F.count(F.when(F.col("nb") > 0, 1)).alias("ib"),
                  F.coalesce(F.sum("nd"), F.lit(0)).cast("long").alias("nd"),
                  F.count(F.when(F.col("nd") > 0, 1)).alias("id"))
    return metric_rows(row, rows_spec, types)


@report("r4_4")
def convictions_before_during(t) -> DataFrame:
    per = charge_windows(t, ["lookback n_conv", "during n_conv"]).withColumnsRenamed({"lookback n_conv": "nb", "during n_conv": "nd"})
    types = {"Period": "string", "Total_Convictions": "long", "Participants_With_Convictions": "long",
             "Avg_Convictions_Per_Participant": "double"}
    return _before_during(per, [
        {"Period": "Before MHC (12 months prior)", "Total_Convictions": F.col("nb"),
         "Participants_With_Convictions": F.col("ib"),
         "Avg_Convictions_Per_Participant": round_ratio("nb", "ib", 2)},
        {"Period": "During MHC Participation", "Total_Convictions": F.col("nd"),
         "Participants_With_Convictions": F.col("id"),
         "Avg_Convictions_Per_Participant": round_ratio("nd", "id", 2)},
    ], types)


def _sql_before_during(charges: str, lookback: str, before: str, during: str) -> str:
    """CTEs: one row per (charge, enrolment) pair and period that the charge falls into."""
    return f"""
, periods(period) AS (VALUES ('{before}'), ('{during}')),
placed AS (
  SELECT participant_id, unnest([
           CASE WHEN {lookback} THEN '{before}' END,
           CASE WHEN charge_date BETWEEN start_date AND coalesce(end_date, charge_date) THEN '{during}' END]) AS period
  FROM ({charges}) JOIN enrollment USING (participant_id)),
tally AS (SELECT period, count(participant_id) AS n, count(DISTINCT participant_id) AS ids
          FROM periods LEFT JOIN placed USING (period) GROUP BY period)
"""


SQL["r4_4"] = sql_with("participant_charge", "enrollment") + _sql_before_during(
    "SELECT participant_id, charge_date FROM participant_charge WHERE outcome = 'Convicted'",
    "date_diff('day', charge_date, start_date) BETWEEN 1 AND 365",
    "Before MHC (12 months prior)", "During MHC Participation") + f"""
SELECT period AS Period, n AS Total_Convictions, ids AS Participants_With_Convictions,
       {sql_round_ratio('n', 'ids', 2)} AS Avg_Convictions_Per_Participant FROM tally"""


@report("r4_5")
def felony_before_during(t) -> DataFrame:
    felonies = classed_charges(t).where(F.col("convicted") & (F.col("class") == "F"))
    days = event_days(felonies, PID, "charge_date", {"n": F.lit(1)})
    each = F.lit(1)
    sums = {"nb": ("before", None, "n", each), "nd": ("during", None, "n", each)}
    per = once(t, "felony_windows", lambda: windowed_sums(t["enrollment"], days, sums))
    types = {"Category": "string", "Conviction_Count": "long", "Participants": "long"}
    return _before_during(per, [
        {"Category": "Felony Convictions Before MHC", "Conviction_Count": F.col("nb"),
         "Participants": F.col("ib")},
        {"Category": "Felony Convictions During MHC", "Conviction_Count": F.col("nd"),
         "Participants": F.col("id")},
    ], types)


SQL["r4_5"] = sql_with("participant_charge", "enrollment", "charge_offense") + _sql_before_during(
    "SELECT participant_id, charge_date FROM participant_charge JOIN charge_offense USING (offense_id) "
    "WHERE outcome = 'Convicted' AND class = 'F'", "charge_date < start_date",
    "Felony Convictions Before MHC", "Felony Convictions During MHC") + """
SELECT period AS Category, n AS Conviction_Count, ids AS Participants FROM tally"""


# ---------------------------------------------------------------- r4_6 no charge during
@report("r4_6")
def charge_free_during(t) -> DataFrame:
    # EXISTS / NOT EXISTS per enrolment.  A subject counts as "with" if any of its enrolments
    # holds a charge and as "without" if any does not (both can hold with several enrolments, as in SQL).
    e = t["enrollment"]
    per = run_windows(t).where("any_hit is not null") if hasattr(t, "once") else held_intervals(e, charge_days(t))
    counts = per.agg(F.count(F.when(F.col("all_hit") == 0, 1)).alias("n0"),
                     F.count(F.when(F.col("any_hit") == 1, 1)).alias("n1"))
    total = e.agg(F.count(ONE).alias("m"))
    row = one_row(counts, total)
    types = {"Category": "string", "Participant_Count": "long", "Percentage": "double"}
    return metric_rows(row, [
        {"Category": "Participants with NO Charges During MHC", "Participant_Count": F.col("n0"),
         "Percentage": pct_unrounded("n0", "m")},
        {"Category": "Participants with Charges During MHC", "Participant_Count": F.col("n1"),
         "Percentage": pct_unrounded("n1", "m")},
    ], types)


SQL["r4_6"] = sql_with("participant_charge", "enrollment") + f"""
, marked AS (
  SELECT participant_id, start_date, end_date,
         coalesce(bool_or(charge_date BETWEEN start_date AND coalesce(end_date, charge_date)), FALSE) AS charged
  FROM enrollment LEFT JOIN participant_charge USING (participant_id) GROUP BY ALL),
kinds(label, want) AS (VALUES ('Participants with NO Charges During MHC', FALSE), ('Participants with Charges During MHC', TRUE)),
tally AS (SELECT label, count(DISTINCT participant_id) AS n FROM kinds LEFT JOIN marked ON charged = want GROUP BY label)
SELECT label AS Category, n AS Participant_Count,
       {sql_pct_unrounded('n', '(SELECT count(*) FROM enrollment)')} AS Percentage FROM tally"""


# ---------------------------------------------------------------- r4_7 jail days
@report("r4_7")
def jail_days(t) -> DataFrame:
    jd = t["jail_data"].where(F.col("days_incarcerated").isNotNull())
    per = jd.groupBy(PID).agg(F.sum("days_incarcerated").alias("s"), F.count(ONE).alias("c"))
    ja = per.agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.count(PID).alias("ids"))
    row = one_row(ja, t["enrollment"].agg(F.count(ONE).alias("m")))
    types = {"Metric": "string", "Value": "double", "Participants_Affected": "long"}
    return metric_rows(row, [
        {"Metric": "Total Jail Days During MHC", "Value": F.col("s"), "Participants_Affected": F.col("ids")},
        {"Metric": "Average Jail Days Per Incarcerated Participant",
         "Value": round_real(F.col("s") / F.col("c"), 1)},
        {"Metric": "Percentage of Participants with Jail Time During MHC", "Value": pct("ids", "m")},
    ], types)


SQL["r4_7"] = sql_with("jail_data", "enrollment") + f"""
, days AS (SELECT sum(days_incarcerated) AS total, avg(days_incarcerated) AS mean, count(DISTINCT participant_id) AS ids
           FROM jail_data WHERE days_incarcerated IS NOT NULL)
SELECT unnest([
  {{'Metric': 'Total Jail Days During MHC', 'Value': total, 'Participants_Affected': ids}},
  {{'Metric': 'Average Jail Days Per Incarcerated Participant', 'Value': {sql_round_real('mean', 1)}, 'Participants_Affected': NULL}},
  {{'Metric': 'Percentage of Participants with Jail Time During MHC',
    'Value': {sql_pct('ids', '(SELECT count(*) FROM enrollment)')}, 'Participants_Affected': NULL}}], recursive := true)
FROM days"""


# ---------------------------------------------------------------- r4_8 cost savings
@report("r4_8")
def cost_savings(t) -> DataFrame:
    row = cost_model(t["jail_data"], t["enrollment"])
    return metric_rows(row, [
        {"Metric": "Estimated Jail Cost Savings During MHC", "Value": F.col("actual_cost")},
        {"Metric": "Potential Cost Without MHC (Based on Before Rates)", "Value": F.col("projected_cost")},
        {"Metric": "Estimated Net Cost Savings", "Value": F.col("net_savings")},
    ], {"Metric": "string", "Value": "double"})


SQL["r4_8"] = sql_with("jail_data", "enrollment") + f"""
, jail AS (SELECT sum(days_incarcerated) * {DAILY_JAIL_COST} AS spent, avg(days_incarcerated) * {DAILY_JAIL_COST} AS each
           FROM jail_data),
model AS (SELECT spent, n * stay / 365.0 * each * {BEFORE_RATE_UPLIFT} AS without
          FROM jail, (SELECT count(*) AS n, avg(length_days) AS stay FROM enrollment))
SELECT unnest([
  {{'Metric': 'Estimated Jail Cost Savings During MHC', 'Value': {sql_round_real('spent', 2)}}},
  {{'Metric': 'Potential Cost Without MHC (Based on Before Rates)', 'Value': {sql_round_real('without', 2)}}},
  {{'Metric': 'Estimated Net Cost Savings', 'Value': {sql_round_real('(without - spent)', 2)}}}], recursive := true)
FROM model"""


# ---------------------------------------------------------------- r4_9 post-programme outcomes
@report("r4_9")
def post_programme_outcomes(t, followup_days: int = FOLLOWUP_DAYS) -> DataFrame:
    e = t["enrollment"].where(F.col("end_status").isin("Graduated", "Terminated") & F.col("end_date").isNotNull()
                              & F.col(PID).isNotNull())
    kinds = {"Graduates": "Graduated", "Terminated Participants": "Terminated"}
    ends = {k: flag(F.col("end_status") == v) for k, v in kinds.items()}
    names = {f"{v} {m}": f"{k} {m}" for k, v in (("Graduates", "grad"), ("Terminated Participants", "term")) for m in ("n", "n_conv")}
    per = charge_windows(t, list(names), followup_days).withColumnsRenamed(names)
    people = e.groupBy(PID).agg(*[F.max(c).alias(k) for k, c in ends.items()])
    flags = people.join(per, PID, "left").select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("Group_Type"), F.col(k).alias("in"), flag(F.col(f"{k} n") > 0).alias("any"),
                 flag(F.col(f"{k} n_conv") > 0).alias("conv")) for k in kinds]))).where("in = 1")
    g = flags.groupBy("Group_Type").agg(
        F.count(ONE).alias("Participant_Count"),
        F.sum("any").cast("long").alias("Participants_With_Post_MHC_Charges"),
        F.sum("conv").cast("long").alias("Participants_With_Post_MHC_Convictions"))
    return g.select("Group_Type", "Participant_Count", "Participants_With_Post_MHC_Charges",
                    "Participants_With_Post_MHC_Convictions",
                    pct("Participants_With_Post_MHC_Charges", "Participant_Count")
                    .alias("Percentage_With_Post_MHC_Charges"))


SQL["r4_9"] = sql_with("participant_charge", "enrollment") + f"""
, people AS (
  SELECT CASE end_status WHEN 'Graduated' THEN 'Graduates' ELSE 'Terminated Participants' END AS kind, participant_id,
         max(CASE WHEN date_diff('day', end_date, charge_date) BETWEEN 1 AND 365 THEN 1 ELSE 0 END) AS again,
         max(CASE WHEN date_diff('day', end_date, charge_date) BETWEEN 1 AND 365 AND outcome = 'Convicted'
                  THEN 1 ELSE 0 END) AS guilty
  FROM enrollment LEFT JOIN participant_charge USING (participant_id)
  WHERE end_status IN ('Graduated', 'Terminated') AND end_date IS NOT NULL AND participant_id IS NOT NULL GROUP BY ALL)
SELECT kind AS Group_Type, count(*) AS Participant_Count,
       CAST(sum(again) AS BIGINT) AS Participants_With_Post_MHC_Charges,
       CAST(sum(guilty) AS BIGINT) AS Participants_With_Post_MHC_Convictions,
       {sql_pct('sum(again)', 'count(*)')} AS Percentage_With_Post_MHC_Charges
FROM people GROUP BY kind"""
