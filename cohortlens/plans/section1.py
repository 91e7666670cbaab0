"""Section 1 — participant demographics and entry (r1_1 .. r1_6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import ONE, avg_int_rounded
from ..functions.bands import FISCAL_YEAR_BANDS, age_at, band_rank, prefix_band, year_band
from ..functions.numeric import (pct, round_ratio, round_real, sql_pct, sql_round_ratio,
                                 sql_round_real)
from ..operators.metrics import metric_rows, one_row, top_k, with_total
from ..sources.bindings import sql_with
from ..sources.store import once

SPARK: dict = {}
SQL: dict = {}


def report(name):
    def deco(fn):
        SPARK[name] = fn
        return fn
    return deco


PID = "participant_id"


def classed_charges(t) -> DataFrame:
    """Charges with the name and class of their offense, one row for each dimension row (``known``: 1), or one without any,
    and whether they were ``convicted``.  A run of many reports joins them once."""
    known = t["charge_offense"].select("offense_id", "offense_name", "class", F.lit(1).alias("known"))
    charges = lambda: t["participant_charge"].select(
        "offense_id", PID, "charge_date", (F.col("outcome") == "Convicted").alias("convicted"))
    return once(t, "classed_charges", lambda: charges().join(known, "offense_id", "left").drop("offense_id"))


def with_people(top: DataFrame, charges: DataFrame, name: str) -> DataFrame:
    """The rows of ``top`` (offense name and class first) with the different participants of their charges as ``name``.
    Only charges of these offenses are dealt by participant."""
    offense, kind = top.columns[:2]
    theirs = charges.join(top, charges["offense_name"].eqNullSafe(top[offense]) & charges["class"].eqNullSafe(top[kind]))
    per = theirs.select(*[top[c] for c in top.columns], PID).distinct()
    return per.groupBy(*top.columns).agg(F.count(PID).alias(name))


# ---------------------------------------------------------------- r1_1 entries by year
@report("r1_1")
def entries_by_fiscal_year(t) -> DataFrame:
    labels = [b[2] for b in FISCAL_YEAR_BANDS]
    e = t["enrollment"]
    return (e.groupBy(year_band("start_date", FISCAL_YEAR_BANDS).alias("Fiscal_Year"))
            .agg(F.count(ONE).alias("Participant_Count"))
            .orderBy(band_rank("Fiscal_Year", labels + ["Other"])))


SQL["r1_1"] = sql_with("enrollment") + """
SELECT CASE WHEN year(start_date) BETWEEN 2019 AND 2020 THEN 'FY19-20'
            WHEN year(start_date) = 2021 THEN 'FY21' WHEN year(start_date) = 2022 THEN 'FY22'
            WHEN year(start_date) = 2023 THEN 'FY23' WHEN year(start_date) = 2024 THEN 'FY24'
            WHEN year(start_date) = 2025 THEN 'FY25' ELSE 'Other' END AS Fiscal_Year,
       COUNT(*) AS Participant_Count
FROM enrollment GROUP BY 1"""


# ---------------------------------------------------------------- r1_2 age and gender
def _age_rows(t, require_gender: bool) -> DataFrame:
    p = t["participant"].where(F.col("date_of_birth").isNotNull())
    if require_gender:
        p = p.where(F.col("gender").isNotNull())
    p = p.select("participant_id", "gender", "date_of_birth")
    e = t["enrollment"].select("participant_id", "start_date")
    return p.join(e, "participant_id").select("gender", age_at("start_date", "date_of_birth").alias("age"))


@report("r1_2")
def age_gender_at_entry(t) -> DataFrame:
    rows = _age_rows(t, True)
    return (rows.groupBy(prefix_band("gender").alias("Gender_Cleaned"))
            .agg(F.count(ONE).alias("Participant_Count"),
                 avg_int_rounded("age", 1).alias("Average_Age_At_Entry"),
                 F.min("age").alias("Youngest_Age"), F.max("age").alias("Oldest_Age"))
            .orderBy(F.desc("Participant_Count"), "Gender_Cleaned"))


_AGE_SQL = "CAST(trunc(date_diff('day', p.date_of_birth, e.start_date) / 365.25) AS INTEGER)"

SQL["r1_2"] = sql_with("participant", "enrollment") + f"""
SELECT CASE WHEN upper(p.gender) LIKE 'F%' THEN 'Female'
            WHEN upper(p.gender) LIKE 'M%' THEN 'Male' ELSE 'Other' END AS Gender_Cleaned,
       COUNT(*) AS Participant_Count,
       {sql_round_ratio(f'SUM({_AGE_SQL})', f'COUNT({_AGE_SQL})', 1)} AS Average_Age_At_Entry,
       MIN({_AGE_SQL}) AS Youngest_Age,
       MAX({_AGE_SQL}) AS Oldest_Age
FROM participant p JOIN enrollment e ON p.participant_id = e.participant_id
WHERE p.gender IS NOT NULL AND p.date_of_birth IS NOT NULL
GROUP BY 1"""


# ---------------------------------------------------------------- r1_3 race share
@report("r1_3")
def race_share(t) -> DataFrame:
    p = t["participant"].where(F.col("race_ethnicity").isNotNull())
    g = p.groupBy("race_ethnicity").agg(F.count(ONE).alias("Participant_Count"))
    total = g.agg(F.sum("Participant_Count").alias("_total"))
    return (with_total(g, total)
            .select(F.col("race_ethnicity").alias("Race_Ethnicity"), "Participant_Count",
                    pct("Participant_Count", "_total").alias("Percentage"))
            .orderBy(F.desc("Participant_Count"), "Race_Ethnicity"))


SQL["r1_3"] = sql_with("participant") + f"""
, tally AS (SELECT race_ethnicity AS race, count(race_ethnicity) AS n FROM participant GROUP BY ALL),
everyone AS (SELECT sum(n) AS total FROM tally)
SELECT race AS Race_Ethnicity, n AS Participant_Count, {sql_pct('n', 'total')} AS Percentage
FROM tally, everyone WHERE n > 0"""


# ---------------------------------------------------------------- r1_4 offense class
@report("r1_4")
def offense_class_distribution(t) -> DataFrame:
    # the dimension first, then one grouping by (class, id), which also holds the ids of the
    # denominator; n counts dated charges with an offense, so rows without keep n = 0
    counted = F.when(F.col("charge_date").isNotNull(), F.col("known"))
    per = classed_charges(t).groupBy("class", "participant_id").agg(F.count(counted).alias("n"))
    g = per.where("n > 0").groupBy("class").agg(F.sum("n").alias("Total_Charges"),
                                                F.count("participant_id").alias("Participants_With_This_Class"))
    denom = per.agg(F.count_distinct("participant_id").alias("_all"))
    return (with_total(g, denom)
            .select(F.col("class").alias("Class"), "Total_Charges", "Participants_With_This_Class",
                    pct("Participants_With_This_Class", "_all").alias("Percentage_of_Participants"))
            .orderBy(F.desc("Total_Charges"), "Class"))


SQL["r1_4"] = sql_with("participant_charge", "charge_offense") + f"""
, dated AS (SELECT class, participant_id FROM charge_offense JOIN participant_charge USING (offense_id)
            WHERE charge_date IS NOT NULL),
people AS (SELECT count(*) AS m FROM (SELECT participant_id FROM participant_charge
                                      WHERE participant_id IS NOT NULL GROUP BY participant_id)),
tally AS (SELECT class, sum(n) AS n, count(participant_id) AS ids
          FROM (SELECT class, participant_id, count(*) AS n FROM dated GROUP BY ALL) GROUP BY class)
SELECT class AS Class, CAST(n AS BIGINT) AS Total_Charges, ids AS Participants_With_This_Class,
       {sql_pct('ids', 'm')} AS Percentage_of_Participants
FROM tally, people"""


# ---------------------------------------------------------------- r1_5 top offenses
@report("r1_5")
def top_offenses(t) -> DataFrame:
    # the frequency decides which rows are shown, so participants are counted for these; every level
    # is partial, so a hot id or offense is combined map-side
    charges = classed_charges(t).where("known = 1")
    g = (charges.groupBy(F.col("offense_name").alias("Offense_Name"), F.col("class").alias("Class"))
         .agg(F.count(ONE).alias("Frequency")))
    order = [F.desc("Frequency"), F.asc("Offense_Name"), F.asc_nulls_first("Class")]
    return with_people(top_k(g, order, 15), charges, "Unique_Participants").orderBy(*order)


SQL["r1_5"] = sql_with("participant_charge", "charge_offense") + """
, each AS (SELECT offense_name, class, participant_id, count(*) AS n
           FROM charge_offense JOIN participant_charge USING (offense_id) GROUP BY ALL),
ranked AS (SELECT offense_name, class, CAST(sum(n) AS BIGINT) AS n, count(participant_id) AS ids,
                  row_number() OVER (ORDER BY sum(n) DESC, offense_name ASC, class ASC NULLS FIRST) AS place
           FROM each GROUP BY offense_name, class)
SELECT offense_name AS Offense_Name, class AS Class, n AS Frequency, ids AS Unique_Participants
FROM ranked WHERE place <= 15"""


# ---------------------------------------------------------------- r1_6 summary
@report("r1_6")
def demographics_summary(t) -> DataFrame:
    p = t["participant"]
    up = F.upper(F.col("gender"))
    pa = p.agg(F.count(ONE).alias("n_p"),
               F.sum(F.when(up.startswith("M"), 1).otherwise(0)).alias("n_m"),
               F.sum(F.when(up.startswith("F"), 1).otherwise(0)).alias("n_f"))
    ages = _age_rows(t, False).agg(avg_int_rounded("age", 1).alias("avg_age"))
    e = t["enrollment"]
    ea = e.agg(F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start"),
               F.avg("length_days").alias("avg_len"))
    row = one_row(pa, ages, ea)
    ratio = F.concat(round_ratio("n_m", "n_f", 2).cast("string"), F.lit(":1"))
    rows = [
        {"Metric": "Total Participants", "Value": F.col("n_p")},
        {"Metric": "Gender Ratio (Male:Female)", "Value": ratio},
        {"Metric": "Average Age at Entry", "Value": F.col("avg_age")},
        {"Metric": "Earliest Enrollment", "Value": F.col("first_start")},
        {"Metric": "Latest Enrollment", "Value": F.col("last_start")},
        {"Metric": "Average Program Length (Days)", "Value": round_real("avg_len", 1)},
    ]
    return metric_rows(row, rows, {"Metric": "string", "Value": "string"})


SQL["r1_6"] = sql_with("participant", "enrollment") + f"""
SELECT 'Total Participants' AS Metric, CAST(COUNT(*) AS VARCHAR) AS Value FROM participant
UNION ALL
SELECT 'Gender Ratio (Male:Female)',
       CAST({sql_round_ratio("(SELECT COUNT(*) FROM participant WHERE upper(gender) LIKE 'M%')",
                             "(SELECT COUNT(*) FROM participant WHERE upper(gender) LIKE 'F%')", 2)}
            AS VARCHAR) || ':1'
UNION ALL
SELECT 'Average Age at Entry',
       CAST({sql_round_ratio(f'SUM({_AGE_SQL})', f'COUNT({_AGE_SQL})', 1)} AS VARCHAR)
FROM participant p JOIN enrollment e ON p.participant_id = e.participant_id
WHERE p.date_of_birth IS NOT NULL
UNION ALL
SELECT 'Earliest Enrollment', CAST(MIN(start_date) AS VARCHAR) FROM enrollment
UNION ALL
SELECT 'Latest Enrollment', CAST(MAX(start_date) AS VARCHAR) FROM enrollment
UNION ALL
SELECT 'Average Program Length (Days)', CAST({sql_round_real('AVG(length_days)', 1)} AS VARCHAR)
FROM enrollment WHERE length_days IS NOT NULL"""
