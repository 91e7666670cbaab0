"""Section 2 — mental-health characteristics (r2_1 .. r2_8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import ONE
from ..functions.bands import TREND_YEAR_BANDS, count_band, delimited_count, year_band
from ..functions.numeric import pct, sql_pct
from ..functions.text import (ANXIETY_WORDS, BIPOLAR_WORDS, PTSD_TREND_WORDS, PTSD_WORDS,
                              has_any_keyword, has_no_keyword)
from ..operators.metrics import metric_rows, one_row, per_subject_flags, with_total
from ..sources.bindings import sql_with

SPARK: dict = {}
SQL: dict = {}


def report(name):
    def deco(fn):
        SPARK[name] = fn
        return fn
    return deco


DESC = "diagnosis_description"
PID = "participant_id"


def _like_any(col: str, words) -> str:
    return "(" + " OR ".join(f"upper({col}) LIKE '%{w}%'" for w in words) + ")"


def _not_like_all(col: str, words) -> str:
    return "(" + " AND ".join(f"upper({col}) NOT LIKE '%{w}%'" for w in words) + ")"


# ---------------------------------------------------------------- r2_1 distribution
@report("r2_1")
def diagnosis_distribution(t) -> DataFrame:
    pd = t["participant_diagnosis"]
    per = pd.where(F.col(DESC).isNotNull()).select(DESC, PID).distinct()
    g = per.groupBy(DESC).agg(F.count(PID).alias("Participant_Count"))
    denom = pd.agg(F.count_distinct(PID).alias("_all"))
    return (with_total(g, denom)
            .select(F.col(DESC).alias("Diagnosis"), "Participant_Count",
                    pct("Participant_Count", "_all").alias("Percentage"))
            .orderBy(F.desc("Participant_Count"), "Diagnosis"))


SQL["r2_1"] = sql_with("participant_diagnosis") + f"""
SELECT pd.diagnosis_description AS Diagnosis,
       COUNT(DISTINCT pd.participant_id) AS Participant_Count,
       {sql_pct('COUNT(DISTINCT pd.participant_id)',
                '(SELECT COUNT(DISTINCT participant_id) FROM participant_diagnosis)')} AS Percentage
FROM participant_diagnosis pd
WHERE pd.diagnosis_description IS NOT NULL
GROUP BY pd.diagnosis_description"""


# ---------------------------------------------------------------- r2_2..r2_4 keyword prevalence
def _prevalence(t, flags: dict) -> DataFrame:
    """One row: per-subject flags summed, plus the number of assessed subjects."""
    per = per_subject_flags(t["participant_diagnosis"], [PID], flags)
    return per.agg(F.count(ONE).alias("total"),
                   *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags])


@report("r2_2")
def ptsd_prevalence(t) -> DataFrame:
    row = _prevalence(t, {"has": has_any_keyword(DESC, PTSD_WORDS),
                          "has_not": has_no_keyword(DESC, PTSD_WORDS)})
    types = {"Category": "string", "Count": "long", "Total_Assessed": "long", "Percentage": "double"}
    return metric_rows(row, [
        {"Category": "PTSD Cases", "Count": F.col("has"), "Total_Assessed": F.col("total"),
         "Percentage": pct("has", "total")},
        {"Category": "Non-PTSD Cases", "Count": F.col("has_not"), "Total_Assessed": F.col("total"),
         "Percentage": pct("has_not", "total")},
    ], types)


def _sql_prevalence_arm(label: str, cond: str, label_col: str, count_col: str) -> str:
    d = "pd.participant_id"
    hit = f"COUNT(DISTINCT CASE WHEN {cond} THEN {d} END)"
    return f"""SELECT '{label}' AS {label_col}, {hit} AS {count_col},
       COUNT(DISTINCT {d}) AS Total_Assessed,
       {sql_pct(hit, f'COUNT(DISTINCT {d})')} AS Percentage
FROM participant_diagnosis pd"""


SQL["r2_2"] = sql_with("participant_diagnosis") + \
    _sql_prevalence_arm("PTSD Cases", _like_any("pd.diagnosis_description", PTSD_WORDS), "Category", "Count") + \
    "\nUNION ALL\n" + \
    _sql_prevalence_arm("Non-PTSD Cases", _not_like_all("pd.diagnosis_description", PTSD_WORDS),
                        "Category", "Count")


def _single_prevalence(t, label: str, words) -> DataFrame:
    row = _prevalence(t, {"has": has_any_keyword(DESC, words)})
    return row.select(F.lit(label).alias("Diagnosis"), F.col("has").alias("Participant_Count"),
                      F.col("total").alias("Total_Assessed"), pct("has", "total").alias("Percentage"))


@report("r2_3")
def bipolar_prevalence(t) -> DataFrame:
    return _single_prevalence(t, "Bipolar Disorder", BIPOLAR_WORDS)


@report("r2_4")
def anxiety_prevalence(t) -> DataFrame:
    return _single_prevalence(t, "Anxiety Disorders", ANXIETY_WORDS)


SQL["r2_3"] = sql_with("participant_diagnosis") + _sql_prevalence_arm(
    "Bipolar Disorder", _like_any("pd.diagnosis_description", BIPOLAR_WORDS), "Diagnosis",
    "Participant_Count")
SQL["r2_4"] = sql_with("participant_diagnosis") + _sql_prevalence_arm(
    "Anxiety Disorders", _like_any("pd.diagnosis_description", ANXIETY_WORDS), "Diagnosis",
    "Participant_Count")


# ---------------------------------------------------------------- r2_5 complexity
@report("r2_5")
def diagnosis_complexity(t) -> DataFrame:
    pd = t["participant_diagnosis"]
    band = F.when(F.col(DESC).isNotNull(), count_band(delimited_count(DESC)))
    g = pd.groupBy(band.alias("Diagnosis_Complexity")).agg(F.count(ONE).alias("Participant_Count"))
    # denominator counts every row, NULL text included: it is the sum over all groups
    total = g.agg(F.sum("Participant_Count").alias("_all"))
    return (with_total(g, total).where(F.col("Diagnosis_Complexity").isNotNull())
            .select("Diagnosis_Complexity", "Participant_Count",
                    pct("Participant_Count", "_all").alias("Percentage"))
            .orderBy(F.desc("Participant_Count"), "Diagnosis_Complexity"))


_N_ITEMS = ("(length(diagnosis_description) - length(replace(diagnosis_description, ',', '')) + 1)")

SQL["r2_5"] = sql_with("participant_diagnosis") + f"""
SELECT CASE WHEN {_N_ITEMS} >= 3 THEN '3+ Diagnoses' WHEN {_N_ITEMS} = 2 THEN '2 Diagnoses'
            ELSE '1 Diagnosis' END AS Diagnosis_Complexity,
       COUNT(*) AS Participant_Count,
       {sql_pct('COUNT(*)', '(SELECT COUNT(*) FROM participant_diagnosis)')} AS Percentage
FROM participant_diagnosis
WHERE diagnosis_description IS NOT NULL
GROUP BY 1"""


# ---------------------------------------------------------------- r2_6 graduation by condition
@report("r2_6")
def graduation_by_condition(t) -> DataFrame:
    # The SQL joins participant x enrollment x diagnosis and sums over joined rows (fan-out
    # kept, P10).  Each side is pre-aggregated per subject first, so the joins are
    # one-row-per-subject and co-partitioned on the id; the joined-row sums are products.
    p = t["participant"].groupBy(PID).agg(F.count(ONE).alias("np"))
    e = t["enrollment"].groupBy(PID).agg(
        F.count(ONE).alias("ne"),
        F.sum(F.when(F.col("end_status") == "Graduated", 1).otherwise(0)).alias("ng"))
    d = t["participant_diagnosis"].groupBy(PID).agg(
        F.count(ONE).alias("nd"),
        F.sum(F.when(has_any_keyword(DESC, ["PTSD"]), 1).otherwise(0)).alias("n_ptsd"),
        F.sum(F.when(has_any_keyword(DESC, ["BIPOLAR"]), 1).otherwise(0)).alias("n_bip"))
    j = p.join(e, PID).join(d, PID)
    def arm(k):
        return (F.count(F.when(F.col(k) > 0, 1)),
                F.sum(F.when(F.col(k) > 0, F.col("np") * F.col("ng") * (F.col(k) if k != "nd" else F.lit(1)))))
    aggs = []
    for k in ("n_ptsd", "n_bip", "nd"):
        c, g = arm(k)
        aggs += [c.alias(f"{k}_c"), g.alias(f"{k}_g")]
    row = j.agg(*aggs)
    types = {"Condition": "string", "Total_With_Condition": "long", "Graduated": "long",
             "Graduation_Rate": "double"}
    rows = []
    for label, k in (("PTSD Present", "n_ptsd"), ("Bipolar Present", "n_bip"), ("Any MH Diagnosis", "nd")):
        rows.append({"Condition": label, "Total_With_Condition": F.col(f"{k}_c"),
                     "Graduated": F.col(f"{k}_g"), "Graduation_Rate": pct(f"{k}_g", f"{k}_c")})
    return metric_rows(row, rows, types)


SQL["r2_6"] = sql_with("participant", "enrollment", "participant_diagnosis") + f"""
, exits AS (SELECT participant_id, end_status = 'Graduated' AS done FROM participant JOIN enrollment USING (participant_id)),
kinds(label, word) AS (VALUES ('PTSD Present', 'PTSD'), ('Bipolar Present', 'BIPOLAR')),
hits AS (SELECT label, participant_id, done FROM exits JOIN participant_diagnosis USING (participant_id)
                JOIN kinds ON contains(upper(diagnosis_description), word)
         UNION ALL
         SELECT 'Any MH Diagnosis', participant_id, done FROM exits SEMI JOIN participant_diagnosis USING (participant_id))
SELECT k.label AS Condition, count(DISTINCT participant_id) AS Total_With_Condition,
       CAST(sum(CASE WHEN hits.label IS NULL THEN NULL WHEN done THEN 1 ELSE 0 END) AS BIGINT) AS Graduated,
       {sql_pct('sum(CASE WHEN done THEN 1 ELSE 0 END)', 'count(DISTINCT participant_id)')} AS Graduation_Rate
FROM (SELECT label FROM kinds UNION ALL SELECT 'Any MH Diagnosis') k LEFT JOIN hits ON k.label = hits.label GROUP BY k.label"""


# ---------------------------------------------------------------- r2_7 treatment engagement
@report("r2_7")
def treatment_engagement(t) -> DataFrame:
    te = t["treatment_episode"].where(F.col("treatment_type").isin("Mental Health", "Chemical Dependency"))
    per = per_subject_flags(te, [PID], {"mh": F.col("treatment_type") == "Mental Health",
                                        "cd": F.col("treatment_type") == "Chemical Dependency"})
    treated = per.agg(F.coalesce(F.sum("mh"), F.lit(0)).alias("mh"),
                      F.coalesce(F.sum("cd"), F.lit(0)).alias("cd"))
    diagnosed = t["participant_diagnosis"].agg(F.count_distinct(PID).alias("dx"))
    row = one_row(treated, diagnosed)
    types = {"Treatment_Type": "string", "Participants_Treated": "long", "Total_Diagnosed": "long",
             "Engagement_Rate": "double"}
    return metric_rows(row, [
        {"Treatment_Type": "Mental Health Treatment", "Participants_Treated": F.col("mh"),
         "Total_Diagnosed": F.col("dx"), "Engagement_Rate": pct("mh", "dx")},
        {"Treatment_Type": "Chemical Dependency Treatment", "Participants_Treated": F.col("cd"),
         "Total_Diagnosed": F.col("dx"), "Engagement_Rate": pct("cd", "dx")},
    ], types)


def _sql_engagement_arm(label: str, ttype: str) -> str:
    dx = "(SELECT COUNT(DISTINCT participant_id) FROM participant_diagnosis)"
    return f"""SELECT '{label}' AS Treatment_Type, COUNT(DISTINCT te.participant_id) AS Participants_Treated,
       {dx} AS Total_Diagnosed,
       {sql_pct('COUNT(DISTINCT te.participant_id)', dx)} AS Engagement_Rate
FROM treatment_episode te WHERE te.treatment_type = '{ttype}'"""


SQL["r2_7"] = sql_with("treatment_episode", "participant_diagnosis") + \
    _sql_engagement_arm("Mental Health Treatment", "Mental Health") + "\nUNION ALL\n" + \
    _sql_engagement_arm("Chemical Dependency Treatment", "Chemical Dependency")


# ---------------------------------------------------------------- r2_8 PTSD trend by year
@report("r2_8")
def ptsd_trend(t) -> DataFrame:
    p = t["participant"].select(PID)
    e = t["enrollment"].select(PID, "start_date")
    band = year_band("start_date", TREND_YEAR_BANDS)
    # (band, id) with the band's earliest start; participant multiplicity does not change
    # distinct counts or MIN, so an inner join on the id is enough
    pe = (p.join(e, PID).groupBy(band.alias("Enrollment_Year"), PID)
          .agg(F.min("start_date").alias("first_start")))
    ptsd = per_subject_flags(t["participant_diagnosis"], [PID],
                             {"ptsd": has_any_keyword(DESC, PTSD_TREND_WORDS)})
    j = pe.join(ptsd, PID, "left")
    g = j.groupBy("Enrollment_Year").agg(
        F.count(ONE).alias("Total_Participants"),
        F.coalesce(F.sum("ptsd"), F.lit(0)).cast("long").alias("PTSD_Cases"),
        F.min("first_start").alias("_first"))
    return (g.select("Enrollment_Year", "Total_Participants", "PTSD_Cases",
                     pct("PTSD_Cases", "Total_Participants").alias("PTSD_Percentage"), "_first")
            .orderBy("_first").drop("_first"))


_TREND_CASE = """CASE WHEN year(e.start_date) BETWEEN 2019 AND 2020 THEN '2019-2020'
            WHEN year(e.start_date) = 2021 THEN '2021' WHEN year(e.start_date) = 2022 THEN '2022'
            WHEN year(e.start_date) = 2023 THEN '2023' WHEN year(e.start_date) = 2024 THEN '2024'
            ELSE 'Other' END"""
_PTSD_HIT = (f"COUNT(DISTINCT CASE WHEN {_like_any('pd.diagnosis_description', PTSD_TREND_WORDS)} "
             "THEN p.participant_id END)")

SQL["r2_8"] = sql_with("participant", "enrollment", "participant_diagnosis") + f"""
SELECT {_TREND_CASE} AS Enrollment_Year,
       COUNT(DISTINCT p.participant_id) AS Total_Participants,
       {_PTSD_HIT} AS PTSD_Cases,
       {sql_pct(_PTSD_HIT, 'COUNT(DISTINCT p.participant_id)')} AS PTSD_Percentage
FROM participant p JOIN enrollment e ON p.participant_id = e.participant_id
LEFT JOIN participant_diagnosis pd ON p.participant_id = pd.participant_id
GROUP BY 1
ORDER BY MIN(e.start_date)"""
