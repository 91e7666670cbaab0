"""Ad-hoc example queries (x1 .. x6) over person-level views of the canonical tables.

Each view is a ``*_view`` function with a SQL twin.  Views that count people have one row per
person and value, so several enrolments or assessments never count a person twice.
Relative-date filters use an explicit as-of date instead of the wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import ONE, flag
from ..functions.bands import age_at, numeric_band
from ..functions.intervals import recent
from ..operators.metrics import one_row
from ..sources.bindings import sql_with
from .section1 import classed_charges

SPARK: dict = {}
SQL: dict = {}

# ---- fixed values: as-of date of the relative-date sample queries ----
AS_OF = "2024-02-01"
PID = "participant_id"


def report(name):
    def deco(fn):
        SPARK[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- derived views
def patients_view(t) -> DataFrame:
    """patient_id, name, age (whole years at the first enrolment; NULL without one)."""
    p = t["participant"]
    e = t["enrollment"].groupBy(PID).agg(F.min("start_date").alias("start_date"))
    return (p.join(e, PID, "left")
            .select(F.col(PID).alias("patient_id"),
                    F.concat_ws(" ", "first_name", "last_name").alias("name"),
                    age_at("start_date", "date_of_birth").alias("age")))


_PATIENTS_SQL = """patients AS (
  SELECT p.participant_id AS patient_id, concat_ws(' ', p.first_name, p.last_name) AS name,
         CAST(trunc(date_diff('day', p.date_of_birth, e.start_date) / 365.25) AS INTEGER) AS age
  FROM participant p LEFT JOIN (SELECT participant_id, MIN(start_date) AS start_date FROM enrollment
                                GROUP BY participant_id) e ON p.participant_id = e.participant_id)"""


def diagnosed_people_view(t, as_of: str = AS_OF) -> DataFrame:
    """One row per (person, diagnosis code): the code's name, the person's highest risk score as
    severity and an 'active' status when last assessed within the year before ``as_of``."""
    pd = (t["participant_diagnosis"].groupBy(PID, "diagnosis_code")
          .agg(F.max("assessment_date").alias("assessment_date")))
    dc = t["diagnosis_code"].groupBy("code").agg(F.min("description").alias("description"))
    ra = t["risk_assessment"].groupBy(PID).agg(F.max("risk_score").alias("risk_score"))
    return (pd.join(dc, pd.diagnosis_code == dc.code, "left").join(ra, PID)
            .select(PID, "diagnosis_code", F.col("description").alias("diagnosis_name"),
                    F.col("risk_score").alias("severity_score"),
                    F.when(recent("assessment_date", as_of, 365), "active").otherwise("inactive")
                    .alias("status")))


_DIAGNOSED_SQL = f"""seen AS (
  SELECT participant_id, diagnosis_code,
         COALESCE(MAX(assessment_date) >= DATE '{AS_OF}' - INTERVAL 365 DAY, FALSE) AS active
  FROM participant_diagnosis GROUP BY ALL),
named AS (SELECT code, MIN(description) AS diagnosis_name FROM diagnosis_code GROUP BY code),
worst AS (SELECT participant_id, MAX(risk_score) AS severity_score FROM risk_assessment GROUP BY participant_id)"""


def treatment_sessions_view(t) -> DataFrame:
    """One session per episode: id from its descriptive columns, progress = duration days."""
    te = t["treatment_episode"]
    return te.select(F.col(PID).alias("patient_id"),
                     F.concat_ws("|", "treatment_type", "service_type", "provider",
                                 F.col("start_date").cast("string")).alias("session_id"),
                     F.col("start_date").alias("session_date"),
                     F.date_diff(F.col("end_date"), F.col("start_date")).alias("progress_score"))


_TS_SQL = """treatment_sessions AS (
  SELECT participant_id AS patient_id,
         concat_ws('|', treatment_type, service_type, provider, CAST(start_date AS VARCHAR)) AS session_id,
         start_date AS session_date, date_diff('day', start_date, end_date) AS progress_score
  FROM treatment_episode)"""


# ---------------------------------------------------------------- x1 age groups
@report("x1")
def patients_by_age_group(t) -> DataFrame:
    return (patients_view(t).groupBy(numeric_band("age").alias("age_group"))
            .agg(F.count(ONE).alias("patient_count"))
            .orderBy(F.desc("patient_count"), "age_group"))


SQL["x1"] = sql_with("participant", "enrollment") + ", " + _PATIENTS_SQL + """,
banded AS (SELECT CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 18 THEN 'Under 18' WHEN age <= 30 THEN '18-30'
                       WHEN age <= 50 THEN '31-50' ELSE 'Over 50' END AS age_group FROM patients)
SELECT age_group, count(*) AS patient_count FROM banded GROUP BY age_group"""


# ---------------------------------------------------------------- x2 active diagnoses
@report("x2")
def active_diagnoses(t, as_of: str = AS_OF) -> DataFrame:
    m = diagnosed_people_view(t, as_of).where(F.col("status") == "active")
    return (m.groupBy("diagnosis_code", "diagnosis_name")
            .agg(F.count(ONE).alias("patient_count"), F.avg("severity_score").alias("avg_severity"))
            .orderBy(F.desc("patient_count"), "diagnosis_code"))


SQL["x2"] = sql_with("participant_diagnosis", "diagnosis_code", "risk_assessment") + ", " + _DIAGNOSED_SQL + """
SELECT diagnosis_code, diagnosis_name, COUNT(DISTINCT participant_id) AS patient_count, AVG(severity_score) AS avg_severity
FROM seen JOIN worst USING (participant_id) LEFT JOIN named ON diagnosis_code = code
WHERE active GROUP BY ALL"""


# ---------------------------------------------------------------- x3 offense span
@report("x3")
def offense_span(t) -> DataFrame:
    # count, min and max decompose: reduce per offense id, then join the few rows left.  A run of many
    # reports has joined the charges and holds them by offense, so they are reduced where they are
    span = [F.count(ONE).alias("n"), F.min("charge_date").alias("lo"), F.max("charge_date").alias("hi")]
    if hasattr(t, "once"):
        per = classed_charges(t).where("known = 1").groupBy("offense_name", "class").agg(*span)
    else:
        per = t["participant_charge"].groupBy("offense_id").agg(*span).join(t["charge_offense"], "offense_id")
    return (per.groupBy(F.col("offense_name").alias("offense_type"), F.col("class").alias("severity_level"))
            .agg(F.sum("n").alias("offense_count"), F.min("lo").alias("earliest_offense"),
                 F.max("hi").alias("latest_offense"))
            .orderBy(F.desc("offense_count"), "offense_type", "severity_level"))


SQL["x3"] = sql_with("participant_charge", "charge_offense") + """
SELECT offense_name AS offense_type, class AS severity_level, COUNT(*) AS offense_count,
       MIN(charge_date) AS earliest_offense, MAX(charge_date) AS latest_offense
FROM participant_charge JOIN charge_offense USING (offense_id) GROUP BY ALL"""


# ---------------------------------------------------------------- x4 recent progress
@report("x4")
def recent_progress(t, as_of: str = AS_OF, days: int = 90, min_sessions: int = 5) -> DataFrame:
    s = treatment_sessions_view(t).where(recent("session_date", as_of, days))
    # pre-aggregate sessions per patient (one row per patient) before the join; repeated
    # patient rows change neither COUNT(DISTINCT), the average nor the range, so the
    # join uses the distinct (patient, name) pairs
    per = (s.groupBy("patient_id")
           .agg(F.count_distinct("session_id").alias("total_sessions"),
                F.sum(F.col("progress_score").cast("long")).alias("_s"),
                F.count("progress_score").alias("_c"),
                (F.max("progress_score") - F.min("progress_score")).cast("long").alias("progress_range")))
    p = patients_view(t).select("patient_id", "name").distinct()
    j = p.join(per, "patient_id")
    return (j.where(F.col("total_sessions") >= min_sessions)
            .select("patient_id", "name", "total_sessions",
                    F.try_divide(F.col("_s").cast("double"), F.col("_c").cast("double")).alias("avg_progress"),
                    "progress_range")
            .orderBy(F.desc_nulls_last("avg_progress"), "patient_id"))


SQL["x4"] = (sql_with("participant", "enrollment", "treatment_episode") + ", " + _PATIENTS_SQL + ", "
             + _TS_SQL + f""",
busy AS (SELECT patient_id, count(DISTINCT session_id) AS total_sessions, avg(progress_score) AS avg_progress,
                max(progress_score) - min(progress_score) AS progress_range
         FROM treatment_sessions WHERE date_diff('day', session_date, DATE '{AS_OF}') <= 90 GROUP BY patient_id)
SELECT patient_id, name, total_sessions, avg_progress, progress_range
FROM busy JOIN (SELECT DISTINCT patient_id, name FROM patients) USING (patient_id) WHERE total_sessions >= 5""")


# ---------------------------------------------------------------- x5 recent risk by level
def risk_outcomes_view(t, as_of: str = AS_OF) -> DataFrame:
    """Risk rows with age at ``as_of``, re-entry into treatment and jail incident flags."""
    ra = t["risk_assessment"]
    p = t["participant"].select(PID, "date_of_birth")
    treated = t["treatment_episode"].groupBy(PID).agg(F.lit(1).alias("readmitted"))
    jailed = t["jail_data"].groupBy(PID).agg(F.lit(1).alias("incident_occurred"))
    return (ra.join(p, PID, "left").join(treated, PID, "left").join(jailed, PID, "left")
            .select(F.col("risk_category").alias("risk_level"), "risk_score", "assessment_date",
                    age_at(F.lit(as_of).cast("date"), "date_of_birth").alias("age"),
                    F.coalesce("readmitted", F.lit(0)).alias("readmitted"),
                    F.coalesce("incident_occurred", F.lit(0)).alias("incident_occurred")))


@report("x5")
def recent_risk_by_level(t, as_of: str = AS_OF, days: int = 365) -> DataFrame:
    r = risk_outcomes_view(t, as_of).where(recent("assessment_date", as_of, days))
    return (r.groupBy("risk_level")
            .agg(F.count(ONE).alias("patient_count"), F.avg("age").alias("avg_age"),
                 F.avg("risk_score").alias("avg_risk_score"),
                 F.sum(flag(F.col("readmitted") == 1)).alias("readmissions"),
                 F.sum(flag(F.col("incident_occurred") == 1)).alias("incidents"))
            .orderBy(F.desc("avg_risk_score"), F.asc_nulls_first("risk_level")))


SQL["x5"] = sql_with("risk_assessment", "participant", "treatment_episode", "jail_data") + f"""
, treated AS (SELECT DISTINCT participant_id, 1 AS treated FROM treatment_episode),
held AS (SELECT DISTINCT participant_id, 1 AS held FROM jail_data),
lately AS (SELECT risk_category, risk_score, treated, held,
                  CAST(trunc(date_diff('day', date_of_birth, DATE '{AS_OF}') / 365.25) AS INTEGER) AS age
           FROM risk_assessment LEFT JOIN participant USING (participant_id) LEFT JOIN treated USING (participant_id)
                LEFT JOIN held USING (participant_id)
           WHERE date_diff('day', assessment_date, DATE '{AS_OF}') <= 365)
SELECT risk_category AS risk_level, count(*) AS patient_count, avg(age) AS avg_age, avg(risk_score) AS avg_risk_score,
       count(treated) AS readmissions, count(held) AS incidents
FROM lately GROUP BY risk_category"""


# ---------------------------------------------------------------- x6 smoke counts
@report("x6")
def row_counts(t) -> DataFrame:
    a = t["participant"].agg(F.count(ONE).alias("Participants"))
    b = t["participant_charge"].agg(F.count(ONE).alias("Charges"))
    c = t["treatment_episode"].agg(F.count(ONE).alias("Treatment_Episodes"))
    return (one_row(a, b, c)
            .select(F.lit("Tables working").alias("Status"), "Participants", "Charges",
                    "Treatment_Episodes"))


SQL["x6"] = sql_with("participant", "participant_charge", "treatment_episode") + """
SELECT 'Tables working' AS Status, p.n AS Participants, c.n AS Charges, e.n AS Treatment_Episodes
FROM (SELECT count(*) AS n FROM participant) p, (SELECT count(*) AS n FROM participant_charge) c,
     (SELECT count(*) AS n FROM treatment_episode) e"""
