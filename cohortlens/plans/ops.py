"""Operator queries over the canonical tables: one key per operator (bands, keywords,
intervals, joins, aggregates, roll-ups, quality checks, catalog), each with its SQL oracle.
Every query runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import (ONE, avg_int_rounded, count_if_sum, distinct_if, flag, pct_true,
                              per_subject, rate, ratio_text, share_of_total)
from ..functions.bands import (FISCAL_YEAR_BANDS, RISK_NORMS, age_at, band_rank, count_band,
                               delimited_count, numeric_band, prefix_band, relabel, year_band)
from ..functions.intervals import recent
from ..functions.numeric import round_real, safe_div, sql_pct, sql_round_ratio, sql_round_real
from ..functions.text import PTSD_WORDS, combo_label, has_any_keyword, has_no_keyword
from ..operators import quality
from ..operators.catalog import column_profile, preview, table_inventory
from ..operators.metrics import (cost_model, metric_rows, one_row, per_subject_summary, pop_stddev,
                                 top_k, with_total, with_total_row)
from ..operators.running import windowed_sums
from ..operators.temporal import (events_in_window, first_event, gap_from_first_event, with_any,
                                  with_event_in_interval, without_event_in_interval)
from ..schema import FOREIGN_KEYS, REQUIRED, SCHEMAS
from ..sources.bindings import sql_with
from .extras import AS_OF, _PATIENTS_SQL, patients_view
from .section3 import charge_days, convicted

SPARK: dict = {}
SQL: dict = {}
PID = "participant_id"


def op(name):
    def deco(fn):
        SPARK[name] = fn
        return fn
    return deco


_YEAR_CASE = """CASE WHEN year(start_date) BETWEEN 2019 AND 2020 THEN 'FY19-20'
            WHEN year(start_date) = 2021 THEN 'FY21' WHEN year(start_date) = 2022 THEN 'FY22'
            WHEN year(start_date) = 2023 THEN 'FY23' WHEN year(start_date) = 2024 THEN 'FY24'
            WHEN year(start_date) = 2025 THEN 'FY25' ELSE 'Other' END"""
_AGE = "CAST(trunc(date_diff('day', p.date_of_birth, e.start_date) / 365.25) AS INTEGER)"
_DURING = "pc.charge_date >= e.start_date AND (pc.charge_date <= e.end_date OR e.end_date IS NULL)"


# ------------------------------------------------------------------ C1-C4 bands and labels
@op("year_band")
def q_year_band(t) -> DataFrame:
    return t["enrollment"].select(PID, "start_date", year_band("start_date", FISCAL_YEAR_BANDS).alias("band"))


SQL["year_band"] = sql_with("enrollment") + f"SELECT participant_id, start_date, {_YEAR_CASE} AS band FROM enrollment"


@op("band_rank")
def q_band_rank(t) -> DataFrame:
    labels = [b[2] for b in FISCAL_YEAR_BANDS] + ["Other"]
    g = t["enrollment"].groupBy(year_band("start_date", FISCAL_YEAR_BANDS).alias("band")).agg(F.count(ONE).alias("n"))
    return g.select("band", band_rank("band", labels).alias("band_rank"), "n").orderBy("band_rank")


SQL["band_rank"] = sql_with("enrollment") + f"""
SELECT band, CASE band WHEN 'FY19-20' THEN 1 WHEN 'FY21' THEN 2 WHEN 'FY22' THEN 3 WHEN 'FY23' THEN 4
                       WHEN 'FY24' THEN 5 WHEN 'FY25' THEN 6 ELSE 7 END AS band_rank, n
FROM (SELECT {_YEAR_CASE} AS band, COUNT(*) AS n FROM enrollment GROUP BY 1) g"""


@op("prefix_band")
def q_prefix_band(t) -> DataFrame:
    return t["participant"].select(PID, "gender", prefix_band("gender").alias("gender_band"))


SQL["prefix_band"] = sql_with("participant") + """
SELECT participant_id, gender, CASE WHEN upper(gender) LIKE 'F%' THEN 'Female'
                                    WHEN upper(gender) LIKE 'M%' THEN 'Male' ELSE 'Other' END AS gender_band
FROM participant"""


@op("relabel")
def q_relabel(t) -> DataFrame:
    return t["risk_assessment"].select(PID, "risk_category",
                                       relabel("risk_category", RISK_NORMS, "Unknown").alias("norm"))


SQL["relabel"] = sql_with("risk_assessment") + """
SELECT participant_id, risk_category,
       CASE risk_category WHEN 'Low' THEN '0-3 (US Norm: 23%)' WHEN 'Medium' THEN '4-6 (US Norm: 38%)'
            WHEN 'High' THEN '7-9 (US Norm: 28%)' WHEN 'Very High' THEN '10+ (US Norm: 11%)'
            ELSE 'Unknown' END AS norm
FROM risk_assessment"""


# ------------------------------------------------------------------ C5-C9 text and numeric bands
_PTSD_ANY = " OR ".join(f"upper(diagnosis_description) LIKE '%{w}%'" for w in PTSD_WORDS)
_PTSD_NONE = " AND ".join(f"upper(diagnosis_description) NOT LIKE '%{w}%'" for w in PTSD_WORDS)


@op("has_any_keyword")
def q_has_any(t) -> DataFrame:
    return t["participant_diagnosis"].select(PID, has_any_keyword("diagnosis_description", PTSD_WORDS).alias("flag"))


SQL["has_any_keyword"] = sql_with("participant_diagnosis") + \
    f"SELECT participant_id, ({_PTSD_ANY}) AS flag FROM participant_diagnosis"


@op("has_no_keyword")
def q_has_none(t) -> DataFrame:
    return t["participant_diagnosis"].select(PID, has_no_keyword("diagnosis_description", PTSD_WORDS).alias("flag"))


SQL["has_no_keyword"] = sql_with("participant_diagnosis") + \
    f"SELECT participant_id, ({_PTSD_NONE}) AS flag FROM participant_diagnosis"


@op("combo_label")
def q_combo(t) -> DataFrame:
    return t["participant_diagnosis"].select(PID, combo_label("diagnosis_description").alias("combination"))


SQL["combo_label"] = sql_with("participant_diagnosis") + """
SELECT participant_id,
       CASE WHEN diagnosis_description ILIKE '%PTSD%' AND diagnosis_description ILIKE '%BIPOLAR%' THEN 'PTSD + Bipolar'
            WHEN diagnosis_description ILIKE '%PTSD%' AND diagnosis_description ILIKE '%ANXIETY%' THEN 'PTSD + Anxiety'
            WHEN diagnosis_description ILIKE '%PTSD%' AND diagnosis_description ILIKE '%DEPRESS%' THEN 'PTSD + Depression'
            WHEN diagnosis_description ILIKE '%BIPOLAR%' AND diagnosis_description ILIKE '%ANXIETY%' THEN 'Bipolar + Anxiety'
            ELSE 'Other Combinations' END AS combination
FROM participant_diagnosis"""


@op("delimited_count")
def q_delim(t) -> DataFrame:
    n = delimited_count("diagnosis_description")
    return t["participant_diagnosis"].select(PID, n.cast("long").alias("n_items"), count_band(n).alias("complexity"))


_N = "(length(diagnosis_description) - length(replace(diagnosis_description, ',', '')) + 1)"
SQL["delimited_count"] = sql_with("participant_diagnosis") + f"""
SELECT participant_id, {_N} AS n_items,
       CASE WHEN {_N} >= 3 THEN '3+ Diagnoses' WHEN {_N} = 2 THEN '2 Diagnoses' ELSE '1 Diagnosis' END AS complexity
FROM participant_diagnosis"""


@op("numeric_band")
def q_numeric_band(t) -> DataFrame:
    return patients_view(t).select("patient_id", "age", numeric_band("age").alias("age_group"))


SQL["numeric_band"] = sql_with("participant", "enrollment") + ", " + _PATIENTS_SQL + """
SELECT patient_id, age, CASE WHEN age < 18 THEN 'Under 18' WHEN age BETWEEN 18 AND 30 THEN '18-30'
            WHEN age BETWEEN 31 AND 50 THEN '31-50' WHEN age > 50 THEN 'Over 50' ELSE 'Unknown' END AS age_group
FROM patients"""


@op("age_at")
def q_age_at(t) -> DataFrame:
    p = t["participant"].select(PID, "date_of_birth")
    return p.join(t["enrollment"].select(PID, "start_date"), PID).select(
        PID, age_at("start_date", "date_of_birth").alias("age"))


SQL["age_at"] = sql_with("participant", "enrollment") + f"""
SELECT p.participant_id, {_AGE} AS age
FROM participant p JOIN enrollment e ON p.participant_id = e.participant_id"""


# ------------------------------------------------------------------ C10-C13 interval predicates
def _window_counts(t, window: str, days: int | None = None) -> DataFrame:
    per = windowed_sums(t["enrollment"], charge_days(t), {"n_charges": (window, days, "n", F.lit(1))})
    return per.where("n_charges > 0")


def _sql_window_counts(cond: str) -> str:
    return sql_with("participant_charge", "enrollment") + f"""
SELECT pc.participant_id, COUNT(*) AS n_charges
FROM participant_charge pc JOIN enrollment e ON pc.participant_id = e.participant_id
WHERE {cond} GROUP BY pc.participant_id"""


@op("in_interval")
def q_in_interval(t) -> DataFrame:
    return _window_counts(t, "during")


SQL["in_interval"] = _sql_window_counts(_DURING)


@op("in_lookback")
def q_in_lookback(t) -> DataFrame:
    return _window_counts(t, "lookback", 365)


SQL["in_lookback"] = _sql_window_counts(
    "pc.charge_date < e.start_date AND date_diff('day', pc.charge_date, e.start_date) <= 365")


@op("in_followup")
def q_in_followup(t) -> DataFrame:
    return _window_counts(t, "followup", 365)


SQL["in_followup"] = _sql_window_counts(
    "pc.charge_date > e.end_date AND date_diff('day', e.end_date, pc.charge_date) <= 365")


@op("recent")
def q_recent(t) -> DataFrame:
    return t["risk_assessment"].where(recent("assessment_date", AS_OF, 365)).select(PID, "assessment_date")


SQL["recent"] = sql_with("risk_assessment") + f"""
SELECT participant_id, assessment_date FROM risk_assessment
WHERE assessment_date >= DATE '{AS_OF}' - INTERVAL 365 DAY"""


# ------------------------------------------------------------------ D6-D12 joins
@op("events_in_window")
def q_events_in_window(t) -> DataFrame:
    pc = t["participant_charge"].select(PID, "charge_date", "outcome")
    e = t["enrollment"].select(PID, "start_date", "end_date")
    return events_in_window(pc, e, "followup", 365).select(PID, "charge_date", "outcome", "end_date")


SQL["events_in_window"] = sql_with("participant_charge", "enrollment") + """
SELECT pc.participant_id, pc.charge_date, pc.outcome, e.end_date
FROM participant_charge pc JOIN enrollment e ON pc.participant_id = e.participant_id
WHERE pc.charge_date > e.end_date AND date_diff('day', e.end_date, pc.charge_date) <= 365"""


@op("with_any")
def q_with_any(t) -> DataFrame:
    return with_any(t["participant"].select(PID, "gender"), t["participant_diagnosis"], PID)


SQL["with_any"] = sql_with("participant", "participant_diagnosis") + """
SELECT p.participant_id, p.gender FROM participant p
WHERE EXISTS (SELECT 1 FROM participant_diagnosis pd WHERE pd.participant_id = p.participant_id)"""


@op("with_event_in_interval")
def q_with_event(t) -> DataFrame:
    e = t["enrollment"].select(PID, "start_date", "end_date")
    return with_event_in_interval(e, t["participant_charge"])


@op("without_event_in_interval")
def q_without_event(t) -> DataFrame:
    e = t["enrollment"].select(PID, "start_date", "end_date")
    return without_event_in_interval(e, t["participant_charge"])


def _sql_exists(neg: str) -> str:
    return sql_with("participant_charge", "enrollment") + f"""
SELECT e.participant_id, e.start_date, e.end_date FROM enrollment e
WHERE {neg} EXISTS (SELECT 1 FROM participant_charge pc WHERE pc.participant_id = e.participant_id AND {_DURING})"""


SQL["with_event_in_interval"] = _sql_exists("")
SQL["without_event_in_interval"] = _sql_exists("NOT")


@op("first_event")
def q_first_event(t) -> DataFrame:
    return first_event(t["participant_charge"])


SQL["first_event"] = sql_with("participant_charge") + """
SELECT participant_id, MIN(charge_date) AS first_date FROM participant_charge
WHERE charge_date IS NOT NULL GROUP BY participant_id"""


@op("gap_from_first_event")
def q_gap(t) -> DataFrame:
    e = t["enrollment"].select(PID, "start_date")
    return gap_from_first_event(e, t["participant_charge"]).select(PID, "start_date", "first_date", "gap_days")


SQL["gap_from_first_event"] = sql_with("participant_charge", "enrollment") + """
SELECT e.participant_id, e.start_date, f.first_date, date_diff('day', f.first_date, e.start_date) AS gap_days
FROM enrollment e JOIN (SELECT participant_id, MIN(charge_date) AS first_date FROM participant_charge
                        WHERE charge_date IS NOT NULL GROUP BY participant_id) f
  ON e.participant_id = f.participant_id"""


@op("with_total")
def q_with_total(t) -> DataFrame:
    p = t["participant"]
    g = p.groupBy("race_ethnicity").agg(F.count(ONE).alias("n"))
    return with_total(g, p.agg(F.count(ONE).alias("total")))


SQL["with_total"] = sql_with("participant") + """
SELECT race_ethnicity, COUNT(*) AS n, (SELECT COUNT(*) FROM participant) AS total
FROM participant GROUP BY race_ethnicity"""


# ------------------------------------------------------------------ E3-E19 aggregates
def _charges_with_class(t) -> DataFrame:
    """Charges per (class, participant).  The join takes two columns of the facts, and AQE splits an offense that holds
    many; reducing them to (participant, offense) first would move nearly as many rows once more."""
    pc = t["participant_charge"].select(PID, "offense_id")
    return (pc.join(t["charge_offense"].select("offense_id", "class"), "offense_id")
            .groupBy("class", PID).agg(F.count(ONE).alias("n")))


_PC_CO = "participant_charge pc JOIN charge_offense co ON pc.offense_id = co.offense_id"


@op("count_if_sum")
def q_count_if_sum(t) -> DataFrame:
    per = t["participant_charge"].groupBy("offense_id").agg(count_if_sum(convicted()).alias("v"))
    return (per.join(t["charge_offense"].select("offense_id", "class"), "offense_id")
            .groupBy("class").agg(F.sum("v").alias("convictions")))


SQL["count_if_sum"] = sql_with("participant_charge", "charge_offense") + f"""
SELECT co.class, CAST(SUM(CASE WHEN pc.outcome = 'Convicted' THEN 1 ELSE 0 END) AS BIGINT) AS convictions
FROM {_PC_CO} GROUP BY co.class"""


@op("distinct_if")
def q_distinct_if(t) -> DataFrame:
    per = t["participant_charge"].groupBy(PID).agg(F.max(flag(convicted())).alias("v"))
    j = t["enrollment"].select(PID, "end_status").distinct().join(per, PID)
    return j.groupBy("end_status").agg(distinct_if(F.col("v") == 1, PID).alias("convicted_participants"),
                                       F.count_distinct(PID).alias("participants"))


SQL["distinct_if"] = sql_with("participant_charge", "enrollment") + """
SELECT e.end_status,
       COUNT(DISTINCT CASE WHEN pc.outcome = 'Convicted' THEN pc.participant_id END) AS convicted_participants,
       COUNT(DISTINCT pc.participant_id) AS participants
FROM participant_charge pc JOIN enrollment e ON pc.participant_id = e.participant_id
GROUP BY e.end_status"""


@op("pct_true")
def q_pct_true(t) -> DataFrame:
    per = t["participant_charge"].groupBy("offense_id", F.coalesce(convicted(), F.lit(False)).alias("v")) \
        .agg(F.count(ONE).alias("n")).join(t["charge_offense"].select("offense_id", "class"), "offense_id")
    return per.groupBy("class").agg(pct_true(F.col("v"), weight="n").alias("pct_convicted"))


SQL["pct_true"] = sql_with("participant_charge", "charge_offense") + f"""
SELECT co.class, {sql_pct("SUM(CASE WHEN pc.outcome = 'Convicted' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS pct_convicted
FROM {_PC_CO} GROUP BY co.class"""


@op("share_of_total")
def q_share(t) -> DataFrame:
    e = t["enrollment"]
    g = e.groupBy("end_status").agg(F.count(ONE).alias("n"))
    return with_total(g, e.agg(F.count(ONE).alias("_all"))).select(
        "end_status", "n", share_of_total("n", "_all").alias("share"))


SQL["share_of_total"] = sql_with("enrollment") + f"""
SELECT end_status, COUNT(*) AS n, {sql_pct('COUNT(*)', '(SELECT COUNT(*) FROM enrollment)')} AS share
FROM enrollment GROUP BY end_status"""


@op("rate")
def q_rate(t) -> DataFrame:
    j = t["participant"].select(PID, "gender").join(t["enrollment"].select(PID, "end_status"), PID)
    g = j.groupBy("gender").agg(F.count(ONE).alias("n"),
                                F.sum(flag(F.col("end_status") == "Graduated")).alias("graduated"))
    return g.select("gender", "n", "graduated", rate("graduated", "n").alias("graduation_rate"))


SQL["rate"] = sql_with("participant", "enrollment") + f"""
SELECT p.gender, COUNT(*) AS n, CAST(SUM(CASE WHEN e.end_status = 'Graduated' THEN 1 ELSE 0 END) AS BIGINT) AS graduated,
       {sql_pct("SUM(CASE WHEN e.end_status = 'Graduated' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS graduation_rate
FROM participant p JOIN enrollment e ON p.participant_id = e.participant_id GROUP BY p.gender"""


@op("ratio_text")
def q_ratio_text(t) -> DataFrame:
    up = F.upper("gender")
    g = t["participant"].groupBy("race_ethnicity").agg(F.sum(flag(up.startswith("M"))).alias("m"),
                                                       F.sum(flag(up.startswith("F"))).alias("f"))
    return g.select("race_ethnicity", ratio_text("m", "f").alias("male_female_ratio"))


SQL["ratio_text"] = sql_with("participant") + f"""
SELECT race_ethnicity,
       CAST({sql_round_ratio("SUM(CASE WHEN upper(gender) LIKE 'M%' THEN 1 ELSE 0 END)",
                             "SUM(CASE WHEN upper(gender) LIKE 'F%' THEN 1 ELSE 0 END)", 2)} AS VARCHAR) || ':1'
           AS male_female_ratio
FROM participant GROUP BY race_ethnicity"""


@op("per_subject")
def q_per_subject(t) -> DataFrame:
    g = _charges_with_class(t).groupBy("class").agg(F.sum("n").alias("charges"), F.count(PID).alias("participants"))
    return g.select("class", "charges", "participants",
                    per_subject("charges", "participants").alias("charges_per_participant"))


SQL["per_subject"] = sql_with("participant_charge", "charge_offense") + f"""
SELECT co.class, COUNT(*) AS charges, COUNT(DISTINCT pc.participant_id) AS participants,
       {sql_round_ratio('COUNT(*)', 'COUNT(DISTINCT pc.participant_id)', 2)} AS charges_per_participant
FROM {_PC_CO} GROUP BY co.class"""


@op("per_subject_summary")
def q_per_subject_summary(t) -> DataFrame:
    return per_subject_summary(t["treatment_episode"], PID)


SQL["per_subject_summary"] = sql_with("treatment_episode") + f"""
SELECT {sql_round_ratio('SUM(n)', 'COUNT(n)', 2)} AS Average, MIN(n) AS Minimum, MAX(n) AS Maximum,
       CAST(SUM(n) AS BIGINT) AS Total
FROM (SELECT participant_id, COUNT(*) AS n FROM treatment_episode GROUP BY participant_id) s"""


@op("pop_stddev")
def q_pop_stddev(t) -> DataFrame:
    ra = t["risk_assessment"].where(F.col("risk_score").isNotNull())
    return ra.groupBy("risk_category").agg(F.count(ONE).alias("n"),
                                           round_real(pop_stddev("risk_score"), 2).alias("sd"))


SQL["pop_stddev"] = sql_with("risk_assessment") + f"""
SELECT risk_category, COUNT(*) AS n,
       {sql_round_real('stddev_pop(risk_score)', 2)} AS sd
FROM risk_assessment WHERE risk_score IS NOT NULL GROUP BY risk_category"""


@op("with_total_row")
def q_with_total_row(t) -> DataFrame:
    return with_total_row(_charges_with_class(t), "class", {"charges": F.sum("n"), "participants": F.count_distinct(PID)})


SQL["with_total_row"] = sql_with("participant_charge", "charge_offense") + f"""
SELECT co.class AS class, COUNT(*) AS charges, COUNT(DISTINCT pc.participant_id) AS participants
FROM {_PC_CO} WHERE co.class IS NOT NULL GROUP BY co.class
UNION ALL
SELECT 'TOTAL', COUNT(*), COUNT(DISTINCT pc.participant_id) FROM {_PC_CO}"""


@op("avg_duration")
def q_avg_duration(t) -> DataFrame:
    te = t["treatment_episode"]
    return te.groupBy("treatment_type").agg(
        avg_int_rounded(F.date_diff("end_date", "start_date"), 2).alias("avg_duration_days"))


SQL["avg_duration"] = sql_with("treatment_episode") + f"""
SELECT treatment_type, {sql_round_ratio("SUM(date_diff('day', start_date, end_date))",
                                        "COUNT(date_diff('day', start_date, end_date))", 2)} AS avg_duration_days
FROM treatment_episode GROUP BY treatment_type"""


@op("cost_model")
def q_cost_model(t) -> DataFrame:
    return cost_model(t["jail_data"], t["enrollment"])


SQL["cost_model"] = sql_with("jail_data", "enrollment") + f"""
SELECT {sql_round_real('a', 2)} AS actual_cost, {sql_round_real('p', 2)} AS projected_cost,
       {sql_round_real('p - a', 2)} AS net_savings
FROM (SELECT (SELECT SUM(days_incarcerated) * 271.0 FROM jail_data) AS a,
             (SELECT COUNT(*) FROM enrollment) * (SELECT AVG(length_days) FROM enrollment) / 365.0
             * (SELECT AVG(days_incarcerated) * 271.0 FROM jail_data) * 1.5 AS p) s"""


# ------------------------------------------------------------------ F4, G1-G3
@op("top_k")
def q_top_k(t) -> DataFrame:
    g = t["participant_charge"].groupBy(PID).agg(F.count(ONE).alias("charges"))
    return top_k(g, [F.desc("charges"), F.asc(PID)], 10)


SQL["top_k"] = sql_with("participant_charge") + """
SELECT participant_id, COUNT(*) AS charges FROM participant_charge GROUP BY participant_id
ORDER BY charges DESC, participant_id ASC LIMIT 10"""


@op("metric_rows")
def q_metric_rows(t) -> DataFrame:
    row = one_row(t["participant"].agg(F.count(ONE).alias("a")),
                  t["enrollment"].agg(F.count(ONE).alias("b"), F.min("start_date").alias("d")))
    return metric_rows(row, [
        {"metric": "participants", "value": F.col("a")},
        {"metric": "enrolments", "value": F.col("b"), "note": F.col("d")},
        {"metric": "ratio", "value": safe_div("b", "a")},
    ], {"metric": "string", "value": "string", "note": "string"})


SQL["metric_rows"] = sql_with("participant", "enrollment") + """
SELECT 'participants' AS metric, CAST(COUNT(*) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS note FROM participant
UNION ALL
SELECT 'enrolments', CAST(COUNT(*) AS VARCHAR), CAST(MIN(start_date) AS VARCHAR) FROM enrollment
UNION ALL
SELECT 'ratio', CAST((SELECT COUNT(*) FROM enrollment) / (SELECT COUNT(*) FROM participant) AS VARCHAR), NULL"""


# ------------------------------------------------------------------ Q1-Q4 quality
_CHILDREN = ["enrollment", "participant_charge", "participant_diagnosis", "risk_assessment", "jail_data",
             "treatment_episode", "psychosocial_assessment"]


@op("coverage")
def q_coverage(t) -> DataFrame:
    return quality.coverage(t["participant"], {c: t[c] for c in _CHILDREN})


SQL["coverage"] = sql_with("participant", *_CHILDREN) + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS table_name, COUNT(*) AS participants_present,
       (SELECT COUNT(DISTINCT participant_id) FROM participant) AS participants_total,
       {sql_pct('COUNT(*)', '(SELECT COUNT(DISTINCT participant_id) FROM participant)')} AS coverage_pct
FROM (SELECT DISTINCT participant_id FROM participant p
      WHERE participant_id IS NOT NULL
        AND EXISTS (SELECT 1 FROM {c} x WHERE x.participant_id = p.participant_id)) s""" for c in _CHILDREN)


def _fk_list():
    return [(child, ck, parent, pk) for child, fks in FOREIGN_KEYS.items() for ck, parent, pk in fks]


@op("orphans")
def q_orphans(t) -> DataFrame:
    return quality.orphan_counts(t, _fk_list())


_FK_TABLES = sorted({x for ch, fks in FOREIGN_KEYS.items() for _, pa, _ in fks for x in (ch, pa)})
SQL["orphans"] = sql_with(*_FK_TABLES) + "\nUNION ALL\n".join(f"""
SELECT '{child}' AS child_table, '{ck}' AS child_key, '{parent}' AS parent_table, COUNT(*) AS orphan_rows
FROM {child} c WHERE c.{ck} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{ck})""" for child, ck, parent, pk in _fk_list())


@op("duplicate_keys")
def q_duplicates(t) -> DataFrame:
    return quality.duplicate_keys(t["participant_charge"], [PID, "offense_id", "charge_date"])


SQL["duplicate_keys"] = sql_with("participant_charge") + """
SELECT participant_id, offense_id, charge_date, COUNT(*) AS n_rows FROM participant_charge
GROUP BY participant_id, offense_id, charge_date HAVING COUNT(*) > 1"""


@op("null_violations")
def q_nulls(t) -> DataFrame:
    parts = [quality.null_violations(t[name], cols, name) for name, cols in REQUIRED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SQL["null_violations"] = sql_with(*REQUIRED) + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, "
    f"COUNT(*) AS row_count FROM {name}"
    for name, cols in REQUIRED.items() for c in cols)


# ------------------------------------------------------------------ A8-A10 catalog
@op("preview")
def q_preview(t) -> DataFrame:
    return preview(t["participant"], 10, [PID])


SQL["preview"] = sql_with("participant") + "SELECT * FROM participant ORDER BY participant_id LIMIT 10"

_CATALOG = ["diagnosis_code", "participant", "enrollment", "charge_offense", "participant_charge",
            "participant_diagnosis", "risk_assessment", "jail_data", "treatment_episode", "psychosocial_assessment"]


@op("table_inventory")
def q_inventory(t) -> DataFrame:
    return table_inventory({n: t[n] for n in _CATALOG})


def _columns(name):
    """(name, type) of a canonical table's columns as bound to the test tables."""
    extra = [("props", "string")] if name == "psychosocial_assessment" else []
    return [(f.name, f.dataType.simpleString()) for f in SCHEMAS[name].fields] + extra


def _ncols(name):
    return len(_columns(name))


SQL["table_inventory"] = sql_with(*_CATALOG) + "\nUNION ALL\n".join(
    [f"SELECT '{n}' AS table_name, COUNT(*) AS row_count, CAST({_ncols(n)} AS BIGINT) AS column_count, "
     f"'{', '.join(c for c, _ in _columns(n)[:3])}' AS first_columns FROM {n}" for n in _CATALOG]
    + [f"SELECT 'TOTAL', (SELECT " + " + ".join(f"(SELECT COUNT(*) FROM {n})" for n in _CATALOG)
       + f"), CAST({sum(_ncols(n) for n in _CATALOG)} AS BIGINT), NULL"])


@op("column_profile")
def q_profile(t) -> DataFrame:
    return column_profile({n: t[n] for n in _CATALOG})


def _profile_sql():
    arms = []
    for n in _CATALOG:
        for i, (name, kind) in enumerate(_columns(n)):
            arms.append(f"SELECT '{n}' AS table_name, {i} AS position, '{name}' AS column_name, "
                        f"'{kind}' AS data_type, TRUE AS nullable, COUNT({name}) AS non_null_count FROM {n}")
    return sql_with(*_CATALOG) + "\nUNION ALL\n".join(arms)


SQL["column_profile"] = _profile_sql()
