"""Operator queries of the ingest path: cleaning expressions and table builds over the
raw-shaped extracts (B-rows), and the file sources/sinks (A-rows) as write-and-read-back
round trips in the shared scratch folder.  Oracles redo the cleaning in DuckDB SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.cleaning import (NUMBER, STRIP_PATTERN, TIME_PART, Header, clean_text, collapse_flags, parse_date, parse_number,
                                  person_key, person_key_from_parts, replace_token, split_name)
from ..operators import ingest
from ..operators.catalog import publish_reports
from ..session import scratch_path
from ..sources import csv as csv_src
from ..sources import sinks
from ..sources.bindings import sql_with
from ..sources.raw import RAW_BUILDERS, raw_sql_with
from ..sources.store import RunTables

SPARK: dict = {}
SQL: dict = {}
REPORT = re.compile(r"(r\d_\d|x\d)")


def op(name):
    def deco(fn):
        SPARK[name] = fn
        return fn
    return deco


def raw(t, name: str) -> DataFrame:
    return RAW_BUILDERS[name](t.source)


def q(col: str) -> str:
    return f'"{col}"'


# ------------------------------------------------------------------ SQL twins of the cleaning
def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP_PATTERN}', '', 'g')"


def s_key(x: str) -> str:
    return s_strip(f"translate(lower({x}), ', ./', '-')")


def s_key_parts(last: str, first: str) -> str:
    return s_key(f"({s_strip(last)} || ', ' || {s_strip(first)})")


# each DuckDB format guarded by the shape that Spark's pattern accepts
_DATE_SHAPES = [("%m/%d/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("%Y-%m-%d", r"^\d{4}-\d{2}-\d{2}$"),
                ("%m-%d-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("%Y/%m/%d", r"^\d{4}/\d{2}/\d{2}$"),
                ("%b %d, %Y", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), ("%d-%b-%Y", r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$"),
                ("%m/%d/%y", r"^\d{1,2}/\d{1,2}/\d{2}$"), ("%m-%d-%y", r"^\d{1,2}-\d{1,2}-\d{2}$")]


def s_date(x: str) -> str:
    s = f"regexp_replace({s_strip(x)}, '{TIME_PART}', '')"
    return "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({s}, '{shape}') THEN CAST(try_strptime({s}, '{f}') AS DATE) END"
        for f, shape in _DATE_SHAPES) + ")"


def s_num(x: str) -> str:
    s = s_strip(x)
    return f"(CASE WHEN regexp_matches({s}, '{NUMBER}') THEN TRY_CAST({s} AS DOUBLE) END)"


def s_clean(x: str, upper: bool = False) -> str:
    s = s_strip(x)
    if upper:
        s = f"upper({s})"
    return f"(CASE WHEN {s} <> '' AND lower({s}) <> 'nan' THEN {s} END)"


def s_split(x: str, i: int) -> str:
    return s_strip(f"string_split({x}, ', ')[{i + 1}]")


# ------------------------------------------------------------------ B1-B7 expressions
@op("person_key")
def q_person_key(t):
    r = raw(t, "raw_roster")
    return r.select("_row", person_key(F.col("`Participant Name`")).alias("participant_id"))


SQL["person_key"] = raw_sql_with("raw_roster") + \
    f"SELECT _row, {s_key(q('Participant Name'))} AS participant_id FROM raw_roster"


@op("person_key_from_parts")
def q_key_parts(t):
    r = raw(t, "raw_charges")
    return r.select("_row", person_key_from_parts(F.col("`Last Name`"), F.col("`First Name`")).alias("participant_id"))


SQL["person_key_from_parts"] = raw_sql_with("raw_charges") + \
    f"SELECT _row, {s_key_parts(q('Last Name'), q('First Name'))} AS participant_id FROM raw_charges"


@op("split_name")
def q_split_name(t):
    r = raw(t, "raw_roster")
    last, first = split_name(F.col("`Participant Name`"))
    return r.select("_row", last.alias("last_name"), first.alias("first_name"))


SQL["split_name"] = raw_sql_with("raw_roster") + \
    f"SELECT _row, {s_split(q('Participant Name'), 0)} AS last_name, " \
    f"{s_split(q('Participant Name'), 1)} AS first_name FROM raw_roster"


@op("parse_date")
def q_parse_date(t):
    r = raw(t, "raw_roster")
    return r.select("_row", parse_date(F.col("`Date Started MHC`")).alias("start_date"),
                    parse_date(F.col("`Date Ended MHC`")).alias("end_date"))


SQL["parse_date"] = raw_sql_with("raw_roster") + \
    f"SELECT _row, {s_date(q('Date Started MHC'))} AS start_date, {s_date(q('Date Ended MHC'))} AS end_date " \
    "FROM raw_roster"


@op("parse_number")
def q_parse_number(t):
    r = raw(t, "raw_risk")
    return r.select("_row", parse_number(F.col("`LS/CMI Score`")).alias("risk_score"))


SQL["parse_number"] = raw_sql_with("raw_risk") + f"SELECT _row, {s_num(q('LS/CMI Score'))} AS risk_score FROM raw_risk"


@op("clean_text")
def q_clean_text(t):
    r = raw(t, "raw_risk")
    return r.select("_row", clean_text(F.col("`Risk Level`")).alias("risk_category"),
                    clean_text(F.col("`Risk Level`"), upper=True).alias("risk_category_upper"))


SQL["clean_text"] = raw_sql_with("raw_risk") + \
    f"SELECT _row, {s_clean(q('Risk Level'))} AS risk_category, " \
    f"{s_clean(q('Risk Level'), True)} AS risk_category_upper FROM raw_risk"


@op("replace_token")
def q_replace_token(t):
    r = raw(t, "raw_charges")
    return r.select("_row", replace_token(F.col("`NG/Dismissed`"), "G/Convicted", "Convicted").alias("outcome"))


SQL["replace_token"] = raw_sql_with("raw_charges") + \
    f"SELECT _row, {s_strip('replace(' + q('NG/Dismissed') + ', ' + chr(39) + 'G/Convicted' + chr(39) + ', ' + chr(39) + 'Convicted' + chr(39) + ')')} AS outcome FROM raw_charges"


# ------------------------------------------------------------------ B8-B10
@op("stack_pairs")
def q_stack_pairs(t):
    return ingest.stack_pairs(raw(t, "raw_codes"), [("_c0", "_c1"), ("_c4", "_c5")], keep=["_row"])


SQL["stack_pairs"] = raw_sql_with("raw_codes") + """
SELECT _row, _c0 AS code, _c1 AS description, 0 AS _pair FROM raw_codes WHERE _c0 IS NOT NULL
UNION ALL
SELECT _row, _c4, _c5, 1 FROM raw_codes WHERE _c4 IS NOT NULL"""


@op("first_per_key")
def q_first_per_key(t):
    r = raw(t, "raw_roster").select(person_key(F.col("`Participant Name`")).alias("participant_id"),
                                    "_row", F.col("`Date Started MHC`").alias("first_start"))
    return ingest.first_per_key(r, ["participant_id"], "_row")


SQL["first_per_key"] = raw_sql_with("raw_roster") + f"""
SELECT participant_id, _row, first_start FROM (
  SELECT {s_key(q('Participant Name'))} AS participant_id, _row, {q('Date Started MHC')} AS first_start,
         row_number() OVER (PARTITION BY {s_key(q('Participant Name'))} ORDER BY _row) AS rn
  FROM raw_roster) s WHERE rn = 1"""


@op("collapse_flags")
def q_collapse(t):
    r = raw(t, "raw_demographics")
    race = collapse_flags({k: F.col(f"`{v}`") for k, v in ingest.RACE_FLAGS.items()})
    return r.select("_row", race.alias("race_ethnicity"))


def _s_race() -> str:
    hits = [f"CASE WHEN {s_num(q(col))} = 1.0 THEN 1 ELSE 0 END" for col in ingest.RACE_FLAGS.values()]
    total = " + ".join(hits)
    single = " ".join(f"WHEN {s_num(q(col))} = 1.0 THEN '{label}'" for label, col in ingest.RACE_FLAGS.items())
    return f"(CASE WHEN ({total}) > 1 THEN 'Multi-Racial' WHEN ({total}) = 1 THEN (CASE {single} END) END)"


SQL["collapse_flags"] = raw_sql_with("raw_demographics") + f"SELECT _row, {_s_race()} AS race_ethnicity FROM raw_demographics"


# ------------------------------------------------------------------ B11-B12 participant/enrolment
@op("build_participant")
def q_build_participant(t):
    return ingest.build_participant(raw(t, "raw_roster"), raw(t, "raw_demographics"))


SQL["build_participant"] = raw_sql_with("raw_roster", "raw_demographics") + f"""
, r AS (SELECT participant_id, name FROM (
          SELECT {s_key(q('Participant Name'))} AS participant_id, {q('Participant Name')} AS name,
                 row_number() OVER (PARTITION BY {s_key(q('Participant Name'))} ORDER BY _row) AS rn
          FROM raw_roster) x WHERE rn = 1 AND participant_id IS NOT NULL),
d AS (SELECT * FROM (
          SELECT {s_key(q('Participant Name'))} AS participant_id, {s_date('DOB')} AS date_of_birth,
                 {s_clean('Gender')} AS gender, {_s_race()} AS race_ethnicity,
                 row_number() OVER (PARTITION BY {s_key(q('Participant Name'))} ORDER BY _row) AS rn
          FROM raw_demographics) x WHERE rn = 1 AND participant_id IS NOT NULL)
SELECT r.participant_id, {s_split('r.name', 1)} AS first_name, {s_split('r.name', 0)} AS last_name,
       d.date_of_birth, d.gender, d.race_ethnicity
FROM r LEFT JOIN d ON r.participant_id = d.participant_id"""


@op("build_enrollment")
def q_build_enrollment(t):
    return ingest.build_enrollment(raw(t, "raw_roster"))


SQL["build_enrollment"] = raw_sql_with("raw_roster") + f"""
SELECT * FROM (
  SELECT {s_key(q('Participant Name'))} AS participant_id, {s_date(q('Date Started MHC'))} AS start_date,
         {s_date(q('Date Ended MHC'))} AS end_date, {s_clean(q('End Status'))} AS end_status,
         {s_num(q('Length of MHC'))} AS length_days
  FROM raw_roster) s
WHERE participant_id IS NOT NULL AND start_date IS NOT NULL"""


# ------------------------------------------------------------------ B13-B15 charges
def _charge_rows_sql() -> str:
    return raw_sql_with("raw_charges") + f"""
, rows AS (SELECT * FROM raw_charges WHERE {s_clean(q('Charge Date'))} IS NOT NULL),
dim AS (SELECT row_number() OVER (ORDER BY seen, off NULLS FIRST, cls NULLS FIRST) AS offense_id, off, cls FROM (
          SELECT Offense AS off, Class AS cls, MIN(_row) AS seen FROM rows GROUP BY Offense, Class) g)
"""


@op("assign_dimension_key")
def q_dimension(t):
    r = raw(t, "raw_charges")
    rows = r.where(clean_text(F.col("`Charge Date`")).isNotNull())
    return ingest.assign_dimension_key(rows, ["Offense", "Class"], "_row", "offense_id")


SQL["assign_dimension_key"] = _charge_rows_sql() + "SELECT off AS Offense, cls AS Class, offense_id FROM dim"


@op("link_dimension")
def q_link(t):
    r = raw(t, "raw_charges")
    rows = r.where(clean_text(F.col("`Charge Date`")).isNotNull())
    dim = ingest.assign_dimension_key(rows, ["Offense", "Class"], "_row", "offense_id")
    return ingest.link_dimension(rows.select("_row", "Offense", "Class"), dim, ["Offense", "Class"],
                                 "offense_id").select("_row", "offense_id")


SQL["link_dimension"] = _charge_rows_sql() + """
SELECT rows._row, dim.offense_id FROM rows
LEFT JOIN dim ON rows.Offense IS NOT DISTINCT FROM dim.off AND rows.Class IS NOT DISTINCT FROM dim.cls"""


@op("build_charge_offense")
def q_build_offense(t):
    return ingest.build_charges(raw(t, "raw_charges"))[0]


SQL["build_charge_offense"] = _charge_rows_sql() + \
    f"SELECT offense_id, {s_strip('off')} AS offense_name, upper({s_strip('cls')}) AS class FROM dim"


@op("build_charges")
def q_build_charges(t):
    return ingest.build_charges(raw(t, "raw_charges"))[1]


SQL["build_charges"] = _charge_rows_sql() + f"""
SELECT {s_key_parts('rows.' + q('Last Name'), 'rows.' + q('First Name'))} AS participant_id, dim.offense_id,
       {s_date('rows.' + q('Charge Date'))} AS charge_date, {s_clean('rows.' + q('MHC Status'))} AS status_at_charge,
       {s_clean(s_strip("replace(rows." + q('NG/Dismissed') + ", 'G/Convicted', 'Convicted')"))} AS outcome
FROM rows LEFT JOIN dim ON rows.Offense IS NOT DISTINCT FROM dim.off AND rows.Class IS NOT DISTINCT FROM dim.cls"""


# ------------------------------------------------------------------ B16-B20, B23 builds
@op("build_diagnosis")
def q_build_diagnosis(t):
    return ingest.build_diagnosis(raw(t, "raw_mh_entry"))


SQL["build_diagnosis"] = raw_sql_with("raw_mh_entry") + f"""
SELECT * FROM (
  SELECT {s_key(q('Participant Name'))} AS participant_id, {s_clean(q('Dx Code'))} AS diagnosis_code,
         {s_clean(q('Condition Description'))} AS diagnosis_description,
         {s_date(q('Assessment Date'))} AS assessment_date
  FROM raw_mh_entry) s WHERE diagnosis_code IS NOT NULL AND participant_id IS NOT NULL"""


@op("build_risk")
def q_build_risk(t):
    return ingest.build_risk(raw(t, "raw_risk"))


SQL["build_risk"] = raw_sql_with("raw_risk") + f"""
SELECT {s_key(q('Participant Name'))} AS participant_id, {s_date(q('Assessment Date'))} AS assessment_date,
       {s_num(q('LS/CMI Score'))} AS risk_score, {s_clean(q('Risk Level'))} AS risk_category
FROM raw_risk WHERE {s_key(q('Participant Name'))} IS NOT NULL"""


@op("build_jail")
def q_build_jail(t):
    return ingest.build_jail(raw(t, "raw_jail"))


SQL["build_jail"] = raw_sql_with("raw_jail") + f"""
, j AS (SELECT {s_key(q('Participant Name'))} AS participant_id, {s_date(q('Booking Start'))} AS start_date,
               {s_date(q('Release Date'))} AS end_date, {s_num('Days')} AS d, {s_num('Cost')} AS cost FROM raw_jail)
SELECT participant_id, start_date, end_date,
       CASE WHEN (SELECT COUNT(d) FROM j) = 0 THEN CAST(date_diff('day', start_date, end_date) AS DOUBLE) ELSE d END
           AS days_incarcerated, cost
FROM j WHERE participant_id IS NOT NULL"""


@op("build_treatment")
def q_build_treatment(t):
    return ingest.build_treatment(raw(t, "raw_treatment").drop("_row"))


_TREAT_SQL = f"""
SELECT {s_key(q('Client Name'))} AS participant_id,
       CASE WHEN strpos(upper(source_file), '_MH_') > 0 THEN 'Mental Health'
            WHEN strpos(upper(source_file), '_CD_') > 0 THEN 'Chemical Dependency'
            ELSE 'Unknown' END AS treatment_type,
       {s_date(q('Start Date'))} AS start_date, {s_date(q('End Date'))} AS end_date,
       {s_clean(q('Service Type'))} AS service_type, {s_clean('Provider')} AS provider,
       {s_clean('Outcome')} AS outcome
FROM raw_treatment WHERE {s_key(q('Client Name'))} IS NOT NULL"""
SQL["build_treatment"] = raw_sql_with("raw_treatment") + _TREAT_SQL


@op("build_psychosocial")
def q_build_psychosocial(t):
    return ingest.build_psychosocial(raw(t, "raw_psychosocial"))


SQL["build_psychosocial"] = raw_sql_with("raw_psychosocial") + f"""
SELECT {s_key(q('Client Name'))} AS participant_id, {s_date(q('Completed Date'))} AS assessment_date,
       props, Score, Event
FROM raw_psychosocial WHERE {s_key(q('Client Name'))} IS NOT NULL"""


@op("build_diagnosis_codes")
def q_build_codes(t):
    return ingest.build_diagnosis_codes(raw(t, "raw_codes"))


SQL["build_diagnosis_codes"] = raw_sql_with("raw_codes") + f"""
, pairs AS (SELECT {s_clean('_c0')} AS code, {s_clean('_c1')} AS description, 0 AS p, _row FROM raw_codes
            WHERE _c0 IS NOT NULL
            UNION ALL
            SELECT {s_clean('_c4')}, {s_clean('_c5')}, 1, _row FROM raw_codes WHERE _c4 IS NOT NULL)
SELECT code, description FROM (
  SELECT code, description, row_number() OVER (PARTITION BY code ORDER BY p, _row) AS rn
  FROM pairs WHERE code IS NOT NULL) s WHERE rn = 1"""


# ------------------------------------------------------------------ A1-A7, A11 file round trips
#: a quoted field with blanks, quotes, a delimiter and a line break inside
_NOTE = """'  note "' || _row || '",' || chr(10) || 'second line '"""


def _written_as_is(df: DataFrame, path: str) -> None:
    """As an extract comes: blanks kept, quotes doubled, line breaks inside quotes."""
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def _all_text_sql(name: str, cols: list[str], extra: str = "") -> str:
    """Oracle of a CSV round trip: every value as text without the blanks after a delimiter."""
    sel = ", ".join(f"NULLIF(ltrim(CAST({q(c)} AS VARCHAR)), '') AS {q(c)}" for c in cols)
    return raw_sql_with(name) + f"SELECT {sel}{extra} FROM {name}"


_ROSTER_COLS = ["_row", "Participant Name", "Date Started MHC", "Date Ended MHC", "Length of MHC", "End Status"]


@op("csv_scan")
def q_csv_scan(t):
    spark = t.spark
    path = scratch_path(spark, "ops", "csv_scan")
    note = F.concat(F.lit('  note "'), F.col("_row"), F.lit('",\nsecond line '))
    _written_as_is(raw(t, "raw_roster").withColumn("Notes", note), path)
    return csv_src.read_csv_table(spark, path)


SQL["csv_scan"] = _all_text_sql("raw_roster", _ROSTER_COLS, f", {_NOTE} AS Notes")


_RESOLVED = ["raw_roster", "raw_demographics", "raw_charges", "raw_mh_entry", "raw_risk", "raw_jail"]


@op("resolve_columns")
def q_resolve_columns(t):
    """A3 over the data: each raw extract is projected by the columns that the keyword sets find in its
    header; per extract and role: the rows, the values, those that are dates and those that are numbers."""
    parts = []
    for name in _RESOLVED:
        frame = raw(t, name)
        h = Header(frame.columns)
        roles = {"person": h.holding("NAME"), "dated": h.holding("DATE"), "graded": h.named("class") or h.holding("LEVEL", "STATUS")}
        roles = {k: c for k, c in roles.items() if c}
        cells = [F.struct(F.lit(k).alias("role"), F.lit(c).alias("found"), F.col(f"`{c}`").cast("string").alias("v")) for k, c in roles.items()]
        cell = frame.select(F.inline(F.array(*cells)))
        parts.append(cell.groupBy("role", "found").agg(
            F.count("*").alias("n_rows"), F.count(clean_text("v")).alias("n_values"), F.count(parse_date("v")).alias("n_dates"),
            F.count(parse_number("v")).alias("n_numbers")).select(F.lit(name).alias("extract"), "*"))
    return reduce(DataFrame.unionByName, parts)


def _resolved_sql(extract: str, role: str, column: str) -> str:
    c = f"CAST({q(column)} AS VARCHAR)"
    return f"""SELECT '{extract}' AS extract, '{role}' AS role, '{column}' AS found, count(*) AS n_rows,
       count({s_clean(c)}) AS n_values, count({s_date(c)}) AS n_dates, count({s_num(c)}) AS n_numbers FROM {extract} HAVING count(*) > 0"""


SQL["resolve_columns"] = raw_sql_with(*_RESOLVED) + "\nUNION ALL\n".join(_resolved_sql(*r) for r in [
    ("raw_roster", "person", "Participant Name"), ("raw_roster", "dated", "Date Started MHC"), ("raw_roster", "graded", "End Status"),
    ("raw_demographics", "person", "Participant Name"), ("raw_charges", "person", "First Name"), ("raw_charges", "dated", "Charge Date"),
    ("raw_charges", "graded", "Class"), ("raw_mh_entry", "person", "Participant Name"), ("raw_mh_entry", "dated", "Assessment Date"),
    ("raw_risk", "person", "Participant Name"), ("raw_risk", "dated", "Assessment Date"), ("raw_risk", "graded", "Risk Level"),
    ("raw_jail", "person", "Participant Name"), ("raw_jail", "dated", "Release Date")])


@op("ingest_rejects")
def q_ingest_rejects(t):
    """B4/B5 in the load itself: values that are there but parse to nothing, per extract and column, observed
    while the tables are built and written (no scan of their own)."""
    builds = {"raw_risk": ingest.build_risk, "raw_jail": ingest.build_jail, "raw_mh_entry": ingest.build_diagnosis}
    rows = []
    for name, build in builds.items():
        seen = Observation(f"rejects-{name}-{uuid.uuid4().hex[:8]}")
        sinks.write_table(build(raw(t, name), rejects=seen), scratch_path(t.spark, "ops", "rejects", name))
        rows += [(name, c, n or 0) for c, n in seen.get.items()]
    return t.spark.createDataFrame(rows, "extract string, source_column string, rejected long")


def _rejects_sql(extract: str, column: str, parsed: Callable[[str], str]) -> str:
    c = f"CAST({q(column)} AS VARCHAR)"
    return f"""SELECT '{extract}' AS extract, '{column}' AS source_column,
       count(CASE WHEN {s_clean(c)} IS NOT NULL AND {parsed(c)} IS NULL THEN 1 END) AS rejected FROM {extract}"""


SQL["ingest_rejects"] = raw_sql_with("raw_risk", "raw_jail", "raw_mh_entry") + "\nUNION ALL\n".join(_rejects_sql(*r) for r in [
    ("raw_risk", "Assessment Date", s_date), ("raw_risk", "LS/CMI Score", s_num), ("raw_jail", "Booking Start", s_date), ("raw_jail", "Release Date", s_date),
    ("raw_jail", "Days", s_num), ("raw_jail", "Cost", s_num), ("raw_mh_entry", "Assessment Date", s_date)])


@op("csv_positional")
def q_csv_positional(t):
    spark = t.spark
    path = scratch_path(spark, "ops", "csv_positional")
    _written_as_is(raw(t, "raw_codes"), path)
    return csv_src.read_csv_table(spark, path, header=False,
                                  names=["_row", "_c0", "_c1", "_c2", "_c3", "_c4", "_c5"])


SQL["csv_positional"] = _all_text_sql("raw_codes", ["_row", "_c0", "_c1", "_c2", "_c3", "_c4", "_c5"])


@op("union_tagged")
def q_union_tagged(t):
    spark = t.spark
    # a folder whose own name looks like a category, extracts under different headers, one glob
    # and one missing file
    root = scratch_path(spark, "ops", "in_MH_2024")
    by_file = scratch_path(spark, "ops", "union_tagged")
    raw(t, "raw_treatment").drop("_row").write.partitionBy("source_file").parquet(by_file)
    other = {"Client Name": "Participant Name", "Start Date": "Admission", "End Date": "Discharge",
             "Service Type": "Modality", "Provider": "Agency", "Outcome": "Result"}
    for n in ["Treatment_MH_FY24.csv", "Treatment_CD_FY24.csv", "Treatment_Historical.csv"]:
        part = spark.read.parquet(f"{by_file}/source_file={n}")
        _written_as_is(part.withColumnsRenamed(other) if "Historical" in n else part, f"{root}/{n}")
    paths = [f"{root}/Treatment_*_FY24.csv", f"{root}/Treatment_Historical.csv", f"{root}/Treatment_MH_FY23.csv"]
    return ingest.build_treatment_files(csv_src.read_extracts(spark, paths))


SQL["union_tagged"] = raw_sql_with("raw_treatment") + _TREAT_SQL


@op("write_table")
def q_write_table(t):
    path = scratch_path(t.spark, "ops", "write_table")
    sinks.write_table(t["enrollment"], path)
    return t.spark.read.parquet(path)


SQL["write_table"] = sql_with("enrollment") + "SELECT * FROM enrollment"


def _report(name):
    from .registry import reports
    return reports()[name]


def _report_sql(name):
    from .registry import oracle_sql
    return oracle_sql()[name]


@op("export_csv")
def q_export_csv(t):
    path = scratch_path(t.spark, "ops", "export_csv")
    r = raw(t, "raw_roster")
    note = F.concat(F.lit('  note "'), F.col("_row"), F.lit('",\nsecond line '))
    sinks.export_csv(r.select("_row", "Participant Name", "End Status", note.alias("Notes")), path)
    return csv_src.read_csv_table(t.spark, path)


SQL["export_csv"] = raw_sql_with("raw_roster") + f"""
SELECT CAST(_row AS VARCHAR) AS _row, "Participant Name", "End Status", {_NOTE} AS Notes FROM raw_roster"""


@op("export_json")
def q_export_json(t):
    path = scratch_path(t.spark, "ops", "export_json")
    df = _report("r4_9")(t)
    sinks.export_json(df, path)
    return t.spark.read.schema(df.schema).json(path)


def _export_json_sql():
    from .section4 import SQL as S4
    return f"SELECT * FROM ({S4['r4_9']}) s"


SQL["export_json"] = _export_json_sql()

@op("publish_reports")
def q_publish(t):
    from .registry import reports
    out = scratch_path(t.spark, "ops", "publish")
    every = reports()
    log = publish_reports(t.spark, every, RunTables(t.spark, t), out, [n for n in every if REPORT.fullmatch(n)])
    return log.select("report_name", "ok", "row_count", "error")


def _publish_sql():
    from . import extras, section1, section2, section3, section4, section5
    sqls = {k: v for m in (section1, section2, section3, section4, section5, extras) for k, v in m.SQL.items()}
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS report_name, TRUE AS ok, COUNT(*) AS row_count, CAST(NULL AS VARCHAR) AS error "
        f"FROM ({sql}) s" for n, sql in sqls.items() if REPORT.fullmatch(n))


SQL["publish_reports"] = _publish_sql()
