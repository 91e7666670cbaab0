"""Binding of the driver's TPC-H-like parquet tables onto the ten canonical tables.

Each canonical table is a deterministic projection of the source tables, written once as
lazy DataFrame plans (``load_tables``) and once as DuckDB CTEs (``BINDING_SQL``) for the
SQL oracle.  Dates move +24 years (288 months) so source years 1995-2001 fall into the
2019-2025 report bands; both engines keep leap days.

Scale notes:
* Only the columns each projection needs are selected, so the parquet scans prune.
* No broadcast is hinted: AQE picks it for ``nation`` and ``region`` from their size.
* ``enrollment`` has one row per order, so a person has several (the fan-out that reports
  must count through).
* ``participant_charge`` joins lineitem to orders on the order key; AQE chooses the join
  strategy from runtime sizes and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

SHIFT_MONTHS = 288  # 24 years


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _shift(ts_col) -> F.Column:
    return F.add_months(F.to_date(ts_col), SHIFT_MONTHS)


def _participant(src) -> DataFrame:
    c = src("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = src("nation").select("n_nationkey", "n_regionkey")
    r = src("region").select("r_regionkey", "r_name")
    seg = F.upper(F.col("c_mktsegment"))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("c_custkey").cast("string").alias("participant_id"),
                    F.lit("Customer").alias("first_name"),
                    F.substring_index("c_name", "#", -1).alias("last_name"),
                    F.date_add(F.lit("1950-01-01").cast("date"),
                               (F.col("c_custkey") * 37 % 14600).cast("int")).alias("date_of_birth"),
                    F.when(seg.startswith("F"), "Female").when(seg.startswith("M"), "Male")
                    .otherwise("Other").alias("gender"),
                    F.nullif(F.col("r_name"), F.lit("MIDDLE EAST")).alias("race_ethnicity")))


def _enrollment(src) -> DataFrame:
    o = src("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
                             "o_orderpriority")
    days = F.lit(30) + (F.col("o_orderkey") * 7 % 700).cast("int")
    start = _shift("o_orderdate")
    low = F.col("o_orderpriority") == "5-LOW"
    return o.select(
        F.col("o_custkey").cast("string").alias("participant_id"),
        start.alias("start_date"),
        F.when(~low, F.date_add(start, days)).alias("end_date"),
        F.when(F.col("o_orderstatus") == "F", "Graduated")
         .when(F.col("o_orderstatus") == "O", "Terminated")
         .when(F.col("o_orderstatus") == "P", "Discharged").alias("end_status"),
        F.when(~low, days.cast("double")).alias("length_days"))


OFFENSE_CLASS = {"ECONOMY": "F", "MEDIUM": "M", "SMALL": "GM", "LARGE": "PM", "PROMO": "T"}


def _charge_offense(src) -> DataFrame:
    p = src("part").select("p_partkey", "p_name", "p_type")
    cls = None
    for k, v in OFFENSE_CLASS.items():
        cls = F.when(F.col("p_type") == k, v) if cls is None else cls.when(F.col("p_type") == k, v)
    return p.select(F.col("p_partkey").alias("offense_id"), F.col("p_name").alias("offense_name"),
                    cls.alias("class"))


def _participant_charge(src) -> DataFrame:
    li = src("lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linestatus",
                                "l_returnflag")
    o = src("orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").cast("string").alias("participant_id"),
                    F.col("l_partkey").alias("offense_id"),
                    _shift("l_shipdate").alias("charge_date"),
                    F.col("l_linestatus").alias("status_at_charge"),
                    F.when(F.col("l_returnflag") == "A", "Convicted")
                     .when(F.col("l_returnflag") == "R", "Dismissed").alias("outcome")))


def _assessment_date():
    return F.date_add(F.lit("2019-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int"))


def _participant_diagnosis(src) -> DataFrame:
    c = src("customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    # every eleventh id is misspelt and has no participant: EXISTS stays selective and the
    # orphan check finds something, without dropping a row
    pid = F.when(k % 11 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(k.cast("string"))
    text = F.concat_ws(", ", F.when(k % 2 == 0, "PTSD"), F.when(k % 3 == 0, "bipolar disorder"),
                       F.when(k % 5 == 0, "Anxiety"), F.when(k % 7 == 0, "Depression"))
    return c.select(pid.alias("participant_id"),
                    F.concat(F.lit("D"), F.col("c_nationkey").cast("string")).alias("diagnosis_code"),
                    F.nullif(text, F.lit("")).alias("diagnosis_description"),
                    _assessment_date().alias("assessment_date"))


def _diagnosis_code(src) -> DataFrame:
    n = src("nation").select("n_nationkey", "n_name")
    return n.select(F.concat(F.lit("D"), F.col("n_nationkey").cast("string")).alias("code"),
                    F.col("n_name").alias("description"))


def _risk_assessment(src) -> DataFrame:
    c = src("customer").select("c_custkey", "c_acctbal")
    score = F.floor((F.col("c_acctbal") + 1000) / 220).cast("double")
    cat = (F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
           .when(score < 10, "Low").when(score < 20, "Medium").when(score < 30, "High")
           .otherwise("Very High"))
    return c.select(F.col("c_custkey").cast("string").alias("participant_id"),
                    _assessment_date().alias("assessment_date"),
                    score.alias("risk_score"), cat.alias("risk_category"))


def _jail_data(src) -> DataFrame:
    e = src("events").select("user_id", "ts", "event_type", "value").where(F.col("event_type") == "error")
    start = F.to_date("ts")
    days = F.when(F.col("value") >= 5, F.floor(F.col("value") / 10))
    return e.select(F.col("user_id").cast("string").alias("participant_id"),
                    start.alias("start_date"),
                    F.date_add(start, days.cast("int")).alias("end_date"),
                    days.cast("double").alias("days_incarcerated"),
                    F.lit(None).cast("double").alias("cost"))


TREATMENT_TYPES = {"view": "Mental Health", "click": "Chemical Dependency", "purchase": "Unknown"}


def _treatment_episode(src) -> DataFrame:
    e = (src("events").select("event_id", "user_id", "ts", "event_type", "value")
         .where(F.col("event_type").isin(*TREATMENT_TYPES)))
    start = F.to_date("ts")
    ttype = None
    for k, v in TREATMENT_TYPES.items():
        ttype = F.when(F.col("event_type") == k, v) if ttype is None else ttype.when(F.col("event_type") == k, v)
    return e.select(F.col("user_id").cast("string").alias("participant_id"),
                    ttype.alias("treatment_type"),
                    start.alias("start_date"),
                    F.when(F.col("event_id") % 10 != 0,
                           F.date_add(start, F.floor(F.col("value") / 5).cast("int"))).alias("end_date"),
                    F.col("event_type").alias("service_type"),
                    F.concat(F.lit("P"), (F.col("event_id") % 7).cast("string")).alias("provider"),
                    F.lit(None).cast("string").alias("outcome"))


def _psychosocial_assessment(src) -> DataFrame:
    e = src("events").select("user_id", "ts", "event_type", "props").where(F.col("event_type") == "signup")
    return e.select(F.col("user_id").cast("string").alias("participant_id"),
                    F.to_date("ts").alias("assessment_date"), F.col("props"))


BUILDERS = {
    "diagnosis_code": _diagnosis_code,
    "participant": _participant,
    "enrollment": _enrollment,
    "charge_offense": _charge_offense,
    "participant_charge": _participant_charge,
    "participant_diagnosis": _participant_diagnosis,
    "risk_assessment": _risk_assessment,
    "jail_data": _jail_data,
    "treatment_episode": _treatment_episode,
    "psychosocial_assessment": _psychosocial_assessment,
}


class Tables(dict):
    """name -> DataFrame, built lazily on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return read_source(self.spark, self.sf_dir, name)

    def __missing__(self, name: str) -> DataFrame:
        if name not in BUILDERS:
            raise KeyError(name)
        df = BUILDERS[name](self.source)
        self[name] = df
        return df


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy canonical tables over the parquet files in ``sf_dir``."""
    return Tables(spark, sf_dir)


# --------------------------------------------------------------------------- SQL twin
# The same projections as DuckDB CTEs over the driver's pre-registered views.

BINDING_SQL: dict[str, str] = {
    "participant": """
  SELECT CAST(c.c_custkey AS VARCHAR) AS participant_id,
         'Customer' AS first_name,
         split_part(c.c_name, '#', 2) AS last_name,
         DATE '1950-01-01' + CAST(c.c_custkey * 37 % 14600 AS INTEGER) AS date_of_birth,
         CASE WHEN upper(c.c_mktsegment) LIKE 'F%' THEN 'Female'
              WHEN upper(c.c_mktsegment) LIKE 'M%' THEN 'Male' ELSE 'Other' END AS gender,
         NULLIF(r.r_name, 'MIDDLE EAST') AS race_ethnicity
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "enrollment": """
  SELECT CAST(o.o_custkey AS VARCHAR) AS participant_id,
         CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 24 YEAR AS DATE) AS start_date,
         CASE WHEN o.o_orderpriority <> '5-LOW' THEN
              CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 24 YEAR AS DATE)
              + CAST(30 + o.o_orderkey * 7 % 700 AS INTEGER) END AS end_date,
         CASE o.o_orderstatus WHEN 'F' THEN 'Graduated' WHEN 'O' THEN 'Terminated'
              WHEN 'P' THEN 'Discharged' END AS end_status,
         CASE WHEN o.o_orderpriority <> '5-LOW' THEN CAST(30 + o.o_orderkey * 7 % 700 AS DOUBLE) END
              AS length_days
  FROM orders o""",
    "charge_offense": """
  SELECT p_partkey AS offense_id, p_name AS offense_name,
         CASE p_type WHEN 'ECONOMY' THEN 'F' WHEN 'MEDIUM' THEN 'M' WHEN 'SMALL' THEN 'GM'
                     WHEN 'LARGE' THEN 'PM' WHEN 'PROMO' THEN 'T' END AS class
  FROM part""",
    "participant_charge": """
  SELECT CAST(o.o_custkey AS VARCHAR) AS participant_id, l.l_partkey AS offense_id,
         CAST(CAST(l.l_shipdate AS DATE) + INTERVAL 24 YEAR AS DATE) AS charge_date,
         l.l_linestatus AS status_at_charge,
         CASE l.l_returnflag WHEN 'A' THEN 'Convicted' WHEN 'R' THEN 'Dismissed' END AS outcome
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "participant_diagnosis": """
  SELECT CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE '' END || CAST(c_custkey AS VARCHAR) AS participant_id,
         'D' || CAST(c_nationkey AS VARCHAR) AS diagnosis_code,
         NULLIF(concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'PTSD' END,
                                CASE WHEN c_custkey % 3 = 0 THEN 'bipolar disorder' END,
                                CASE WHEN c_custkey % 5 = 0 THEN 'Anxiety' END,
                                CASE WHEN c_custkey % 7 = 0 THEN 'Depression' END), '')
              AS diagnosis_description,
         DATE '2019-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS assessment_date
  FROM customer""",
    "diagnosis_code": """
  SELECT 'D' || CAST(n_nationkey AS VARCHAR) AS code, n_name AS description FROM nation""",
    "risk_assessment": """
  SELECT CAST(c_custkey AS VARCHAR) AS participant_id,
         DATE '2019-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS assessment_date,
         CAST(floor((c_acctbal + 1000) / 220) AS DOUBLE) AS risk_score,
         CASE WHEN c_acctbal < 0 THEN NULL
              WHEN floor((c_acctbal + 1000) / 220) < 10 THEN 'Low'
              WHEN floor((c_acctbal + 1000) / 220) < 20 THEN 'Medium'
              WHEN floor((c_acctbal + 1000) / 220) < 30 THEN 'High'
              ELSE 'Very High' END AS risk_category
  FROM customer""",
    "jail_data": """
  SELECT CAST(user_id AS VARCHAR) AS participant_id,
         CAST(ts AS DATE) AS start_date,
         CAST(ts AS DATE) + CAST(CASE WHEN value >= 5 THEN floor(value / 10) END AS INTEGER) AS end_date,
         CAST(CASE WHEN value >= 5 THEN floor(value / 10) END AS DOUBLE) AS days_incarcerated,
         CAST(NULL AS DOUBLE) AS cost
  FROM events WHERE event_type = 'error'""",
    "treatment_episode": """
  SELECT CAST(user_id AS VARCHAR) AS participant_id,
         CASE event_type WHEN 'view' THEN 'Mental Health' WHEN 'click' THEN 'Chemical Dependency'
                         WHEN 'purchase' THEN 'Unknown' END AS treatment_type,
         CAST(ts AS DATE) AS start_date,
         CASE WHEN event_id % 10 <> 0 THEN CAST(ts AS DATE) + CAST(floor(value / 5) AS INTEGER) END
              AS end_date,
         event_type AS service_type,
         'P' || CAST(event_id % 7 AS VARCHAR) AS provider,
         CAST(NULL AS VARCHAR) AS outcome
  FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
    "psychosocial_assessment": """
  SELECT CAST(user_id AS VARCHAR) AS participant_id, CAST(ts AS DATE) AS assessment_date, props
  FROM events WHERE event_type = 'signup'""",
}


BODY_MARK = "/*@report*/"


def sql_with(*names: str) -> str:
    """WITH clause defining the named canonical tables for an oracle query.

    Ends with ``BODY_MARK`` so tests can run the report body over other canonical tables."""
    return "WITH " + ",\n".join(f"{n} AS ({BINDING_SQL[n]}\n)" for n in names) + "\n" + BODY_MARK + "\n"


def report_body(sql: str) -> str:
    """The part of an oracle query after the canonical-table CTEs (see ``sql_with``)."""
    body = sql.split(BODY_MARK, 1)[1].lstrip()
    return "WITH " + body[1:] if body.startswith(",") else body
