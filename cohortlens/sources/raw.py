"""Raw-shaped extracts projected from the driver's parquet tables (inputs of the cleaning jobs).

Every column is a string named like a header of the source files; ``_row`` is the
record number (the only reliable row order of a distributed read).  The projections
inject what the cleaning jobs must handle: 'Last, First' names with dots and slashes,
month-first text dates with broken values, one-hot race flags (none / one / several),
padded and mixed-case offense pairs, 'G/Convicted' outcome variants, a NULL-date row
class, and file-name categories for treatment extracts.  ``RAW_SQL`` holds the same
projections as DuckDB CTEs for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bindings import OFFENSE_CLASS, SHIFT_MONTHS


def _first_name(k: Column) -> Column:
    return F.when(k % 3 == 0, "Customer J.").when(k % 7 == 0, "Ann/Marie").otherwise("Customer")


def _last_name(k: Column) -> Column:
    return F.lpad(k.cast("string"), 9, "0")


def _name(k: Column) -> Column:
    return F.concat(_last_name(k), F.lit(", "), _first_name(k))


def _mdy(d: Column) -> Column:
    return F.date_format(d, "M/d/yyyy")


def raw_roster(src) -> DataFrame:
    o = src("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    k, ok = F.col("o_custkey"), F.col("o_orderkey")
    start = F.add_months(F.to_date("o_orderdate"), SHIFT_MONTHS)
    days = F.lit(30) + (ok * 7 % 700).cast("int")
    low = F.col("o_orderpriority") == "5-LOW"
    return o.select(ok.alias("_row"), _name(k).alias("Participant Name"),
                    F.when(ok % 50 == 0, "unknown")
                    .when(ok % 7 == 1, F.date_format(start, "yyyy-MM-dd 00:00:00"))
                    .when(ok % 7 == 2, F.concat(_mdy(start), F.lit(" 0:00")))
                    .when(ok % 7 == 3, F.date_format(start, "MMM d, yyyy"))
                    .when(ok % 7 == 4, F.date_format(start, "d-MMM-yyyy"))
                    .when(ok % 7 == 5, F.date_format(start, "yyyy/MM/dd"))
                    .when(ok % 7 == 6, F.date_format(start, "M/d/yy"))
                    .otherwise(_mdy(start)).alias("Date Started MHC"),
                    F.when(~low, _mdy(F.date_add(start, days))).alias("Date Ended MHC"),
                    F.when(~low, days.cast("string")).alias("Length of MHC"),
                    F.when(F.col("o_orderstatus") == "F", " Graduated")
                    .when(F.col("o_orderstatus") == "O", "Terminated ")
                    .when(F.col("o_orderstatus") == "P", "Discharged").alias("End Status"))


def raw_demographics(src) -> DataFrame:
    c = src("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = src("nation").select("n_nationkey", "n_regionkey")
    k, r = F.col("c_custkey"), F.col("n_regionkey")
    dob = F.date_add(F.lit("1950-01-01").cast("date"), (k * 37 % 14600).cast("int"))
    none = k % 17 == 0

    def flag(cond):
        return F.when(~none & cond, "1.0")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(k.alias("_row"), _name(k).alias("Participant Name"),
                    F.when(k % 50 == 7, "00/00/0000").otherwise(_mdy(dob)).alias("DOB"),
                    F.col("c_mktsegment").alias("Gender"),
                    flag((r == 0) | (k % 13 == 0)).alias("Race: White"),
                    flag(r == 1).alias("Race: Black"), flag(r == 2).alias("Race: Native American"),
                    flag(r == 3).alias("Race: Asian"), flag(r == 4).alias("Race: Other")))


def raw_charges(src) -> DataFrame:
    li = src("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_linestatus",
                                "l_returnflag")
    o = src("orders").select("o_orderkey", "o_custkey")
    p = src("part").select("p_partkey", "p_name", "p_type")
    row = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    k = F.col("o_custkey")
    code = None
    for t, v in OFFENSE_CLASS.items():
        code = F.when(F.col("p_type") == t, v) if code is None else code.when(F.col("p_type") == t, v)
    ship = F.add_months(F.to_date("l_shipdate"), SHIFT_MONTHS)
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .select(row.alias("_row"),
                    F.when(row % 97 == 0, F.lit(None).cast("string")).when(row % 50 == 0, "TBD")
                    .otherwise(_mdy(ship)).alias("Charge Date"),
                    _first_name(k).alias("First Name"),
                    F.when(F.col("l_linenumber") == 3, F.concat(_last_name(k), F.lit(" ")))
                    .otherwise(_last_name(k)).alias("Last Name"),
                    F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.col("p_name")))
                    .otherwise(F.col("p_name")).alias("Offense"),
                    F.when(F.col("p_partkey") % 3 == 0, F.lower(code)).otherwise(code).alias("Class"),
                    F.col("l_linestatus").alias("MHC Status"),
                    F.when(F.col("l_returnflag") == "A",
                           F.when(F.col("l_linenumber") % 2 == 0, "G/Convicted").otherwise("Convicted"))
                    .when(F.col("l_returnflag") == "R", "Dismissed").alias("NG/Dismissed")))


def raw_mh_entry(src) -> DataFrame:
    c = src("customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    text = F.concat_ws(", ", F.when(k % 2 == 0, "PTSD"), F.when(k % 3 == 0, "bipolar disorder"),
                       F.when(k % 5 == 0, "Anxiety"), F.when(k % 7 == 0, "Depression"))
    adate = F.date_add(F.lit("2019-01-01").cast("date"), (k % 2000).cast("int"))
    return c.select(k.alias("_row"), _name(k).alias("Participant Name"),
                    F.when(k % 23 != 0, F.concat(F.lit("D"), F.col("c_nationkey").cast("string")))
                    .alias("Dx Code"),
                    F.nullif(text, F.lit("")).alias("Condition Description"),
                    _mdy(adate).alias("Assessment Date"))


def raw_risk(src) -> DataFrame:
    c = src("customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    score = F.floor((F.col("c_acctbal") + 1000) / 220)
    cat = (F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
           .when(score < 10, "Low").when(score < 20, "Medium").when(score < 30, "High").otherwise("Very High"))
    adate = F.date_add(F.lit("2019-01-01").cast("date"), (k % 2000).cast("int"))
    return c.select(k.alias("_row"), _name(k).alias("Participant Name"), _mdy(adate).alias("Assessment Date"),
                    F.when(k % 50 == 0, "n/a").when(k % 53 == 0, "12d").otherwise(score.cast("string")).alias("LS/CMI Score"),
                    F.when(k % 4 == 0, F.concat(F.lit(" "), cat)).otherwise(cat).alias("Risk Level"))


def raw_jail(src) -> DataFrame:
    e = src("events").select("event_id", "user_id", "ts", "event_type", "value").where(F.col("event_type") == "error")
    start = F.to_date("ts")
    days = F.when(F.col("value") >= 5, F.floor(F.col("value") / 10))
    return e.select(F.col("event_id").alias("_row"), _name(F.col("user_id")).alias("Participant Name"),
                    _mdy(start).alias("Booking Start"),
                    _mdy(F.date_add(start, days.cast("int"))).alias("Release Date"),
                    days.cast("string").alias("Days"),
                    F.when(F.col("event_id") % 3 != 0, F.col("value").cast("string")).alias("Cost"))


def raw_treatment(src) -> DataFrame:
    e = (src("events").select("event_id", "user_id", "ts", "event_type", "value")
         .where(F.col("event_type").isin("view", "click", "purchase")))
    start = F.to_date("ts")
    f = (F.when(F.col("event_type") == "view", "Treatment_MH_FY24.csv")
         .when(F.col("event_type") == "click", "Treatment_CD_FY24.csv")
         .otherwise("Treatment_Historical.csv"))
    return e.select(F.col("event_id").alias("_row"), _name(F.col("user_id")).alias("Client Name"),
                    _mdy(start).alias("Start Date"),
                    F.when(F.col("event_id") % 10 != 0,
                           _mdy(F.date_add(start, F.floor(F.col("value") / 5).cast("int")))).alias("End Date"),
                    F.col("event_type").alias("Service Type"),
                    F.concat(F.lit("P"), (F.col("event_id") % 7).cast("string")).alias("Provider"),
                    F.when(F.col("event_id") % 4 == 0, "Completed").alias("Outcome"),
                    f.alias("source_file"))


def raw_psychosocial(src) -> DataFrame:
    e = src("events").select("event_id", "user_id", "ts", "event_type", "value", "props") \
        .where(F.col("event_type") == "signup")
    return e.select(F.col("event_id").alias("_row"), _name(F.col("user_id")).alias("Client Name"),
                    _mdy(F.to_date("ts")).alias("Completed Date"), F.col("props"),
                    F.col("value").cast("string").alias("Score"), F.col("event_type").alias("Event"))


def raw_codes(src) -> DataFrame:
    """Positional code list: (code, description) pairs side by side at 0,1 and 4,5.

    Built from ``part`` (grows with the scale factor): even part keys fill the left pair,
    odd ones the right pair of the same record; codes repeat (every third key shares
    one), so first-row-per-code and left-before-right ordering both matter."""
    p = src("part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    code = F.concat(F.lit("C"), F.floor(k / 3).cast("string"))
    left = p.where(k % 2 == 0).select((k / 2).cast("long").alias("_row"), code.alias("_c0"),
                                      F.col("p_name").alias("_c1"))
    right = p.where(k % 2 == 1).select(F.floor(k / 2).cast("long").alias("_row"), code.alias("_c4"),
                                       F.col("p_name").alias("_c5"))
    return (left.join(right, "_row", "left")
            .select("_row", "_c0", "_c1", F.lit(None).cast("string").alias("_c2"),
                    F.lit(None).cast("string").alias("_c3"), "_c4", "_c5"))


RAW_BUILDERS = {"raw_roster": raw_roster, "raw_demographics": raw_demographics, "raw_charges": raw_charges,
                "raw_mh_entry": raw_mh_entry, "raw_risk": raw_risk, "raw_jail": raw_jail,
                "raw_treatment": raw_treatment, "raw_psychosocial": raw_psychosocial, "raw_codes": raw_codes}


# --------------------------------------------------------------------------- SQL twin
def _q(name: str) -> str:
    return '"' + name + '"'


_FIRST = "CASE WHEN {k} % 3 = 0 THEN 'Customer J.' WHEN {k} % 7 = 0 THEN 'Ann/Marie' ELSE 'Customer' END"
_LAST = "lpad(CAST({k} AS VARCHAR), 9, '0')"


def _sql_name(k: str) -> str:
    return f"({_LAST.format(k=k)} || ', ' || {_FIRST.format(k=k)})"


def _sql_mdy(d: str) -> str:
    return f"strftime({d}, '%-m/%-d/%Y')"


_SHIFT = "CAST(CAST({c} AS DATE) + INTERVAL 24 YEAR AS DATE)"
_CLASS = ("CASE p_type WHEN 'ECONOMY' THEN 'F' WHEN 'MEDIUM' THEN 'M' WHEN 'SMALL' THEN 'GM' "
          "WHEN 'LARGE' THEN 'PM' WHEN 'PROMO' THEN 'T' END")

_START = _SHIFT.format(c='o_orderdate')
_START_SHAPES = "".join(f" WHEN {i} THEN strftime({_START}, '{f}')" for i, f in enumerate(
    ["%-m/%-d/%Y", "%Y-%m-%d 00:00:00", "%-m/%-d/%Y 0:00", "%b %-d, %Y", "%-d-%b-%Y", "%Y/%m/%d", "%-m/%-d/%y"]))

RAW_SQL: dict[str, str] = {
    "raw_roster": f"""
  SELECT o_orderkey AS _row, {_sql_name('o_custkey')} AS {_q('Participant Name')},
         CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE CASE o_orderkey % 7 {_START_SHAPES} END END
             AS {_q('Date Started MHC')},
         CASE WHEN o_orderpriority <> '5-LOW' THEN
              {_sql_mdy(_SHIFT.format(c='o_orderdate') + ' + CAST(30 + o_orderkey * 7 % 700 AS INTEGER)')} END
             AS {_q('Date Ended MHC')},
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(30 + o_orderkey * 7 % 700 AS VARCHAR) END
             AS {_q('Length of MHC')},
         CASE o_orderstatus WHEN 'F' THEN ' Graduated' WHEN 'O' THEN 'Terminated ' WHEN 'P' THEN 'Discharged' END
             AS {_q('End Status')}
  FROM orders""",
    "raw_demographics": f"""
  SELECT c_custkey AS _row, {_sql_name('c_custkey')} AS {_q('Participant Name')},
         CASE WHEN c_custkey % 50 = 7 THEN '00/00/0000'
              ELSE {_sql_mdy("DATE '1950-01-01' + CAST(c_custkey * 37 % 14600 AS INTEGER)")} END AS DOB,
         c_mktsegment AS Gender,
         CASE WHEN c_custkey % 17 <> 0 AND (n_regionkey = 0 OR c_custkey % 13 = 0) THEN '1.0' END
             AS {_q('Race: White')},
         CASE WHEN c_custkey % 17 <> 0 AND n_regionkey = 1 THEN '1.0' END AS {_q('Race: Black')},
         CASE WHEN c_custkey % 17 <> 0 AND n_regionkey = 2 THEN '1.0' END AS {_q('Race: Native American')},
         CASE WHEN c_custkey % 17 <> 0 AND n_regionkey = 3 THEN '1.0' END AS {_q('Race: Asian')},
         CASE WHEN c_custkey % 17 <> 0 AND n_regionkey = 4 THEN '1.0' END AS {_q('Race: Other')}
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "raw_charges": f"""
  SELECT l_orderkey * 8 + l_linenumber AS _row,
         CASE WHEN (l_orderkey * 8 + l_linenumber) % 97 = 0 THEN NULL
              WHEN (l_orderkey * 8 + l_linenumber) % 50 = 0 THEN 'TBD'
              ELSE {_sql_mdy(_SHIFT.format(c='l_shipdate'))} END AS {_q('Charge Date')},
         {_FIRST.format(k='o_custkey')} AS {_q('First Name')},
         CASE WHEN l_linenumber = 3 THEN {_LAST.format(k='o_custkey')} || ' ' ELSE {_LAST.format(k='o_custkey')} END
             AS {_q('Last Name')},
         CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_name ELSE p_name END AS Offense,
         CASE WHEN p_partkey % 3 = 0 THEN lower({_CLASS}) ELSE {_CLASS} END AS Class,
         l_linestatus AS {_q('MHC Status')},
         CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'G/Convicted' ELSE 'Convicted' END
                           WHEN 'R' THEN 'Dismissed' END AS {_q('NG/Dismissed')}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "raw_mh_entry": f"""
  SELECT c_custkey AS _row, {_sql_name('c_custkey')} AS {_q('Participant Name')},
         CASE WHEN c_custkey % 23 <> 0 THEN 'D' || CAST(c_nationkey AS VARCHAR) END AS {_q('Dx Code')},
         NULLIF(concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'PTSD' END,
                                CASE WHEN c_custkey % 3 = 0 THEN 'bipolar disorder' END,
                                CASE WHEN c_custkey % 5 = 0 THEN 'Anxiety' END,
                                CASE WHEN c_custkey % 7 = 0 THEN 'Depression' END), '')
             AS {_q('Condition Description')},
         {_sql_mdy("DATE '2019-01-01' + CAST(c_custkey % 2000 AS INTEGER)")} AS {_q('Assessment Date')}
  FROM customer""",
    "raw_risk": f"""
  SELECT c_custkey AS _row, {_sql_name('c_custkey')} AS {_q('Participant Name')},
         {_sql_mdy("DATE '2019-01-01' + CAST(c_custkey % 2000 AS INTEGER)")} AS {_q('Assessment Date')},
         CASE WHEN c_custkey % 50 = 0 THEN 'n/a' WHEN c_custkey % 53 = 0 THEN '12d'
              ELSE CAST(CAST(floor((c_acctbal + 1000) / 220) AS BIGINT) AS VARCHAR) END AS {_q('LS/CMI Score')},
         CASE WHEN c_custkey % 4 = 0 THEN ' ' || cat ELSE cat END AS {_q('Risk Level')}
  FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN NULL
                       WHEN floor((c_acctbal + 1000) / 220) < 10 THEN 'Low'
                       WHEN floor((c_acctbal + 1000) / 220) < 20 THEN 'Medium'
                       WHEN floor((c_acctbal + 1000) / 220) < 30 THEN 'High' ELSE 'Very High' END AS cat
        FROM customer) c""",
    "raw_jail": f"""
  SELECT event_id AS _row, {_sql_name('user_id')} AS {_q('Participant Name')},
         {_sql_mdy('CAST(ts AS DATE)')} AS {_q('Booking Start')},
         {_sql_mdy('CAST(ts AS DATE) + CAST(CASE WHEN value >= 5 THEN floor(value / 10) END AS INTEGER)')}
             AS {_q('Release Date')},
         CAST(CAST(CASE WHEN value >= 5 THEN floor(value / 10) END AS BIGINT) AS VARCHAR) AS Days,
         CASE WHEN event_id % 3 <> 0 THEN CAST(value AS VARCHAR) END AS Cost
  FROM events WHERE event_type = 'error'""",
    "raw_treatment": f"""
  SELECT event_id AS _row, {_sql_name('user_id')} AS {_q('Client Name')},
         {_sql_mdy('CAST(ts AS DATE)')} AS {_q('Start Date')},
         CASE WHEN event_id % 10 <> 0 THEN
              {_sql_mdy('CAST(ts AS DATE) + CAST(floor(value / 5) AS INTEGER)')} END AS {_q('End Date')},
         event_type AS {_q('Service Type')}, 'P' || CAST(event_id % 7 AS VARCHAR) AS Provider,
         CASE WHEN event_id % 4 = 0 THEN 'Completed' END AS Outcome,
         CASE event_type WHEN 'view' THEN 'Treatment_MH_FY24.csv' WHEN 'click' THEN 'Treatment_CD_FY24.csv'
              ELSE 'Treatment_Historical.csv' END AS source_file
  FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
    "raw_psychosocial": f"""
  SELECT event_id AS _row, {_sql_name('user_id')} AS {_q('Client Name')},
         {_sql_mdy('CAST(ts AS DATE)')} AS {_q('Completed Date')}, props,
         CAST(value AS VARCHAR) AS Score, event_type AS Event
  FROM events WHERE event_type = 'signup'""",
    "raw_codes": """
  SELECT l.p_partkey // 2 AS _row, 'C' || CAST(l.p_partkey // 3 AS VARCHAR) AS _c0, l.p_name AS _c1,
         CAST(NULL AS VARCHAR) AS _c2, CAST(NULL AS VARCHAR) AS _c3,
         'C' || CAST(r.p_partkey // 3 AS VARCHAR) AS _c4, r.p_name AS _c5
  FROM part l LEFT JOIN part r ON r.p_partkey = l.p_partkey + 1
  WHERE l.p_partkey % 2 = 0""",
}


def raw_sql_with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({RAW_SQL[n]}\n)" for n in names) + "\n"
