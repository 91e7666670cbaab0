"""Raw extracts -> canonical tables.

Every builder takes raw DataFrames whose columns are all strings and carry the header
names of the source files; columns are discovered by keyword on the driver (header only)
and the rest is one DataFrame plan per table.

Scale notes:
* First-row-per-key (B9) is ``min_by(struct, order)`` per key — a partial aggregate, so a
  key holding a third of the rows is reduced map-side instead of being sorted in one
  window partition.
* Dense dimension ids (B13) are assigned without a single-partition window: the distinct
  keys are range-partitioned by first-seen order, checkpointed (reliable, shared
  checkpoint folder), counted per partition, and each partition adds its offset.
* The whole-column fallback of the jail build (B18) is a scalar subquery over the
  table (computed once by the cluster), never a driver-side count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.cleaning import (Header, clean_text, collapse_flags, parse_date, parse_number,
                                  person_key, person_key_from_parts, replace_token, split_name, strip_ws)
from ..session import ensure_checkpoint_dir

ROW = "_row"  # explicit record order of a raw extract (distributed reads have no row order)

# ---- fixed values: column keywords of the raw extracts ----
NAME_KW = ["NAME", "PARTICIPANT"]
NAME_KW_CLIENT = ["NAME", "PARTICIPANT", "CLIENT"]
RACE_FLAGS = {"White": "Race: White", "Black": "Race: Black", "Native American": "Race: Native American",
              "Asian": "Race: Asian", "Other": "Race: Other"}
ROSTER_NAME = "Participant Name"


def _col(df: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`") if name else F.lit(None).cast("string")


# ------------------------------------------------------------------ generic operators
def stack_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], names=("code", "description"),
                keep: Sequence[str] = ()) -> DataFrame:
    """Side-by-side column pairs -> one two-column list; rows with a NULL code dropped."""
    arms = [df.select(*keep, F.col(f"`{a}`").alias(names[0]), F.col(f"`{b}`").alias(names[1]),
                      F.lit(i).alias("_pair")) for i, (a, b) in enumerate(pairs)]
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out.where(F.col(names[0]).isNotNull())


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the first row per key by ``order`` (must be unique); partial aggregate."""
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]),
                                            F.col(f"`{order}`")).alias("_first"))
    return picked.select(*[F.col(f"`{k}`") for k in keys],
                         *[F.col("_first").getField(c).alias(c) for c in others])


def dense_ids(df: DataFrame, order: str | Sequence[str], id_col: str = "id") -> DataFrame:
    """Ids 1..n following the (unique) ascending, NULLS FIRST order of ``order``, with no
    single-partition step over the data: only the per-partition counts (one row per
    partition, a bounded size) are combined globally."""
    ensure_checkpoint_dir(df.sparkSession)
    keys = [order] if isinstance(order, str) else list(order)
    cols = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    mark, part, off, n = "__dense_mark", "__dense_part", "__dense_off", "__dense_n"
    # sorted partitions: the high bits of the generated id are the partition, the low 33 the
    # place in it, so only the partitions' offsets remain to be joined
    ranged = (df.repartitionByRange(*cols).sortWithinPartitions(*cols)
              .withColumn(mark, F.monotonically_increasing_id()).checkpoint(eager=False))
    ranged = ranged.withColumn(part, F.shiftright(mark, 33))
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))
    offsets = counts.select(part, F.coalesce(
        F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias(off))
    place = F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(offsets, part).withColumn(id_col, (F.col(off) + place + 1).cast("long"))
            .drop(mark, part, off))


def assign_dimension_key(df: DataFrame, cols: Sequence[str], order: str = ROW,
                         id_col: str = "id") -> DataFrame:
    """Distinct raw key tuples numbered 1..n in first-seen order (raw values kept).

    Keys first seen on the same record number are ordered by their own values, so the
    numbering is total and deterministic."""
    first = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.min(F.col(f"`{order}`")).alias("_seen"))
    return dense_ids(first, ["_seen", *cols], id_col).drop("_seen")


def link_dimension(fact: DataFrame, dim: DataFrame, cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """Fact LEFT JOIN dimension on every raw key column, NULL matching NULL."""
    d = dim.select(id_col, *[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(cols)])
    cond = None
    for i, c in enumerate(cols):
        e = F.col(f"`{c}`").eqNullSafe(F.col(f"_d{i}"))
        cond = e if cond is None else cond & e
    return fact.join(d, cond, "left").drop(*[f"_d{i}" for i in range(len(cols))])


# ------------------------------------------------------------------ table builds
def build_diagnosis_codes(raw: DataFrame) -> DataFrame:
    """Positional extract (two code/description pairs at positions 0,1 and 4,5)."""
    c = [x for x in raw.columns if x != ROW]
    has_row = ROW in raw.columns
    pairs = stack_pairs(raw, [(c[0], c[1]), (c[4], c[5])], keep=[ROW] if has_row else [])
    # all left pairs come before all right pairs, each in record order
    order = F.struct(F.col("_pair"), F.col(ROW)) if has_row else F.col("_pair")
    cleaned = pairs.select(clean_text("code").alias("code"), clean_text("description").alias("description"),
                           order.alias("_ord")).where(F.col("code").isNotNull())
    return first_per_key(cleaned, ["code"], "_ord").select("code", "description")


def build_participant(roster: DataFrame, demo: DataFrame) -> DataFrame:
    """Roster (first row per person) LEFT JOIN demographics (first row per person)."""
    r = roster.select(person_key(_col(roster, ROSTER_NAME)).alias("participant_id"),
                      _col(roster, ROSTER_NAME).alias("_name"), F.col(ROW))
    r = first_per_key(r.where(F.col("participant_id").isNotNull()), ["participant_id"], ROW)
    race = collapse_flags({label: _col(demo, col) for label, col in RACE_FLAGS.items()
                           if col in demo.columns})
    d = demo.select(person_key(_col(demo, ROSTER_NAME)).alias("participant_id"),
                    parse_date(_col(demo, "DOB")).alias("date_of_birth"),
                    clean_text(_col(demo, "Gender")).alias("gender"),
                    race.alias("race_ethnicity"), F.col(ROW))
    d = first_per_key(d.where(F.col("participant_id").isNotNull()), ["participant_id"], ROW)
    last, first = split_name("_name")
    return (r.join(d.drop(ROW), "participant_id", "left")
            .select("participant_id", first.alias("first_name"), last.alias("last_name"),
                    "date_of_birth", "gender", "race_ethnicity"))


def build_enrollment(roster: DataFrame) -> DataFrame:
    """One row per roster record; rows without id or parsable start dropped."""
    return (roster.select(person_key(_col(roster, ROSTER_NAME)).alias("participant_id"),
                          parse_date(_col(roster, "Date Started MHC")).alias("start_date"),
                          parse_date(_col(roster, "Date Ended MHC")).alias("end_date"),
                          clean_text(_col(roster, "End Status")).alias("end_status"),
                          parse_number(_col(roster, "Length of MHC")).alias("length_days"))
            .dropna(subset=["participant_id", "start_date"]))


def charge_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """A3 applied to the criminal-history header."""
    h = Header(columns)
    dated = Header([c for c in h.columns if "DATE" in c.upper()])
    return {
        "date": h.named("CHARGE DATE") or dated.holding("CHARGE", without="MHC"),
        "first": h.named("FIRST NAME") or h.holding("FIRST"),
        "last": h.named("LAST NAME") or h.holding("LAST"),
        "offense": h.named("OFFENSE") or h.holding("OFFENSE"),
        "class": h.named("CLASS") or h.holding("CLASS"),
        "status": h.named("MHC STATUS") or h.holding("MHC", "STATUS"),
        "outcome": h.named("NG/DISMISSED") or h.holding("DISMISSED", "OUTCOME"),
    }


def build_charges(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Criminal history -> (charge_offense, participant_charge).

    Rows need a charge date; the offense dimension is the distinct raw (offense, class)
    pairs numbered in first-seen order, cleaned after the distinct (P15); facts link to
    it on the raw values with NULL-safe equality (B14).
    """
    cols = charge_columns(raw.columns)
    lacking = [k for k in ("date", "first", "last", "offense", "class") if cols[k] is None]
    if lacking:
        raise ValueError(f"criminal history header lacks columns for {lacking}: {raw.columns}")
    rows = raw.where(clean_text(_col(raw, cols["date"])).isNotNull())
    keyed = rows.select(F.col(ROW),
                        _col(rows, cols["offense"]).alias("_off"), _col(rows, cols["class"]).alias("_cls"),
                        person_key_from_parts(_col(rows, cols["last"]), _col(rows, cols["first"]))
                        .alias("participant_id"),
                        parse_date(_col(rows, cols["date"])).alias("charge_date"),
                        clean_text(_col(rows, cols["status"])).alias("status_at_charge"),
                        clean_text(replace_token(_col(rows, cols["outcome"]), "G/Convicted", "Convicted"))
                        .alias("outcome"))
    dim_raw = assign_dimension_key(keyed, ["_off", "_cls"], ROW, "offense_id")
    offense = dim_raw.select("offense_id", strip_ws("_off").alias("offense_name"),
                             F.upper(strip_ws("_cls")).alias("class"))
    facts = (link_dimension(keyed, dim_raw, ["_off", "_cls"], "offense_id")
             .select("participant_id", "offense_id", "charge_date", "status_at_charge", "outcome"))
    return offense, facts


def observed(raw: DataFrame, rejects: Observation | None, parses: dict) -> DataFrame:
    """Count in ``rejects``, while ``raw`` is read for its build, the values per column that are there but come out
    NULL of their parse; ``parses``: source column (None: not in this file) -> parse."""
    if rejects is None:
        return raw
    counts = [F.sum(F.when(clean_text(_col(raw, c)).isNotNull() & parse(_col(raw, c)).isNull(), 1).otherwise(0)).cast("long").alias(c)
              for c, parse in parses.items() if c]
    return raw.observe(rejects, *counts) if counts else raw


def build_diagnosis(raw: DataFrame, rejects: Observation | None = None) -> DataFrame:
    """Mental-health entry -> participant_diagnosis; rows without code or id dropped."""
    h = Header(raw.columns)
    name = h.holding(*NAME_KW)
    code = h.holding("DIAGNOSIS", "CODE", "DX")
    desc = h.holding("DIAGNOSIS", "DESCRIPTION", "CONDITION")
    date = h.holding("DATE", "ASSESSMENT", "ENTRY")
    if name is None or code is None:
        raise ValueError(f"mental-health header lacks name/code columns: {raw.columns}")
    raw = observed(raw, rejects, {date: parse_date})
    return (raw.select(person_key(_col(raw, name)).alias("participant_id"),
                       clean_text(_col(raw, code)).alias("diagnosis_code"),
                       clean_text(_col(raw, desc)).alias("diagnosis_description"),
                       parse_date(_col(raw, date)).alias("assessment_date"))
            .dropna(subset=["diagnosis_code", "participant_id"]))


def build_risk(raw: DataFrame, rejects: Observation | None = None) -> DataFrame:
    """Risk assessment -> risk_assessment."""
    h = Header(raw.columns)
    name = h.holding(*NAME_KW)
    if name is None:
        raise ValueError(f"risk header lacks a name column: {raw.columns}")
    date = h.holding("DATE", "ASSESSMENT")
    score = h.holding("SCORE", "LS/CMI", "LS CMI", "RISK")
    cat = h.holding("CATEGORY", "LEVEL", "RISK LEVEL")
    raw = observed(raw, rejects, {date: parse_date, score: parse_number})
    return (raw.select(person_key(_col(raw, name)).alias("participant_id"),
                       parse_date(_col(raw, date)).alias("assessment_date"),
                       parse_number(_col(raw, score)).alias("risk_score"),
                       clean_text(_col(raw, cat)).alias("risk_category"))
            .dropna(subset=["participant_id"]))


def build_jail(raw: DataFrame, rejects: Observation | None = None) -> DataFrame:
    """Jail tracking -> jail_data.  Days come from end - start only when the whole
    days column is empty (a data-dependent rule, evaluated as a broadcast one-row
    aggregate)."""
    h = Header(raw.columns)
    name = h.holding(*NAME_KW)
    if name is None:
        raise ValueError(f"jail header lacks a name column: {raw.columns}")
    start = h.holding("START", "BEGIN", "ADMISSION", "FROM")
    end = h.holding("END", "RELEASE", "TO", "DISCHARGE")
    days = h.holding("DAYS", "LENGTH", "DURATION")
    cost = h.holding("COST", "AMOUNT", "FEE", "CHARGE")
    n_days = raw.agg(F.count(parse_number(_col(raw, days))).alias("_n_days")).scalar()
    raw = observed(raw, rejects, {start: parse_date, end: parse_date, days: parse_number, cost: parse_number})
    rows = raw.select(person_key(_col(raw, name)).alias("participant_id"),
                      parse_date(_col(raw, start)).alias("start_date"),
                      parse_date(_col(raw, end)).alias("end_date"),
                      parse_number(_col(raw, days)).alias("_days"),
                      parse_number(_col(raw, cost)).alias("cost"))
    return (rows.withColumn("_n_days", n_days)
            .select("participant_id", "start_date", "end_date",
                    F.when(F.col("_n_days") == 0, F.date_diff("end_date", "start_date").cast("double"))
                    .otherwise(F.col("_days")).alias("days_incarcerated"), "cost")
            .dropna(subset=["participant_id"]))


def treatment_type_from_file(file_col) -> Column:
    """P13 (deliberate change): the category comes from the ``_MH_`` / ``_CD_`` segment
    of the file name, not from a bare substring test that every file name passes."""
    f = F.upper(file_col if isinstance(file_col, Column) else F.col(file_col))
    return (F.when(f.contains("_MH_"), "Mental Health").when(f.contains("_CD_"), "Chemical Dependency")
            .otherwise("Unknown"))


def build_treatment(raw: DataFrame, file_col: str = "source_file") -> DataFrame:
    """One treatment extract (rows tagged with its file name) -> treatment_episode."""
    h = Header([x for x in raw.columns if x != file_col])
    name = h.holding(*NAME_KW_CLIENT)
    if name is None:
        raise ValueError(f"treatment header lacks a name column: {raw.columns}")
    start = h.holding("START", "BEGIN", "ADMISSION", "DATE")
    end = h.holding("END", "COMPLETION", "DISCHARGE")
    typ = h.holding("TYPE", "SERVICE", "TREATMENT", "MODALITY")
    prov = h.holding("PROVIDER", "FACILITY", "AGENCY")
    outc = h.holding("OUTCOME", "RESULT", "STATUS", "COMPLETION")
    return (raw.select(person_key(_col(raw, name)).alias("participant_id"),
                       treatment_type_from_file(F.col(file_col)).alias("treatment_type"),
                       parse_date(_col(raw, start)).alias("start_date"),
                       parse_date(_col(raw, end)).alias("end_date"),
                       clean_text(_col(raw, typ)).alias("service_type"),
                       clean_text(_col(raw, prov)).alias("provider"),
                       clean_text(_col(raw, outc)).alias("outcome"))
            .dropna(subset=["participant_id"]))


def build_treatment_files(frames) -> DataFrame:
    """B19 over A4: each extract is resolved under its own header and projected to the canonical
    columns before the union, so differing headers lose no row."""
    return reduce(DataFrame.unionByName, [build_treatment(f) for f in frames])


def build_psychosocial(raw: DataFrame, carry: int | None = None) -> DataFrame:
    """Id, assessment date and the other source columns (the first ``carry``, if given)."""
    h = Header([x for x in raw.columns if x != ROW])
    name = h.holding(*NAME_KW_CLIENT)
    if name is None:
        raise ValueError(f"psychosocial header lacks a name column: {raw.columns}")
    date = h.holding("DATE", "ASSESSMENT", "COMPLETED")
    others = [x for x in h.columns if x not in (name, date)][:carry]
    return (raw.select(person_key(_col(raw, name)).alias("participant_id"),
                       parse_date(_col(raw, date)).alias("assessment_date"),
                       *[_col(raw, o).alias(o) for o in others])
            .dropna(subset=["participant_id"]))
