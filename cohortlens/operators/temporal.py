"""Events placed against per-subject intervals (interval joins, semi/anti, first event).

Scale strategy
--------------
Joining events and intervals on the subject alone brings all pairs of a hot subject together.
Counts and sums therefore go through ``operators.running``: running counts over the calendar, looked up at the ends of the
intervals; existence (EXISTS / NOT EXISTS) asks for the first event day from an interval's first day on.  What remains a join of events and
intervals returns pairs by definition:

* ``events_in_window`` (D6) returns one row per (event, interval): an inner join on raw rows, whose
  hot partitions AQE splits (nothing is grouped by the id after it).
* ``flag_intervals`` evaluates conditions over columns of both sides, on events reduced to one row
  per (id, day, ...) first (``day_counts``); an inner join and a zero row per interval in place of an
  outer join, whose right side AQE cannot split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import window_predicate
from .running import next_days, window_span


def day_counts(events: DataFrame, id_col: str, date_col: str, keys: Sequence[str] = (),
               measures: dict[str, Column] | None = None) -> DataFrame:
    """Pre-aggregate events to one row per (id, day, *keys) with ``n`` plus sum measures."""
    measures = measures or {}
    return (events.groupBy(id_col, date_col, *keys)
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in measures.items()]))


def events_in_window(events: DataFrame, intervals: DataFrame, window: str, days: int | None = None,
                     id_col: str = "participant_id", date_col: str = "charge_date",
                     start_col: str = "start_date", end_col: str = "end_date") -> DataFrame:
    """Inner join of events to intervals on id, keeping events in the named window.

    ``window`` is one of before / lookback / during / after / followup (see
    ``functions.intervals.window_predicate``).  Output has the event columns plus the
    interval columns (interval id column dropped).  One output row per (event, interval)
    match, i.e. the SQL join fan-out is preserved.
    """
    iv = intervals.withColumnRenamed(id_col, "_iv_id")
    cond = (F.col(id_col) == F.col("_iv_id")) & window_predicate(
        window, F.col(date_col), F.col(start_col), F.col(end_col), days)
    return events.join(iv, cond, "inner").drop("_iv_id")


def _interval_cond(window, days, id_col, date_col, start_col, end_col, ev_alias="_ev"):
    return ((F.col(id_col) == F.col(f"{ev_alias}_id"))
            & window_predicate(window, F.col(f"{ev_alias}_d"), F.col(start_col), F.col(end_col), days))


def with_any(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` with at least one matching row in ``right`` (EXISTS).

    The right side is reduced to its distinct keys first (a partial aggregate), so a key
    holding a large share of ``right`` never reaches one semi-join task as raw rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def _held(intervals, events, window, days, id_col, date_col, start_col, end_col) -> tuple[DataFrame, Column]:
    """The first event day from every (id, first day of a window) on, and the condition that it lies in the window."""
    first, last = window_span(window, F.col(start_col), F.col(end_col), days)
    day = events.select(F.col(id_col).alias("_held_id"), F.unix_date(date_col).alias("_held_from"))
    asked = intervals.where((first <= last) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_held_id"), first.alias("_held_from"))
    held = next_days(day.dropna().distinct(), asked, ["_held_id"], "_held_from", "_held_day").where("_held_day is not null")
    return held, (F.col(id_col) == F.col("_held_id")) & (first == F.col("_held_from")) & (F.col("_held_day") <= last)


def with_event_in_interval(intervals: DataFrame, events: DataFrame, window: str = "during",
                           days: int | None = None, id_col: str = "participant_id",
                           date_col: str = "charge_date", start_col: str = "start_date",
                           end_col: str = "end_date") -> DataFrame:
    """Intervals having at least one event in the window (EXISTS equi + range)."""
    held, same = _held(intervals, events, window, days, id_col, date_col, start_col, end_col)
    return intervals.join(held, same, "left_semi")


def without_event_in_interval(intervals: DataFrame, events: DataFrame, window: str = "during",
                              days: int | None = None, id_col: str = "participant_id",
                              date_col: str = "charge_date", start_col: str = "start_date",
                              end_col: str = "end_date") -> DataFrame:
    """Intervals with no event in the window (NOT EXISTS equi + range)."""
    held, same = _held(intervals, events, window, days, id_col, date_col, start_col, end_col)
    return intervals.join(held, same, "left_anti")


def first_event(events: DataFrame, id_col: str = "participant_id",
                date_col: str = "charge_date", alias: str = "first_date") -> DataFrame:
    """Earliest dated event per subject (partial aggregate, skew-safe)."""
    return (events.where(F.col(date_col).isNotNull())
            .groupBy(id_col).agg(F.min(date_col).alias(alias)))


def gap_from_first_event(intervals: DataFrame, events: DataFrame, id_col: str = "participant_id",
                         date_col: str = "charge_date", start_col: str = "start_date") -> DataFrame:
    """Interval rows joined to their subject's first event, with the day gap."""
    fe = first_event(events, id_col, date_col)
    return (intervals.join(fe, id_col)
            .withColumn("gap_days", F.date_diff(F.col(start_col), F.col("first_date")).cast("long")))


def flag_intervals(intervals: DataFrame, events: DataFrame, keys: Sequence[str],
                   window: str, days: int | None, flags: dict[str, Column],
                   id_col: str = "participant_id", date_col: str = "charge_date",
                   start_col: str = "start_date", end_col: str = "end_date",
                   interval_flags: dict[str, Column] | None = None) -> DataFrame:
    """Per (keys) 0/1 flags: does any event in the window satisfy each flag condition?

    Replaces ``intervals LEFT JOIN events`` + several ``COUNT(DISTINCT CASE ...)``:
    matching events come from an inner interval join (pre-aggregated events, skew
    splittable), every interval contributes a zero row through a union, and one
    ``groupBy(keys)`` with max() yields one row per key.  ``keys`` must be interval
    columns and end with the subject id; ``flags`` are conditions over the matched
    (event and interval) columns; ``interval_flags`` are conditions over interval columns
    only, set on every interval whether or not it has events.
    """
    interval_flags = interval_flags or {}
    ev = events.withColumnRenamed(id_col, "_ev_id").withColumnRenamed(date_col, "_ev_d")
    cond = _interval_cond(window, days, id_col, date_col, start_col, end_col)
    iflags = [F.when(c, 1).otherwise(0).alias(n) for n, c in interval_flags.items()]
    matched = (intervals.join(ev, cond, "inner")
               .select(*keys, *iflags, *[F.when(c, 1).otherwise(0).alias(n) for n, c in flags.items()]))
    zeros = intervals.select(*keys, *iflags, *[F.lit(0).alias(n) for n in flags])
    subject = keys[-1]
    names = [*interval_flags, *flags]
    return (zeros.unionByName(matched).where(F.col(subject).isNotNull())
            .groupBy(*keys).agg(*[F.max(n).alias(n) for n in names]))
