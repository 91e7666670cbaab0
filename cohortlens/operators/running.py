"""Counts of events in intervals by running counts over the calendar.

Events and intervals of one subject never meet as pairs.  How many events an interval holds is the
difference of two look-ups: events up to its last day less events up to the day before its first.

1. Events are first reduced to one row per (subject, day), dealt by both.  From then on a subject has no more rows
   than its calendar has days, whatever share of the events it holds, so one window per subject is a small sort.
2. ``running_sums``: look-ups are distinct (subject, day) points, sorted in with the events; a running sum passes them.
   ``next_days`` passes them the other way and keeps the next day with an event.
3. ``windowed_sums`` (a ``calendar`` and the ``calendar_sums`` over it) first reduces equal intervals to one row, then every interval to its signed points, and those to one row
   per (subject, day), joined to the events' on (subject, day): what a report sums over all events of all intervals of a
   subject is a sum over points.
4. ``count_in_interval`` keeps the intervals: each look-up is an equi-join on (subject, day).

No step has more rows of one subject than its calendar has days (for step 4: than it has different intervals), and no raw
events or intervals meet on the subject alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAST = 1 << 30  # a day after all others


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt by ``cols`` into the session's number of parts.  AQE, which merges parts by their compressed size, leaves
    these alone: rows of many columns that are mostly 0 are ten times as large when a task sorts them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def running_sums(rows: DataFrame, points: DataFrame, by: Sequence[str], at: str, measures: Sequence[str]) -> DataFrame:
    """For each distinct (by, at) of ``points``: sums of the measures over the rows of ``by`` up to ``at``.

    ``at`` is an integer; rows should be reduced to one per (by, at).  Rows whose ``at`` is NULL count
    nowhere; points without rows before them get 0."""
    zero = [F.lit(0).cast("long").alias(m) for m in measures]
    asked = points.select(*by, at).where(F.col(at).isNotNull()).distinct().select(*by, at, *zero, F.lit(True).alias("_asked"))
    held = rows.where(F.col(at).isNotNull()).select(*by, at, *[F.col(m).cast("long").alias(m) for m in measures],
                                                   F.lit(False).alias("_asked"))
    upto = W.partitionBy(*by).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    return (held.unionByName(asked).select(*by, at, "_asked", *[F.sum(m).over(upto).alias(m) for m in measures])
            .where("_asked").drop("_asked"))


def next_days(days: DataFrame, points: DataFrame, by: Sequence[str], at: str, next_col: str = "_next") -> DataFrame:
    """For each distinct (by, at) of ``points``: the first day of ``days`` (by, at) from ``at`` on, NULL if none."""
    asked = points.select(*by, at).where(F.col(at).isNotNull()).distinct().select(*by, at, F.lit(None).cast("int").alias("_day"))
    held = days.where(F.col(at).isNotNull()).select(*by, at, F.col(at).cast("int").alias("_day"))
    onwards = W.partitionBy(*by).orderBy(F.desc(at)).rangeBetween(W.unboundedPreceding, W.currentRow)
    return (held.unionByName(asked).select(*by, at, "_day", F.min("_day").over(onwards).alias(next_col))
            .where("_day is null").drop("_day"))


def window_points(window: str, start, end, days: int | None = None) -> list[tuple[int, Column]]:
    """The signed days whose running counts add up to the events of a window (see ``functions.intervals``):
    any / before / lookback / during / after / followup.  NULL where the window holds nothing."""
    s, e = F.unix_date(start), F.unix_date(end)
    never = F.lit(None).cast("int")
    if window == "any":
        return [(1, F.lit(LAST))]
    if window == "before":
        return [(1, s - 1)]
    if window == "lookback":
        return [(1, s - 1), (-1, s - days - 1)]
    if window == "during":
        holds = s.isNotNull() & (e.isNull() | (e >= s))
        return [(1, F.when(holds, F.coalesce(e, F.lit(LAST))).otherwise(never)), (-1, F.when(holds, s - 1).otherwise(never))]
    if window == "after":
        return [(1, F.when(e.isNotNull(), F.lit(LAST)).otherwise(never)), (-1, e)]
    if window == "followup":
        return [(1, e + days), (-1, e)]
    raise ValueError(f"unknown window {window!r}")


def window_span(window: str, start, end, days: int | None = None) -> tuple[Column, Column]:
    """First and last day (as numbers) of a window; NULL or the wrong way round where the window holds nothing."""
    s, e = F.unix_date(start), F.unix_date(end)
    first, last = F.lit(-LAST), F.lit(LAST)
    if window == "any":
        return first, last
    if window == "before":
        return first, s - 1
    if window == "lookback":
        return s - days, s - 1
    if window == "during":
        return s, F.coalesce(e, last)
    if window == "after":
        return e + 1, last
    if window == "followup":
        return e + 1, e + days
    raise ValueError(f"unknown window {window!r}")


def event_days(events: DataFrame, id_col: str, date_col: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (id, day) with ``at`` (the day as a number) and sums of the measures.

    Rows are dealt by (id, day) before they are summed: most are the only one of their day, so a map task that summed
    them first would hold nearly all of its rows and spill them.  Those of one day go to one task, which sums them as they come."""
    rows = events.where(F.col(date_col).isNotNull() & F.col(id_col).isNotNull()).select(
        id_col, F.unix_date(date_col).alias("_at"), *[c.alias(m) for m, c in measures.items()])
    return dealt(rows, id_col, "_at").groupBy(id_col, "_at").agg(*[F.sum(m).cast("long").alias(m) for m in measures])


def _weights(sums: dict[str, tuple]) -> dict[tuple, tuple[str, Column]]:
    """A column name for each different (window, days, weight) of ``sums``."""
    out: dict[tuple, tuple[str, Column]] = {}
    for window, n, _, weight in sums.values():
        out.setdefault((window, n, str(weight)), (f"_w{len(out)}", weight))
    return out


def calendar(intervals: DataFrame, days: DataFrame, sums: dict[str, tuple], id_col: str = "participant_id",
             start_col: str = "start_date", end_col: str = "end_date", held: bool = False) -> DataFrame:
    """One row per (subject, day) with events or with an end of a window: what ``calendar_sums`` passes.

    It has the measures of ``days``, and where intervals have points (``_asked``) their signed weights; with ``held`` also
    the earliest and latest start of the intervals that end on the day, and ``_event`` where there is one."""
    by_name = {name: (window, n, weight) for (window, n, _), (name, weight) in _weights(sums).items()}
    # equal intervals first, dealt as in ``event_days``: they are as many rows as the subject has different ones
    iv = dealt(intervals.where(F.col(id_col).isNotNull()), id_col, start_col, end_col).groupBy(id_col, start_col, end_col).agg(
        F.lit(1).alias("_one"), *[F.sum(weight).cast("long").alias(name) for name, (_, _, weight) in by_name.items()])
    zero = F.lit(0).cast("long")
    ends: dict[str, tuple[Column, dict[str, int]]] = {}  # windows that end on the same day share its point
    for name, (window, n, _) in by_name.items():
        for sign, at in window_points(window, F.col(start_col), F.col(end_col), n):
            signs = ends.setdefault(str(at), (at, {}))[1]
            signs[name] = signs.get(name, 0) + sign
    never = F.lit(None).cast("int")
    start = F.coalesce(F.unix_date(start_col), F.lit(LAST + 1))  # without a start it holds nothing
    points = [(at, signs, never) for at, signs in ends.values()]
    points += [(F.coalesce(F.unix_date(end_col), F.lit(LAST)), {}, start)] if held else []
    structs = [F.struct(at.cast("int").alias("_at"), *[(F.col(w) * signs[w] if w in signs else zero).alias(w) for w in by_name],
                        *([first.alias("_start")] if held else [])) for at, signs, first in points]
    spans = [F.min("_start").alias("_first"), F.max("_start").alias("_last")] if held else []
    points = (iv.select(id_col, F.inline(F.array(*structs))).where(F.col("_at").isNotNull())
              .groupBy(id_col, "_at").agg(F.lit(True).alias("_asked"), *[F.sum(w).alias(w) for w in by_name], *spans))
    measures = sorted({m for _, _, m, _ in sums.values()})
    # both sides are dealt by (id, day) already
    return (days.where(F.col(id_col).isNotNull()).select(id_col, "_at", *measures, *([F.lit(True).alias("_event")] if held else []))
            .join(points, [id_col, "_at"], "full_outer"))


def calendar_sums(both: DataFrame, sums: dict[str, tuple], id_col: str = "participant_id", held: bool = False) -> DataFrame:
    """One row per subject of a ``calendar`` that has points: the ``sums``, and with ``held`` ``any_hit`` and ``all_hit``.

    A running sum passes events and points of a subject in one go.  An interval holds an event where the last event day up
    to its end is not before its start, so of the intervals that end on a day the earliest and the latest start tell."""
    weights = _weights(sums)
    measures = sorted({m for _, _, m, _ in sums.values()})
    zero = F.lit(0).cast("long")
    upto = W.partitionBy(id_col).orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.coalesce(F.max(F.when(F.col("_event"), F.col("_at"))).over(upto), F.lit(-LAST)) if held else None
    counts = dealt(both, id_col).select(id_col, "_asked", *[w for w, _ in weights.values()],
                         *[F.coalesce(F.sum(m).over(upto), zero).alias(m) for m in measures],
                         *(["_first", "_last", last.alias("_day")] if held else [])).where("_asked")
    out = [F.sum(F.col(weights[window, n, str(weight)][0]) * F.col(m)).alias(name) for name, (window, n, m, weight) in sums.items()]
    if held:
        hit = [F.when(F.col(c).isNotNull(), F.when(F.col("_day") >= F.col(c), 1).otherwise(0)) for c in ("_first", "_last")]
        out += [F.max(hit[0]).alias("any_hit"), F.min(hit[1]).alias("all_hit")]
    return counts.groupBy(id_col).agg(*out)


def windowed_sums(intervals: DataFrame, days: DataFrame, sums: dict[str, tuple], id_col: str = "participant_id",
                  start_col: str = "start_date", end_col: str = "end_date") -> DataFrame:
    """One row per subject whose intervals have a window to look at (0 where it holds no events): for each name in
    ``sums``, the sum over the subject's intervals of weight times the measure of the events in the window.

    ``sums``: name -> (window, days, measure, weight Column over ``intervals``).  ``days`` comes from ``event_days``."""
    return calendar_sums(calendar(intervals, days, sums, id_col, start_col, end_col), sums, id_col)


def held_intervals(intervals: DataFrame, days: DataFrame, id_col: str = "participant_id", start_col: str = "start_date",
                   end_col: str = "end_date") -> DataFrame:
    """One row per subject of ``intervals``: ``any_hit`` and ``all_hit`` (0 or 1), whether any and whether every one of its
    intervals holds an event (during)."""
    return calendar_sums(calendar(intervals, days, {}, id_col, start_col, end_col, held=True), {}, id_col, held=True)


def count_in_interval(intervals: DataFrame, days: DataFrame, window: str, n: int | None = None, measure: str = "n",
                      count_col: str = "_n", id_col: str = "participant_id", start_col: str = "start_date",
                      end_col: str = "end_date") -> DataFrame:
    """The different (id, start, end) of ``intervals`` with the events in their window (0 where none)."""
    out = intervals.select(id_col, start_col, end_col).distinct()
    points = window_points(window, F.col(start_col), F.col(end_col), n)
    names = [f"_p{i}" for i in range(len(points))]
    out = out.select("*", *[at.cast("int").alias(p) for p, (_, at) in zip(names, points, strict=True)])
    asked = out.select(id_col, F.explode(F.array(*names)).alias("_at")).where(F.col(id_col).isNotNull())
    counts = running_sums(days, asked, [id_col], "_at", [measure])
    total = F.lit(0).cast("long")
    for p, (sign, _) in zip(names, points, strict=True):
        found = counts.select(F.col(id_col).alias(f"{p}_id"), F.col("_at").alias(f"{p}_at"), F.col(measure).alias(f"{p}_n"))
        out = out.join(found, (F.col(id_col) == F.col(f"{p}_id")) & (F.col(p) == F.col(f"{p}_at")), "left")
        total = total + sign * F.coalesce(f"{p}_n", F.lit(0))
    return out.select(id_col, start_col, end_col, total.alias(count_col))
