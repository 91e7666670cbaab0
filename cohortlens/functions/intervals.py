"""Placement of a dated event relative to an interval [start, end] (end NULL = open)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c


def in_interval(d, start, end) -> Column:
    """Start <= d and (d <= end or end is NULL)."""
    d, start, end = _c(d), _c(start), _c(end)
    return (d >= start) & ((d <= end) | end.isNull())


def in_lookback(d, start, days: int | None = None) -> Column:
    """C11: d strictly before start, optionally no more than ``days`` days before."""
    d, start = _c(d), _c(start)
    cond = d < start
    if days is not None:
        cond = cond & (F.date_diff(start, d) <= days)
    return cond


def in_followup(d, end, days: int | None = None) -> Column:
    """D strictly after end, optionally no more than ``days`` days after."""
    d, end = _c(d), _c(end)
    cond = d > end
    if days is not None:
        cond = cond & (F.date_diff(d, end) <= days)
    return cond


def recent(d, as_of, days: int) -> Column:
    """D >= as_of - days.  ``as_of`` is a parameter (date or ISO text), not the clock."""
    if isinstance(as_of, (str, _dt.date)):
        as_of = F.lit(str(as_of)).cast("date")
    return _c(d) >= F.date_sub(as_of, days)


def window_predicate(window: str, d, start, end, days: int | None = None) -> Column:
    """Named window -> predicate: before / lookback / during / after / followup."""
    if window == "before":
        return in_lookback(d, start)
    if window == "lookback":
        return in_lookback(d, start, days)
    if window == "during":
        return in_interval(d, start, end)
    if window == "after":
        return in_followup(d, end)
    if window == "followup":
        return in_followup(d, end, days)
    raise ValueError(f"unknown window {window!r}")
