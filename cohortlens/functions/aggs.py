"""Aggregate expressions with SQLite-compatible NULL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c, pct, round_ratio

ONE = "*"  # F.count(ONE) is COUNT(*); a name, so no Column is built at import time


def flag(cond) -> Column:
    """1 when the condition holds, else 0 (NULL condition -> 0), as an int."""
    return F.when(_c(cond), 1).otherwise(0)


def count_if_sum(cond) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) — NULL over an empty group."""
    return F.sum(flag(cond))


def distinct_if(cond, id_col) -> Column:
    """COUNT(DISTINCT CASE WHEN cond THEN id END).

    For several of these in one aggregate prefer ``operators.metrics.per_subject_flags``
    (one row per subject, no Expand).
    """
    return F.count_distinct(F.when(_c(cond), _c(id_col)))


def pct_true(cond, digits: int = 2, weight: str | None = None) -> Column:
    """E5: ROUND(AVG(CASE WHEN cond THEN 1 ELSE 0 END) * 100, digits), exact.

    ``weight``: column with the number of rows that each (pre-reduced) row stands for."""
    if weight:
        return pct(F.sum(flag(cond) * F.col(weight)), F.sum(weight), digits)
    return pct(F.sum(flag(cond)), F.count(ONE), digits)


def share_of_total(n, total, digits: int = 2) -> Column:
    """N as a rounded percentage of a grand total (total from a one-row aggregate)."""
    return pct(n, total, digits)


def rate(num, den, digits: int = 2) -> Column:
    """Rate within a group, num * 100 / den, rounded; NULL on an empty denominator."""
    return pct(num, den, digits)


def ratio_text(a, b, digits: int = 2) -> Column:
    """E8: 'a/b rounded' || ':1'; NULL when b is zero."""
    return F.concat(round_ratio(a, b, digits).cast("string"), F.lit(":1"))


def per_subject(n, ids, digits: int = 2) -> Column:
    """Average events per subject, COUNT(*) / COUNT(DISTINCT id), rounded."""
    return round_ratio(n, ids, digits)


def avg_int_rounded(col, digits: int = 1) -> Column:
    """AVG of an integral column rounded exactly (sum and count kept integral)."""
    c = _c(col)
    return round_ratio(F.sum(c.cast("long")), F.count(c), digits)
