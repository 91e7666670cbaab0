"""Banding, relabelling and age expressions (all native Column expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c

# ---- fixed values: report band definitions (label per calendar-year span) ----
# Entry-year bands used by the enrolment distribution report.
FISCAL_YEAR_BANDS = [(2019, 2020, "FY19-20"), (2021, 2021, "FY21"), (2022, 2022, "FY22"),
                     (2023, 2023, "FY23"), (2024, 2024, "FY24"), (2025, 2025, "FY25")]
# Enrolment-year bands used by the diagnosis trend report.
TREND_YEAR_BANDS = [(2019, 2020, "2019-2020"), (2021, 2021, "2021"), (2022, 2022, "2022"),
                    (2023, 2023, "2023"), (2024, 2024, "2024")]
# Two-year band of the graduation-by-year report.
GRADUATION_YEAR_BANDS = [(2023, 2023, "FY23"), (2024, 2024, "FY24")]
# Age groups of the example query: (low, high, label); None = open end.
AGE_GROUPS = [(None, 17, "Under 18"), (18, 30, "18-30"), (31, 50, "31-50"), (51, None, "Over 50")]
# Gender prefix bands.
GENDER_PREFIXES = [("F", "Female"), ("M", "Male")]
# Risk category -> probation norm text, and the category order.
RISK_NORMS = {"Low": "0-3 (US Norm: 23%)", "Medium": "4-6 (US Norm: 38%)",
              "High": "7-9 (US Norm: 28%)", "Very High": "10+ (US Norm: 11%)"}
RISK_ORDER = ["Low", "Medium", "High", "Very High"]


def year_band(date_col, spec: Sequence[tuple[int, int, str]], default: str = "Other") -> Column:
    """Label the calendar year of a date by inclusive year spans; NULL date -> default."""
    y = F.year(_c(date_col))
    expr = None
    for lo, hi, label in spec:
        cond = y.between(lo, hi) if lo != hi else (y == lo)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def band_rank(label_col, labels: Sequence[str]) -> Column:
    """Sort key of a band label (position in ``labels``; unknown labels last)."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]), _c(label_col)).cast("int"),
                      F.lit(len(labels) + 1))


def prefix_band(col, spec: Sequence[tuple[str, str]] = GENDER_PREFIXES, default: str = "Other") -> Column:
    """upper(x) LIKE 'P%' -> label, first match wins; NULL -> default."""
    u = F.upper(_c(col))
    expr = None
    for prefix, label in spec:
        cond = u.startswith(prefix)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def relabel(col, mapping: dict, default=None) -> Column:
    """C4: simple CASE value -> label."""
    c = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def delimited_count(col, delim: str = ",") -> Column:
    """Number of items in a delimited cell (delimiters + 1); NULL stays NULL."""
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(delim), F.lit(""))) + F.lit(1)


def count_band(n_col, labels=("1 Diagnosis", "2 Diagnoses", "3+ Diagnoses")) -> Column:
    """1 / 2 / 3+ band of an item count (anything below 2 is the first band)."""
    n = _c(n_col)
    return F.when(n >= 3, labels[2]).when(n == 2, labels[1]).otherwise(labels[0])


def numeric_band(col, spec=AGE_GROUPS, default: str = "Unknown") -> Column:
    """Inclusive numeric ranges -> label; NULL -> default."""
    c = _c(col)
    expr = None
    for lo, hi, label in spec:
        if lo is None:
            cond = c <= hi
        elif hi is None:
            cond = c >= lo
        else:
            cond = c.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def age_at(on_date, birth_date) -> Column:
    """H3: whole years as trunc(days / 365.25) (not calendar age; kept on purpose)."""
    return (F.date_diff(_c(on_date), _c(birth_date)) / F.lit(365.25)).cast("int")
