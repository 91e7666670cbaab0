"""Keyword and delimiter predicates over free-text diagnosis cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c

# ---- fixed values: diagnosis keyword lists of the reports (upper case) ----
PTSD_WORDS = ["PTSD", "POST-TRAUMATIC", "TRAUMA"]
PTSD_TREND_WORDS = ["PTSD", "POST-TRAUMATIC"]
BIPOLAR_WORDS = ["BIPOLAR", "MANIC"]
ANXIETY_WORDS = ["ANXIETY", "GAD", "PANIC"]
# Co-occurrence labels, first match wins: (label, all-of keywords)
COMBINATIONS = [("PTSD + Bipolar", ["PTSD", "BIPOLAR"]),
                ("PTSD + Anxiety", ["PTSD", "ANXIETY"]),
                ("PTSD + Depression", ["PTSD", "DEPRESS"]),
                ("Bipolar + Anxiety", ["BIPOLAR", "ANXIETY"])]


def _contains_ci(c: Column, word: str) -> Column:
    return F.upper(c).contains(word.upper())


def has_any_keyword(col, words: Sequence[str]) -> Column:
    """Text contains any keyword, ignoring case; NULL text gives NULL."""
    c = _c(col)
    expr = None
    for w in words:
        t = _contains_ci(c, w)
        expr = t if expr is None else (expr | t)
    return expr


def has_no_keyword(col, words: Sequence[str]) -> Column:
    """Text contains none of the keywords; NULL text stays NULL (not counted)."""
    c = _c(col)
    expr = None
    for w in words:
        t = ~_contains_ci(c, w)
        expr = t if expr is None else (expr & t)
    return expr


def combo_label(col, rules=COMBINATIONS, default: str = "Other Combinations") -> Column:
    """First rule whose keywords all occur (case-insensitive) names the row."""
    c = _c(col)
    expr = None
    for label, words in rules:
        cond = None
        for w in words:
            t = _contains_ci(c, w)
            cond = t if cond is None else (cond & t)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)
