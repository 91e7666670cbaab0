"""Column-level building blocks: every function returns a pyspark ``Column``."""

from .aggs import (avg_int_rounded, count_if_sum, distinct_if, flag, pct_true, per_subject,
                   rate, ratio_text, share_of_total)
from .bands import (age_at, band_rank, count_band, delimited_count, numeric_band, prefix_band,
                    relabel, year_band)
from .intervals import in_followup, in_interval, in_lookback, recent, window_predicate
from .numeric import pct, pct_unrounded, round_ratio, round_real, safe_div
from .text import combo_label, has_any_keyword, has_no_keyword

__all__ = [n for n in dir() if not n.startswith("_")]
