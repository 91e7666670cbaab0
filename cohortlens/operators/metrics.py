"""DataFrame-level metric operators: totals, labelled metric rows, roll-ups, top-k.

Design rules used throughout:
* A grand total is a global aggregate, i.e. exactly one row, attached to other rows as
  scalar subqueries (``DataFrame.scalar()``): computed once, merged with sibling scalar
  subqueries over the same aggregate by the optimizer, and no join at all.
* Several labelled result rows (SQL ``UNION ALL`` arms over the same input) are produced
  from ONE aggregate pass and exploded with ``inline`` instead of re-scanning per arm.
* Several ``COUNT(DISTINCT CASE ...)`` in one aggregate are replaced by one
  ``groupBy(subject)`` pass producing 0/1 flags, followed by sums (no Expand).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import _c, round_ratio, round_real


def scalars(total: DataFrame) -> list[Column]:
    """The columns of a one-row aggregate as Columns of ONE struct-valued scalar subquery."""
    cols = total.columns
    if len(cols) == 1:
        return [total.select(F.col(f"`{cols[0]}`")).scalar().alias(cols[0])]
    s = total.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_s")).scalar()
    return [s.getField(c).alias(c) for c in cols]


def with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate (scalar subquery) to every row.

    ``total`` must be a global aggregate (``df.agg(...)``), which has exactly one row.
    """
    return df.select("*", *scalars(total))


def one_row(*parts: DataFrame) -> DataFrame:
    """Combine several one-row aggregates into one row."""
    out = parts[0]
    for p in parts[1:]:
        out = out.select("*", *scalars(p))
    return out


def metric_rows(df: DataFrame, rows: Sequence[dict[str, Column]], types: dict[str, str],
                keep: Sequence[str] = ()) -> DataFrame:
    """Turn each input row into len(rows) labelled output rows.

    ``rows`` are dicts output-column -> expression over ``df``; missing columns are NULL
    (G3 padding); every column is cast to ``types`` so the arms agree (G2 mixed types are
    expressed by declaring the column 'string').
    """
    structs = []
    for r in rows:
        fields = []
        for name, typ in types.items():
            expr = r.get(name)
            expr = F.lit(None) if expr is None else (F.lit(expr) if not isinstance(expr, Column) else expr)
            fields.append(expr.cast(typ).alias(name))
        structs.append(F.struct(*fields))
    return df.select(*keep, F.inline(F.array(*structs)))


def per_subject_flags(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """One row per subject (``keys``) with max(0/1 flag) per named condition.

    Rows whose last key (the subject id) is NULL are dropped, as COUNT(DISTINCT id) would.
    """
    subject = keys[-1]
    return (df.where(F.col(subject).isNotNull())
            .groupBy(*keys)
            .agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()]))


def per_subject_summary(events: DataFrame, id_col: str, value: Column | None = None,
                        digits: int = 2) -> DataFrame:
    """Per-subject count (or per-subject sum of ``value``) -> avg/min/max/total.

    Two aggregation levels; the first is partial-aggregated map side so a hot subject
    never travels as raw rows.  Subjects with no rows are absent (as in SQL).
    """
    measure = F.count(F.lit(1)) if value is None else F.sum(value)
    per = events.groupBy(id_col).agg(measure.alias("n"))
    return per.agg(round_ratio(F.sum("n"), F.count(F.lit(1)), digits).alias("Average"),
                   F.min("n").alias("Minimum"), F.max("n").alias("Maximum"),
                   F.sum("n").alias("Total"))


def pop_stddev(x) -> Column:
    """Population standard deviation by merged central moments, which do not cancel
    where the mean is large against the spread."""
    return F.stddev_pop(_c(x))


def with_total_row(df: DataFrame, key: str, aggs: dict[str, Column], label: str = "TOTAL") -> DataFrame:
    """Group rows plus a grand-total row in one pass with ``rollup``.

    Rows with a NULL key still count in the total, but their own group row is dropped
    (the SQL shape is a grouped arm with ``key IS NOT NULL`` plus a total arm).
    Only use with aggregates that are correct at every rollup level (counts, sums,
    count_distinct computed per level), over rows already reduced to (key, subject): the
    roll-up expands what it reads.
    """
    g = df.rollup(key).agg(*[c.alias(n) for n, c in aggs.items()], F.grouping_id().alias("_gid"))
    return (g.where((F.col("_gid") == 1) | F.col(key).isNotNull())
            .select(F.when(F.col("_gid") == 1, F.lit(label)).otherwise(F.col(key)).alias(key),
                    *aggs.keys()))


def avg_duration(start, end) -> Column:
    """Average whole-day duration where both ends are known (NULL ends drop out)."""
    return F.avg(F.date_diff(_c(end), _c(start)))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """ORDER BY ... LIMIT k with a full tiebreak (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


# ---- fixed values: cost model parameters of the jail-savings report ----
DAILY_JAIL_COST = 271.0
BEFORE_RATE_UPLIFT = 1.5


def cost_model(jail: DataFrame, enrollment: DataFrame, rate: float = DAILY_JAIL_COST,
               uplift: float = BEFORE_RATE_UPLIFT) -> DataFrame:
    """Three scalar aggregates -> actual cost, projected cost, difference (one row).

    projected = n_enrolments * avg(length) / 365 * (avg(jail days) * rate) * uplift
    """
    j = jail.agg(F.sum(F.when(F.col("days_incarcerated").isNotNull(), F.col("days_incarcerated")))
                 .alias("days_sum"),
                 F.avg("days_incarcerated").alias("days_avg"))
    e = enrollment.agg(F.count(F.lit(1)).alias("n_enrol"), F.avg("length_days").alias("len_avg"))
    row = one_row(j, e)
    actual = F.col("days_sum") * F.lit(rate)
    projected = (F.col("n_enrol") * F.col("len_avg") / F.lit(365.0)
                 * (F.col("days_avg") * F.lit(rate)) * F.lit(uplift))
    return row.select(round_real(actual, 2).alias("actual_cost"),
                      round_real(projected, 2).alias("projected_cost"),
                      round_real(projected - actual, 2).alias("net_savings"))
