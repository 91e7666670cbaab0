"""Division and rounding that give the same bits in Spark and in the SQL oracle.

* Count ratios are rounded in integer arithmetic (exact half-away-from-zero rounding of
  the true rational), so no binary-decimal artefact can creep in.
* Real-valued averages are rounded with a fixed sequence of IEEE operations
  ``sign(x) * floor(|x| * 10^d + 0.5) / 10^d`` that both engines evaluate identically.
* Division by zero yields NULL (Spark's ANSI mode would raise; ``try_divide`` semantics).

Every Spark helper has a ``sql_*`` twin producing the DuckDB snippet used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def idiv(a: Column, b: Column) -> Column:
    """Integral division of longs (SQL ``div``); exact, unlike double division."""
    return F.call_function("div", a, b)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def round_ratio(num, den, digits: int = 2, scale: int = 1) -> Column:
    """round(num * scale / den, digits) for integral num/den, exact; NULL if den <= 0 or NULL.

    With column names the whole expression is one SQL expression (a single round trip to
    the JVM when building the plan); with Columns it is composed from functions.
    """
    mult = 2 * scale * 10 ** digits
    if isinstance(num, str) and isinstance(den, str):
        n, d = f"CAST({_q(num)} AS BIGINT)", f"CAST({_q(den)} AS BIGINT)"
        return F.expr(f"CASE WHEN {d} > 0 THEN CAST(CAST(signum({n}) AS BIGINT) * "
                      f"div(abs({n}) * {mult} + {d}, {d} * 2) AS DOUBLE) / {float(10 ** digits)!r}D END")
    num, den = _c(num).cast("long"), _c(den).cast("long")
    q = idiv(F.abs(num) * F.lit(mult) + den, den * F.lit(2))
    val = (F.signum(num).cast("long") * q).cast("double") / F.lit(float(10 ** digits))
    return F.when(den > 0, val)


def pct(num, den, digits: int = 2) -> Column:
    """Share in percent, rounded: round(num * 100 / den, digits)."""
    return round_ratio(num, den, digits, scale=100)


def pct_unrounded(num, den) -> Column:
    """num * 100.0 / den as a double, NULL on a zero denominator."""
    den = _c(den)
    return F.when(den != 0, (_c(num) * F.lit(100.0)) / den)


def round_real(x, digits: int = 2) -> Column:
    """Half-away-from-zero rounding of a double by a fixed IEEE operation sequence."""
    p = float(10 ** digits)
    if isinstance(x, str):
        c = f"CAST({_q(x)} AS DOUBLE)"
        return F.expr(f"signum({c}) * CAST(floor(abs({c}) * {p!r}D + 0.5D) AS DOUBLE) / {p!r}D")
    x = _c(x)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(p) + F.lit(0.5)).cast("double") / F.lit(p)


def safe_div(num, den) -> Column:
    """num / den as a double; NULL when den is 0 or NULL (SQLite semantics, P1)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


# --------------------------------------------------------------------------- SQL twins

def sql_round_ratio(num: str, den: str, digits: int = 2, scale: int = 1) -> str:
    mult = 2 * scale * 10 ** digits
    return (f"(CASE WHEN ({den}) > 0 THEN CAST(sign({num}) * ((abs({num}) * {mult} + ({den})) "
            f"// (2 * ({den}))) AS DOUBLE) / {10 ** digits}.0 END)")


def sql_pct(num: str, den: str, digits: int = 2) -> str:
    return sql_round_ratio(num, den, digits, scale=100)


def sql_pct_unrounded(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) * 100.0 / ({den}) END)"


def sql_round_real(x: str, digits: int = 2) -> str:
    p = f"{10 ** digits}.0"
    return f"(sign({x}) * CAST(floor(abs({x}) * {p} + 0.5) AS DOUBLE) / {p})"
