"""Column-level cleaning for raw case-management extracts.

All functions are native Column expressions (no Python UDF).  Deliberate deviations from
the pandas loader being modelled (documented in the README):

* P12 — missing text is NULL, never the literal ``'nan'``.
* P16 — a person key built from NULL name parts is NULL (not ``'nan-nan'``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c

# ---- fixed values: default date formats tried in order (month first) ----
DATE_FORMATS = ["M/d/yyyy", "yyyy-MM-dd", "M-d-yyyy", "yyyy/MM/dd", "MMM d, yyyy", "d-MMM-yyyy"]
# formats with a two-digit year (months first), read by the pivot below
SHORT_YEAR_FORMATS = ["M/d/yy", "M-d-yy"]
#: What every text that a format parses looks like.  A parser that is given anything else throws and catches an
#: exception, which costs far more than the pattern.
DATE_SHAPES = {
    "M/d/yyyy": r"^[+-]?\d+/[+-]?\d+/[+-]?\d{4,}$", "M-d-yyyy": r"^[+-]?\d+-[+-]?\d+-[+-]?\d{4,}$",
    "yyyy-MM-dd": r"^[+-]?\d{4,}-\d\d-\d\d$", "yyyy/MM/dd": r"^[+-]?\d{4,}/\d\d/\d\d$",
    "MMM d, yyyy": r"^[^ ]+ [+-]?\d+, [+-]?\d{4,}$", "d-MMM-yyyy": r"^[+-]?\d+-[^-]+-[+-]?\d{4,}$",
    "M/d/yy": r"^[+-]?\d+/[+-]?\d+/\d\d$", "M-d-yy": r"^[+-]?\d+-[+-]?\d+-\d\d$",
}
PIVOT = 69  # two-digit years from here on are 19xx, as in C's strptime
TIME_PART = r"[T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# ---- fixed values: the characters Python's str.strip() treats as whitespace ----
WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_ws(col) -> Column:
    """Remove leading/trailing whitespace as Python's ``str.strip()`` does (any kind)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def person_key(col) -> Column:
    """B1: lower case, drop spaces, ',' -> '-', drop '.' and '/'; NULL stays NULL."""
    return strip_ws(F.translate(F.lower(_c(col)), ", ./", "-"))


def person_key_from_parts(last, first) -> Column:
    """B2: key of 'Last, First' built from two columns; a NULL part gives NULL."""
    return person_key(F.concat(strip_ws(last), F.lit(", "), strip_ws(first)))


def split_name(col) -> tuple[Column, Column]:
    """B3: 'Last, First' -> (last, first), both trimmed; missing part -> NULL."""
    parts = F.split(_c(col), ", ")
    return strip_ws(F.get(parts, 0)), strip_ws(F.get(parts, 1))


def parse_date(col, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Lenient date parse: a time part is dropped, the first format that parses wins, two-digit
    years turn at ``PIVOT``; unparsable -> NULL."""
    def read(s: Column, fmt: str) -> Column:
        shape = DATE_SHAPES.get(fmt)
        return F.when(s.rlike(shape), F.try_to_date(s, fmt)) if shape else F.try_to_date(s, fmt)

    def parsed(s: Column) -> Column:
        full = [read(s, f) for f in formats]
        short = [read(s, f) for f in SHORT_YEAR_FORMATS]  # Spark reads yy as 20yy
        turned = [F.when(F.year(d) >= 2000 + PIVOT, F.add_months(d, -1200)).otherwise(d) for d in short]
        return F.coalesce(*full, *turned)

    # an array of one, so that the trimmed text is worked out once for all formats
    bare = F.array(F.regexp_replace(strip_ws(col), TIME_PART, ""))
    return F.get(F.transform(bare, parsed), F.lit(0))


def rejected(df, columns: dict[str, Column]):
    """Rows of text per column that are not blank but came out NULL of their parse (B4, B5):
    ``columns`` maps a source column to its parsed expression."""
    counts = [F.sum(F.when(clean_text(F.col(f"`{c}`")).isNotNull() & x.isNull(), 1).otherwise(0)).cast("long").alias(c)
              for c, x in columns.items()]
    return df.agg(*counts)


def parse_number(col) -> Column:
    """Lenient numeric parse to double; unparsable (also Java's ``12d``) -> NULL."""
    s = strip_ws(col)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def clean_text(col, upper: bool = False) -> Column:
    """Trim (optionally upper-case); blank and the token 'nan' become NULL."""
    s = strip_ws(col)
    if upper:
        s = F.upper(s)
    return F.when((s != "") & (F.lower(s) != "nan"), s)


def replace_token(col, old: str, new: str) -> Column:
    """Literal token replacement, then trim."""
    return strip_ws(F.replace(_c(col), F.lit(old), F.lit(new)))


def collapse_flags(flags: dict[str, Column | str], multi: str = "Multi-Racial") -> Column:
    """One-hot flags (value 1.0) -> the single label, ``multi`` for several, NULL for none."""
    labels = F.filter(F.array(*[F.when(parse_number(c) == 1.0, F.lit(label))
                                for label, c in flags.items()]), lambda x: x.isNotNull())
    return F.when(F.size(labels) == 1, F.get(labels, 0)).when(F.size(labels) > 1, F.lit(multi))


class Header:
    """A3: finds columns of one file by keywords in their upper-cased names.

    ``named`` matches whole names, ``holding`` any part; of several matches the first column of
    the file wins.  Works on the header alone, so each file of a set has its own."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self._upper = [c.upper() for c in self.columns]

    def named(self, *names: str) -> str | None:
        places = [self._upper.index(n.upper()) for n in names if n.upper() in self._upper]
        return self.columns[min(places)] if places else None

    def holding(self, *keywords: str, without: str | None = None) -> str | None:
        wanted = re.compile("|".join(map(re.escape, keywords)), re.IGNORECASE)
        hits = (c for c, u in zip(self.columns, self._upper, strict=True)
                if wanted.search(u) and not (without and without in u))
        return next(hits, None)
