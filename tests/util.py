"""Helpers to build canonical tables from hand-made rows."""

import datetime as dt

from cohortlens.schema import SCHEMAS


def d(s):
    return None if s is None else dt.date.fromisoformat(s)


def table(spark, name, rows):
    """rows: list of tuples in SCHEMAS[name] column order (dates as ISO text)."""
    schema = SCHEMAS[name]
    fixed = []
    for r in rows:
        fixed.append(tuple(d(v) if f.dataType.simpleString() == "date" and isinstance(v, str) else v
                           for v, f in zip(r, schema.fields)))
    return spark.createDataFrame(fixed, schema)


def tables(spark, **kw):
    out = {name: table(spark, name, []) for name in SCHEMAS}
    for name, rows in kw.items():
        out[name] = table(spark, name, rows)
    return out


def rows(df, order=None):
    cols = df.columns
    res = [tuple(r) for r in df.collect()]
    return sorted(res, key=lambda r: tuple((x is None, str(x)) for x in r)) if order is None else res
