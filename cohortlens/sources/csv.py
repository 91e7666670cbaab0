"""CSV sources (A1, A2, A4): header handling, positional columns, multi-file tagging.

Everything is read as strings (no ``inferSchema``: one pass, and typing belongs to the
cleaning jobs); header names are trimmed; blanks after a delimiter are skipped.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: tokens a pandas CSV read treats as missing by default ----
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _null_tokens(df: DataFrame, tokens) -> DataFrame:
    """Missing-value tokens -> NULL in every (string) column, one projection."""
    if not tokens:
        return df
    return df.select(*[F.when(F.col(f"`{c}`").isin(list(tokens)), F.lit(None).cast("string"))
                       .otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


#: One line that holds whole records only: fields without quotes, or in closed quotes.
_WHOLE_FIELD = r'(?:[ \t]*+"(?:[^"]|"")*+"[ \t]*+|[ \t]*+(?:[^", \t][^,]*+)?)'
WHOLE_LINE = f"^{_WHOLE_FIELD}(?:,{_WHOLE_FIELD})*+$"


def files_with_broken_lines(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """(files whose every line is a whole record, files with a line that opens or goes on with a quoted field).

    A splittable pass over the lines: while none leaves a quote open, every line break ends a record, so the
    files of the first list read alike in parts and whole.  Only file names come to the driver."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (~F.col("value").rlike(WHOLE_LINE)).alias("broken"))
    found = lines.groupBy("file").agg(F.max("broken").alias("broken")).collect()
    return sorted(r.file for r in found if not r.broken), sorted(r.file for r in found if r.broken)


def read_csv_table(spark: SparkSession, path: str | Sequence[str], header: bool = True,
                   names: Sequence[str] | None = None, na_tokens: Sequence[str] | None = NA_TOKENS,
                   multi_line: bool | None = None, mode: str = "FAILFAST") -> DataFrame:
    """A1/A2: read CSV as strings (RFC 4180 quoting, blanks after a delimiter skipped).

    header=True: the first line names the columns (names trimmed).
    header=False: the first record is dropped and columns are taken by position, renamed to
    ``names`` (one per column, or an error) or ``_c<i>``.
    Values equal to one of ``na_tokens`` (default: pandas' missing-value tokens) are NULL.
    ``multi_line``: quoted fields may hold line breaks, and a file is read by one task.  By default
    this is found out per file (``files_with_broken_lines``): files without such fields are read in parts.
    A record that does not fit the header is an error in the default ``mode``; PERMISSIVE pads it.
    """
    def reader(whole: bool):
        return (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
                .option("quote", '"').option("escape", '"').option("multiLine", whole)
                .option("inferSchema", False).option("mode", mode))

    split, whole = files_with_broken_lines(spark, path) if multi_line is None else ([], [])
    if split and whole:
        schema = reader(True).csv(path).schema
        df = reader(False).schema(schema).csv(split).unionAll(reader(True).schema(schema).csv(whole))
    else:
        df = reader(bool(whole) if multi_line is None else multi_line).csv(path)
    if header:
        return _null_tokens(df.toDF(*[c.strip() for c in df.columns]), na_tokens)
    if names and len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return _null_tokens(df.toDF(*(names or [f"_c{i}" for i in range(len(df.columns))])), na_tokens)


def list_extracts(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """(files and folders that the paths and globs name, those of them that name nothing)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = [], []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hits = [st.getPath().toString() for st in hp.getFileSystem(conf).globStatus(hp) or []]
        found += [h for h in hits if h not in found]
        if not hits:
            missing.append(p)
    return found, missing


def read_extracts(spark: SparkSession, paths: Sequence[str], file_col: str = "source_file",
                  **options) -> Iterator[DataFrame]:
    """One frame per extract, under its own header, tagged with the extract's own name (the last
    part of its path).  Paths that name nothing are skipped with a warning."""
    found, missing = list_extracts(spark, paths)
    if not found:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    if missing:
        warnings.warn(f"skipped, not found: {missing}", stacklevel=2)
    for path in found:
        yield read_csv_table(spark, path, **options).withColumn(file_col, F.lit(path.rstrip("/").rsplit("/", 1)[-1]))


def union_tagged(spark: SparkSession, paths: Sequence[str], file_col: str = "source_file", **options) -> DataFrame:
    """A4: several extracts as one frame, aligned by column name (missing columns NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read_extracts(spark, paths, file_col, **options))
