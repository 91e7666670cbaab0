"""Sinks (A5-A7): replace-table write, partition replace, quoted CSV export, JSON records export.

A table is written aside and swapped in when it is complete: a write that fails leaves the old
rows where they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame


def _staged(df: DataFrame, path: str, write: Callable[[str], None]) -> str:
    """``write`` to a folder beside ``path``, then put it in the old one's place.

    The swap is two renames (the old folder aside, the new one in); if the second fails, the old folder
    is put back."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = path.rstrip("/")
    token = uuid.uuid4().hex
    new, old, final = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{base}.new-{token}", f"{base}.old-{token}", base))
    fs = final.getFileSystem(conf)
    try:
        write(new.toString())
        if fs.exists(final) and not fs.rename(final, old):
            raise OSError(f"could not move {base} aside")
        if not fs.rename(new, final):
            if fs.exists(old):
                fs.rename(old, final)
            raise OSError(f"could not publish {base}")
    finally:
        fs.delete(new, True)
    fs.delete(old, True)
    return path


def write_table(df: DataFrame, path: str, n_files: int | None = None, fmt: str = "parquet") -> str:
    """A5: replace the table at ``path``, optionally by ``n_files`` files; the old one stays if the write fails."""
    out = df.repartition(n_files) if n_files else df
    return _staged(df, path, lambda to: out.write.format(fmt).save(to))


def replace_partitions(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet") -> str:
    """A5 for a partitioned table: only the partitions (values of ``by``) that ``df`` has rows of are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path))
    return path


def export_csv(df: DataFrame, path: str) -> str:
    """CSV with a header, every field quoted, quotes doubled; replaces what was at ``path``."""
    return _staged(df, path, lambda to: (
        df.write.option("header", True).option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(to)))


def export_json(df: DataFrame, path: str) -> str:
    """JSON records, NULL fields written explicitly; replaces what was at ``path``."""
    return _staged(df, path, lambda to: df.write.option("ignoreNullFields", False).json(to))
