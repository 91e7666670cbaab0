"""Catalog jobs (A8-A11): previews, table inventory, column profiles, report publishing."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_end_with_their_query


def preview(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows under an explicit order (LIMIT is only deterministic so)."""
    return df.orderBy(*order).limit(n)


def table_inventory(tables: dict[str, DataFrame], first_columns: int = 3,
                    with_total: bool = True) -> DataFrame:
    """Table name, row count and first column names; optional TOTAL row."""
    parts = [df.agg(F.count("*").alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count",
                     F.lit(len(df.columns)).cast("long").alias("column_count"),
                     F.lit(", ".join(df.columns[:first_columns])).alias("first_columns"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if with_total:
        tot = out.agg(F.sum("row_count").alias("row_count"), F.sum("column_count").alias("column_count"))
        out = out.unionByName(tot.select(F.lit("TOTAL").alias("table_name"), "row_count", "column_count",
                                         F.lit(None).cast("string").alias("first_columns")))
    return out


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """A10: per column: table, position, name, type, nullable and non-NULL count
    (one aggregate pass per table, stacked to rows)."""
    parts = []
    for name, df in tables.items():
        fields = df.schema.fields
        row = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_c{i}") for i, f in enumerate(fields)])
        structs = [F.struct(F.lit(name).alias("table_name"), F.lit(i).alias("position"),
                            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                            F.lit(f.nullable).alias("nullable"), F.col(f"_c{i}").alias("non_null_count"))
                   for i, f in enumerate(fields)]
        parts.append(row.select(F.inline(F.array(*structs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def publish_reports(spark: SparkSession, reports: dict[str, Callable], tables, out_dir: str,
                    names: Sequence[str] | None = None, side_by_side: int = 4) -> DataFrame:
    """Write every report under ``out_dir/<name>`` and a run-log table
    (name, ok, rows, seconds, error) at ``out_dir/_run_log``; returns the run log.

    ``side_by_side`` reports run at once, each as a job group in a scheduler pool of its own (fair where the
    cluster's scheduler is); when one fails, what is left of its group is cancelled and the others go on.
    Rows are counted while they are written; only a report's status line comes back to the driver.  A report's shuffle
    files go when it is written, so the disk holds those of the reports that run, not of the whole run.
    """
    sc = spark.sparkContext
    run = uuid.uuid4().hex[:8]
    every = list(names or reports)

    def publish(name: str) -> tuple:
        group = f"publish-{run}-{name}"
        t0 = time.perf_counter()
        sc.setJobGroup(group, f"report {name}", interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", group)
        try:
            written = Observation(f"{run}-{name}")
            rows = reports[name](tables).observe(written, F.count(F.lit(1)).alias("n"))
            rows.write.mode("overwrite").parquet(f"{out_dir}/{name}")
            return name, True, int(written.get["n"]), round(time.perf_counter() - t0, 4), None
        except Exception as ex:  # noqa: BLE001 - recorded in the run log
            sc.cancelJobGroup(group)
            return name, False, 0, round(time.perf_counter() - t0, 4), str(ex)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    tasks = iter(every)
    lock, log = threading.Lock(), {}

    def worker() -> None:
        while True:
            with lock:
                name = next(tasks, None)
            if name is None:
                return
            log[name] = publish(name)

    # threads that carry the session's properties over to their JVM threads
    threads = [InheritableThread(target=worker, session=spark) for _ in range(max(1, min(side_by_side, len(every))))]
    with shuffles_end_with_their_query(spark):
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    schema = "report_name string, ok boolean, row_count long, seconds double, error string"
    run_log = spark.createDataFrame([log[n] for n in every], schema)
    run_log.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/_run_log")
    return spark.read.parquet(f"{out_dir}/_run_log")
