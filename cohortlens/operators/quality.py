"""Data-quality jobs (Q1-Q4): the warehouse constraints, checked instead of enforced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import metric_rows, with_total


def coverage(participant: DataFrame, children: dict[str, DataFrame], key: str = "participant_id",
             digits: int = 2) -> DataFrame:
    """Q1: per child table, how many distinct participants appear in it (semi join) and
    their share of all participants."""
    from ..functions.numeric import pct
    ids = participant.select(key).where(F.col(key).isNotNull()).distinct()
    seen = None
    for name, child in children.items():
        # distinct (table, key) first: a hot key is collapsed map-side
        part = child.select(F.lit(name).alias("table_name"), key).distinct()
        seen = part if seen is None else seen.unionByName(part)
    counts = seen.join(ids, key).groupBy("table_name").agg(F.count("*").alias("_n"))
    names = participant.sparkSession.createDataFrame([(n,) for n in children], "table_name string")
    counts = names.join(counts, "table_name", "left").fillna(0, ["_n"])
    return (with_total(counts, ids.agg(F.count("*").alias("_all")))
            .select("table_name", F.col("_n").alias("participants_present"),
                    F.col("_all").alias("participants_total"), pct("_n", "_all", digits).alias("coverage_pct")))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Q2: child rows whose (non-NULL) key has no parent row (left anti join)."""
    pk = parent_key or key
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_pk"), "left_anti")


def orphan_counts(tables, keys: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Q2 for many (child, child key, parent, parent key) at once: rows per child without a
    parent, from one join of the children's key counts with the parents' keys."""
    counts = parents = None
    for child, ck, parent, pk in keys:
        part = (tables[child].where(F.col(ck).isNotNull()).groupBy(F.col(ck).cast("string").alias("k"))
                .agg(F.count("*").alias("n"))
                .select(F.lit(child).alias("child_table"), F.lit(ck).alias("child_key"), F.lit(parent).alias("parent_table"), "k", "n"))
        counts = part if counts is None else counts.unionByName(part)
    for parent, pk in dict.fromkeys((p, k) for _, _, p, k in keys):
        part = tables[parent].select(F.lit(parent).alias("parent_table"), F.col(pk).cast("string").alias("k")).distinct()
        parents = part if parents is None else parents.unionByName(part)
    lost = (counts.join(parents, ["parent_table", "k"], "left_anti")
            .groupBy("child_table", "child_key", "parent_table").agg(F.sum("n").alias("orphan_rows")))
    every = counts.sparkSession.createDataFrame([x[:3] for x in keys], "child_table string, child_key string, parent_table string")
    return every.join(lost, ["child_table", "child_key", "parent_table"], "left").fillna(0, ["orphan_rows"])


def duplicate_keys(df: DataFrame, keys: Sequence[str], part_rows: int = 250_000) -> DataFrame:
    """Q3: key values occurring more than once, with their count.

    Most keys occur once, so counts before the shuffle save nothing and overflow a task's memory: rows are dealt by
    key first, into as many parts as keep the counts of one in memory.  Rows of one key are counted as they come."""
    parts = -(-df.count() // part_rows) or 1
    dealt = df.select(*keys).repartition(parts, *keys)
    return dealt.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def null_violations(df: DataFrame, cols: Sequence[str], table: str = "") -> DataFrame:
    """Q4: NULL count per required column, one aggregate pass, stacked to rows."""
    row = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"_n{i}")
                   for i, c in enumerate(cols)], F.count("*").alias("_rows"))
    return metric_rows(row, [{"table_name": table, "column_name": c, "null_count": F.col(f"_n{i}"),
                              "row_count": F.col("_rows")} for i, c in enumerate(cols)],
                       {"table_name": "string", "column_name": "string", "null_count": "long",
                        "row_count": "long"})
