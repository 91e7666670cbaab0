"""Running counts over the calendar against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.intervals import window_predicate
from cohortlens.operators import ingest
from cohortlens.operators.running import count_in_interval, event_days, held_intervals, running_sums, windowed_sums
from tests.util import d

WINDOWS = [("before", None), ("lookback", 40), ("during", None), ("after", None), ("followup", 40)]


def _frames(spark, seed=3):
    r = random.Random(seed)

    def day():
        return None if r.random() < 0.1 else d(f"20{r.randint(20, 22)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}")

    def who():
        return r.choice(["hot"] * 4 + [f"p{i}" for i in range(9)] + [None])

    ev = spark.createDataFrame([(who(), day(), r.randint(0, 3)) for _ in range(700)], "id string, day date, v int")
    iv = spark.createDataFrame([(f"q{i}" if i < 3 else who(), day(), day(), r.randint(0, 2), "x") for i in range(260)],
                               "id string, s date, e date, w int, n string")
    return ev, iv.unionByName(iv.limit(20))


def test_windowed_sums_equal_all_pairs(spark):
    ev, iv = _frames(spark)
    days = event_days(ev, "id", "day", {"n": F.lit(1), "v": F.col("v")})
    sums = {f"{w}_{m}_{k}": (w, n, m, c) for w, n in WINDOWS for m in ("n", "v") for k, c in (("all", F.lit(1)), ("w", F.col("w")))}
    got = {r.id: r.asDict() for r in windowed_sums(iv, days, sums, "id", "s", "e").collect()}
    pairs = ev.withColumnRenamed("id", "i").join(iv, F.col("i") == F.col("id"))
    exprs = [F.sum(F.when(window_predicate(w, F.col("day"), F.col("s"), F.col("e"), n), (F.lit(1) if m == "n" else F.col("v")) * c)
                   .otherwise(0)).alias(f"{w}_{m}_{k}")
             for w, n in WINDOWS for m in ("n", "v") for k, c in (("all", F.lit(1)), ("w", F.col("w")))]
    for row in pairs.groupBy("id").agg(*exprs).collect():
        want = row.asDict()
        assert {k: got[row.id][k] or 0 for k in want if k != "id"} == {k: want[k] or 0 for k in want if k != "id"}
    assert all(not any(v for k, v in got[q].items() if k != "id") for q in ("q0", "q1", "q2") if q in got)


@pytest.mark.parametrize(("window", "n"), WINDOWS)
def test_count_in_interval_equals_all_pairs(spark, window, n):
    ev, iv = _frames(spark, 5)
    days = event_days(ev, "id", "day", {"n": F.lit(1)})
    got = count_in_interval(iv, days, window, n, id_col="id", start_col="s", end_col="e")
    inside = window_predicate(window, F.col("day"), F.col("s"), F.col("e"), n)
    want = (iv.select("id", "s", "e").distinct().join(ev.withColumnRenamed("id", "i"), (F.col("id") == F.col("i")) & inside, "left")
            .groupBy("id", "s", "e").agg(F.count("i").alias("_n")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_sums_of_empty_and_early_points(spark):
    rows = spark.createDataFrame([("a", 10, 2), ("a", 75, 5), (None, 3, 1), ("a", None, 9)], "id string, at int, n long")
    points = spark.createDataFrame([("a", 9), ("a", 10), ("a", 74), ("a", 75), ("a", 1000), ("b", 5), (None, 4), ("a", None)], "id string, at int")
    got = {(r.id, r["at"]): r.n for r in running_sums(rows, points, ["id"], "at", ["n"]).collect()}
    assert got == {("a", 9): 0, ("a", 10): 2, ("a", 74): 2, ("a", 75): 7, ("a", 1000): 7, ("b", 5): 0, (None, 4): 1}
    assert running_sums(rows.limit(0), points.limit(0), ["id"], "at", ["n"]).count() == 0


@pytest.mark.parametrize("build", [ingest.build_risk, ingest.build_jail, ingest.build_psychosocial, ingest.build_treatment])
def test_a_header_without_a_name_column_is_named_in_the_error(spark, build):
    raw = spark.createDataFrame([("1", "2", "f")], "weight string, colour string, source_file string")
    with pytest.raises(ValueError, match=re.escape("lacks a name column: ['weight', 'colour', 'source_file']")):
        build(raw)


AT_SCALE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def _exchanges(spark, name):
    from cohortlens.plans.registry import reports
    from tests.util import tables

    t = tables(spark)
    t["participant_charge"] = t["participant_charge"].repartition(3)
    old = {k: spark.conf.get(k, None) for k in AT_SCALE}
    try:
        for k, v in AT_SCALE.items():
            spark.conf.set(k, v)
        plan = reports()[name](t)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return re.findall(r"Exchange (?:hash|range)partitioning\(([^\n]*?), \d+\)", plan), plan


def test_counts_in_intervals_move_events_twice(spark):
    """By (id, day) where they are reduced and meet the points, and by id where they are summed; no lists are gathered."""
    found, plan = _exchanges(spark, "in_interval")
    assert len(found) <= 4 and "collect_list" not in plan, found


def test_held_intervals_equal_all_pairs(spark):
    ev, iv = _frames(spark, 7)
    days = event_days(ev, "id", "day", {"n": F.lit(1)})
    got = held_intervals(iv, days, "id", "s", "e")
    inside = window_predicate("during", F.col("day"), F.col("s"), F.col("e"), None)
    each = (iv.where("id is not null").select("id", "s", "e").distinct()
            .join(ev.withColumnRenamed("id", "i"), (F.col("id") == F.col("i")) & inside, "left")
            .groupBy("id", "s", "e").agg(F.when(F.count("i") > 0, 1).otherwise(0).alias("hit")))
    want = each.groupBy("id").agg(F.max("hit").alias("any_hit"), F.min("hit").alias("all_hit"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
