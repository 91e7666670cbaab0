"""Interval placement: edge rows, properties, and the flag-then-sum rewrite vs brute force."""

import random

from pyspark.sql import functions as F

from cohortlens.functions.intervals import in_followup, in_interval, in_lookback
from cohortlens.operators.temporal import (flag_intervals, with_event_in_interval,
                                           without_event_in_interval)
from tests.util import d


def _edge_frames(spark):
    iv = spark.createDataFrame([("a", d("2024-01-10"), d("2024-03-01")), ("b", d("2024-01-01"), None)],
                               "participant_id string, start_date date, end_date date")
    ev = spark.createDataFrame([(("a" if x[0] == "a" else "b"), d(x[1])) for x in [
        ("a", "2024-01-10"), ("a", "2024-03-01"), ("a", "2024-03-02"), ("a", "2025-03-01"),
        ("a", "2025-03-02"), ("a", "2023-01-10"), ("a", "2023-01-09"), ("b", "2030-01-01"),
        ("b", "2023-12-31")]], "participant_id string, charge_date date")
    return iv, ev


def test_interval_edges(spark):
    iv, ev = _edge_frames(spark)
    j = ev.join(iv, "participant_id").select(
        "participant_id", F.col("charge_date").cast("string").alias("d"),
        in_interval("charge_date", "start_date", "end_date").alias("during"),
        in_lookback("charge_date", "start_date", 365).alias("lookback"),
        F.coalesce(in_followup("charge_date", "end_date", 365), F.lit(False)).alias("followup"))
    got = {(r.participant_id, r.d): (r.during, r.lookback, r.followup) for r in j.collect()}
    assert got[("a", "2024-01-10")] == (True, False, False)   # start day
    assert got[("a", "2024-03-01")] == (True, False, False)   # end day
    assert got[("a", "2024-03-02")] == (False, False, True)   # one day after
    assert got[("a", "2025-03-01")] == (False, False, True)   # 365 days after
    assert got[("a", "2025-03-02")] == (False, False, False)  # 366 days after
    assert got[("a", "2023-01-10")] == (False, True, False)   # 365 days before
    assert got[("a", "2023-01-09")] == (False, False, False)  # 366 days before
    assert got[("b", "2030-01-01")] == (True, False, False)   # open interval
    assert got[("b", "2023-12-31")] == (False, True, False)


def _random_frames(spark, seed):
    rnd = random.Random(seed)
    ivs, evs = [], []
    for i in range(40):
        pid = f"p{i % 25}"  # repeated ids: several intervals per subject (fan-out)
        s = 19000 + rnd.randint(0, 400)
        e = None if rnd.random() < 0.2 else s + rnd.randint(0, 300)
        ivs.append((pid, s, e, rnd.choice(["G", "T"])))
    for i in range(400):
        evs.append((f"p{rnd.randint(0, 30)}", 18800 + rnd.randint(0, 1200), rnd.random() < 0.4))
    iv = spark.createDataFrame(ivs, "participant_id string, s int, e int, grp string").select(
        "participant_id", F.date_from_unix_date("s").alias("start_date"),
        F.date_from_unix_date("e").alias("end_date"), "grp")
    ev = spark.createDataFrame(evs, "participant_id string, x int, conv boolean").select(
        "participant_id", F.date_from_unix_date("x").alias("charge_date"), "conv")
    return iv, ev


def test_semi_plus_anti_is_every_interval(spark):
    for seed in (1, 2, 3):
        iv, ev = _random_frames(spark, seed)
        a = with_event_in_interval(iv, ev).count()
        b = without_event_in_interval(iv, ev).count()
        assert a + b == iv.count()


def test_before_during_after_partition_events(spark):
    iv, ev = _random_frames(spark, 4)
    closed = iv.where(F.col("end_date").isNotNull())
    j = ev.join(closed, "participant_id")
    b = j.where(in_lookback("charge_date", "start_date")).count()
    du = j.where(in_interval("charge_date", "start_date", "end_date")).count()
    af = j.where(in_followup("charge_date", "end_date")).count()
    assert b + du + af == j.count()


def test_flag_then_sum_equals_count_distinct_case(spark):
    for seed in (5, 6, 7):
        iv, ev = _random_frames(spark, seed)
        days = ev.groupBy("participant_id", "charge_date").agg(
            F.count("*").alias("n"), F.sum(F.col("conv").cast("int")).alias("n_conv"))
        flags = flag_intervals(iv, days, ["grp", "participant_id"], "followup", 365,
                               {"any": F.col("n") > 0, "conv": F.col("n_conv") > 0})
        mine = {r.grp: (r.n, r.a, r.c) for r in flags.groupBy("grp").agg(
            F.count("*").alias("n"), F.sum("any").alias("a"), F.sum("conv").alias("c")).collect()}
        iv.createOrReplaceTempView("iv")
        ev.createOrReplaceTempView("ev")
        brute = {r.grp: (r.n, r.a, r.c) for r in spark.sql("""
            SELECT grp, COUNT(DISTINCT iv.participant_id) AS n,
                   COUNT(DISTINCT CASE WHEN ev.charge_date > iv.end_date
                        AND date_diff(ev.charge_date, iv.end_date) <= 365 THEN ev.participant_id END) AS a,
                   COUNT(DISTINCT CASE WHEN ev.conv AND ev.charge_date > iv.end_date
                        AND date_diff(ev.charge_date, iv.end_date) <= 365 THEN ev.participant_id END) AS c
            FROM iv LEFT JOIN ev ON iv.participant_id = ev.participant_id GROUP BY grp""").collect()}
        assert mine == brute


def test_existence_in_every_window_equals_all_pairs(spark):
    """NULL ids, days, starts and ends, intervals the wrong way round, equal and repeated intervals."""
    import random

    from cohortlens.functions.intervals import window_predicate

    r = random.Random(8)

    def day():
        return None if r.random() < 0.1 else d(f"20{r.randint(20, 21)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}")

    ids = ["hot"] * 3 + [f"p{i}" for i in range(40)] + [None]
    ev = spark.createDataFrame([(r.choice(ids), day()) for _ in range(60)] + [("gone", day())], "participant_id string, charge_date date")
    iv = [(r.choice(ids), day(), day(), k) for k in range(150)]
    iv = spark.createDataFrame(iv + iv[:20], "participant_id string, start_date date, end_date date, k int")
    for window, n in [("before", None), ("lookback", 60), ("during", None), ("after", None), ("followup", 60), ("lookback", -5)]:
        inside = window_predicate(window, F.col("charge_date"), F.col("start_date"), F.col("end_date"), n)
        cond = (F.col("participant_id") == F.col("i")) & inside
        for op, how in ((with_event_in_interval, "left_semi"), (without_event_in_interval, "left_anti")):
            want = iv.join(ev.withColumnRenamed("participant_id", "i"), cond, how)
            assert sorted(map(str, op(iv, ev, window, n).collect())) == sorted(map(str, want.collect())), (window, how)


def test_existence_asks_for_one_day_of_an_interval(spark):
    """One look-up an interval, by its first day, and no counts at both ends."""
    from tests.test_running import _exchanges

    found, plan = _exchanges(spark, "with_event_in_interval")
    assert len(found) <= 5 and "collect_list" not in plan, found
