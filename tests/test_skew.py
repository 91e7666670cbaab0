"""Hot keys: one participant holding a third of all charges and a third of all enrolments.

With at-scale settings (no auto-broadcast, small skew thresholds standing in for the 256 MB
default): reports that place charges against enrolments look running counts up by (id, day), so the
hot participant is spread over tasks, and equal their SQL twins on the same rows; the one operator that
returns the pairs themselves is split by AQE.
"""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import registry
from cohortlens.plans.registry import reports
from cohortlens.sources.bindings import report_body
from tests.util import table, tables

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


def _skewed_cohort(spark):
    rnd = random.Random(11)
    enrollment, charges = [], []
    for i in range(60):
        pid = "hot" if i == 0 else f"p{i}"
        status = "Graduated" if i % 2 == 0 else "Terminated"
        enrollment.append((pid, "2020-01-01", "2020-12-31", status, 365.0))
    for k in range(30):  # the hot participant: a third of all enrolments, some equal, some open, some turned round
        start, end = f"20{19 + k % 4}-{1 + k % 12:02d}-05", [None, f"20{20 + k % 4}-{1 + k % 9:02d}-20", "2018-01-01"][k % 3]
        enrollment += [("hot", start, end, ["Graduated", "Terminated", "Discharged"][k % 3 if k % 2 else 0], 100.0)] * (1 + k % 2)
    n_cold = 6000
    for _ in range(n_cold):
        pid = f"p{rnd.randint(1, 59)}"
        charges.append((pid, 1, f"2021-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", "O",
                        "Convicted" if rnd.random() < 0.3 else "Dismissed"))
    for _ in range(n_cold // 2):  # the hot participant: a third of all rows
        charges.append(("hot", 1, f"20{rnd.randint(19, 22)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}",
                        "O", "Convicted" if rnd.random() < 0.3 else "Dismissed"))
    return enrollment, charges


def _with_conf(spark, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return old


def _restore(spark, old):
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _cohort(spark):
    enrollment, charges = _skewed_cohort(spark)
    ids = dict.fromkeys(e[0] for e in enrollment)
    people = [(i, "F", "L", "1980-01-01", "Female" if k % 2 else "Male", "White") for k, i in enumerate(ids)]
    t = tables(spark, enrollment=enrollment, participant=people, charge_offense=[(1, "Theft", "F")])
    # spread the facts over several input partitions, as a real scan would
    t["participant_charge"] = table(spark, "participant_charge", charges).repartition(6)
    return t


def _oracle(t, name):
    import duckdb

    con = duckdb.connect()
    for k, v in t.items():
        con.register(k, v.toArrow())
    res = con.execute(report_body(registry.oracle_sql()[name]))
    cols = [c[0] for c in res.description]
    return sorted(str(sorted(zip(cols, r, strict=True))) for r in res.fetchall())


def test_pairs_of_a_hot_participant_are_split_by_aqe(spark):
    t = _cohort(spark)
    old = _with_conf(spark, SKEW_CONF)
    try:
        df = reports()["events_in_window"](t)
        got = sorted(str(sorted(r.asDict().items())) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        _restore(spark, old)
    assert got == _oracle(t, "events_in_window")
    assert "isSkewJoin=true" in plan or "skew=true" in plan, plan[:3000]


LOOKED_UP = ["r3_2", "r3_5", "r4_4", "r4_5", "r4_6", "r4_9", "r5_6", "r5_9", "in_interval", "in_lookback", "in_followup",
             "with_event_in_interval", "without_event_in_interval"]


@pytest.mark.parametrize("name", LOOKED_UP)
def test_charges_and_enrolments_meet_by_day_not_by_participant(spark, name):
    """Every join that a charge or an enrolment takes part in has the day or the interval
    in its key; joins on the id alone only see rows reduced to one per id (and enrolment start)."""
    t = _cohort(spark)
    old = _with_conf(spark, SKEW_CONF)
    try:
        df = reports()[name](t)
        got = sorted(str(sorted(r.asDict().items())) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        _restore(spark, old)
    assert got == _oracle(t, name)
    if name != "r4_6":  # all of r4_6 is in a scalar subquery, printed after the plan
        plan = plan.split("== Initial Plan ==")[0]
    joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin)(?:\(skew=true\))? \[([^\]]*)\]", plan)
    by_day = [j for j in joins if "_at" in j or "_p" in j or "start_date" in j]
    alone = [j for j in joins if re.fullmatch(r"participant_id#\d+", j.strip())]
    assert by_day
    assert len(alone) <= {"r3_5": 1, "r4_9": 1, "r5_6": 2, "r5_9": 1}.get(name, 0), joins


def test_a_hot_participant_is_gathered_by_month_and_joined_by_day(spark):
    from cohortlens.operators.running import event_days, running_sums

    t = _cohort(spark)
    old = _with_conf(spark, SKEW_CONF)
    try:
        days = event_days(t["participant_charge"], "participant_id", "charge_date", {"n": F.lit(1)})
        asked = t["enrollment"].select("participant_id", F.unix_date("start_date").alias("_at")).distinct()
        both = days.select("participant_id", "_at").unionByName(asked).where("participant_id = 'hot'")
        months = both.groupBy("participant_id", F.floor(F.col("_at") / 31)).count().withColumn("task", F.spark_partition_id()).collect()
        biggest, tasks = max(r["count"] for r in months), len({r.task for r in months})
        found = asked.join(running_sums(days, asked, ["participant_id"], "_at", ["n"]), ["participant_id", "_at"])
        joined = found.where("participant_id = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        _restore(spark, old)
    assert biggest <= 31 + 31 and tasks >= 5 and joined >= 5  # tasks of 8


def test_first_row_per_key_with_hot_key_is_a_partial_aggregate(spark):
    from cohortlens.operators.ingest import first_per_key
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("k"),
        F.col("id").alias("_row"), (F.col("id") * 2).alias("v"))
    out = first_per_key(df, ["k"], "_row")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan or "partial_" in plan
    assert "Window" not in plan
    got = {r.k: (r._row, r.v) for r in out.collect()}
    assert got["hot"] == (0, 0) and len(got) == 998
