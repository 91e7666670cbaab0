"""The materialised canonical store: reuse, force, content equal to the lazy bindings."""

import pytest
from pyspark.sql import functions as F

from cohortlens.session import scratch_path
from cohortlens.sources.bindings import BUILDERS, load_tables
from cohortlens.sources.store import StoredTables, materialize, store_key, write_table
from tests.conftest import SF_SMALL


def test_materialize_is_idempotent_and_equal_to_bindings(spark):
    root = scratch_path(spark, "test-store")
    a = materialize(spark, SF_SMALL, root=root)
    b = materialize(spark, SF_SMALL, root=root)
    assert a == b and a.endswith(store_key(spark, SF_SMALL))
    stored, lazy = StoredTables(spark, a, SF_SMALL), load_tables(spark, SF_SMALL)
    for name in BUILDERS:
        s, l_ = stored[name], lazy[name]
        assert s.schema.simpleString() == l_.schema.simpleString(), name
        assert s.exceptAll(l_).count() == 0 and l_.exceptAll(s).count() == 0, name


def test_force_rewrites_in_place(spark):
    root = scratch_path(spark, "test-store")
    a = materialize(spark, SF_SMALL, root=root)
    b = materialize(spark, SF_SMALL, root=root, force=True)
    assert a == b
    assert StoredTables(spark, b, SF_SMALL)["enrollment"].count() == load_tables(spark, SF_SMALL)["enrollment"].count()


def test_nested_source_files_count(spark):
    import os
    import shutil
    import tempfile

    src = tempfile.mkdtemp(prefix="cohortlens-src-")
    for f in os.listdir(SF_SMALL):
        if f != "lineitem.parquet":
            os.symlink(f"{SF_SMALL}/{f}", f"{src}/{f}")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    li.withColumn("year", F.year("l_shipdate")).write.partitionBy("year").parquet(f"{src}/lineitem.parquet")
    before = store_key(spark, src)
    li.limit(5).write.parquet(f"{src}/lineitem.parquet/year=1995/more")
    assert store_key(spark, src) != before  # a new file in a nested folder is a new input
    shutil.rmtree(src)


def test_large_tables_are_written_by_many_tasks(spark):
    path = scratch_path(spark, "test-rebalance")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_table(spark.range(200_000).coalesce(1).selectExpr("id", "uuid() AS v"), path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() > 3


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from cohortlens.session import ensure_checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_a_query_writes_the_tables_it_reads_and_no_others(spark, monkeypatch):
    import os

    from cohortlens.plans import registry
    from cohortlens.sources import store

    root = scratch_path(spark, "test-store-lazy")
    monkeypatch.setattr(store, "_root", lambda spark: root)
    monkeypatch.setattr(store, "_CACHE", {})
    folder = f"{root}/{store_key(spark, SF_SMALL)}".removeprefix("file:")
    registry.queries()["build_enrollment"](spark, SF_SMALL).count()
    assert not os.path.exists(folder)
    registry.queries()["duplicate_keys"](spark, SF_SMALL).count()
    assert os.listdir(folder) == ["participant_charge"]
    registry.queries()["r3_4"](spark, SF_SMALL).count()
    assert sorted(os.listdir(folder)) == ["enrollment", "participant", "participant_charge", "risk_assessment"]
    assert len(os.listdir(root.removeprefix("file:"))) == 1


def test_a_table_is_written_without_a_shuffle_of_its_own(spark):
    from cohortlens.sources import store

    root = scratch_path(spark, "test-store-jobs").removeprefix("file:")
    sc = spark.sparkContext
    table = load_tables(spark, SF_SMALL)["enrollment"]  # reads a schema, a job of its own
    sc.setJobGroup("store-jobs", "")
    try:
        store._write_once(spark, table, root, "enrollment")
        jobs = sc.statusTracker().getJobIdsForGroup("store-jobs")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert len(jobs) == len(stages) == 1


def test_a_run_of_many_reports_derives_a_table_once(spark):
    from cohortlens.plans import registry
    from cohortlens.sources.store import RunTables
    from tests.util import rows, tables

    days = ["2020-01-01", "2020-03-01", "2020-06-01", "2021-01-01", "2021-02-01", None]
    charges = [(p, k, days[(3 * k + n) % 6], None, ["Convicted", "Dismissed", None][(k + n) % 3])
               for n, p in enumerate(["1", "2", "2", "3", None]) for k in range(4)]
    stays = [(p, days[a], days[b], s, 1.0) for p, a, b, s in [
        ("1", 1, 3, "Graduated"), ("1", 0, 5, None), ("2", 2, 2, "Terminated"), ("2", 3, 1, "Discharged"), ("3", 5, 4, "Graduated"),
        ("4", 0, 1, "Terminated"), (None, 0, 1, "Graduated"), ("3", 0, 1, "Terminated"), ("2", 1, 2, "Graduated")]]
    people = [(p, None, None, None, g, None) for p, g in [("1", "F"), ("2", "M"), ("3", None), ("4", "M")]]
    t = tables(spark, participant=people, enrollment=stays, participant_charge=charges)
    run, built = RunTables(spark, t), []
    write = run.once
    run.once = lambda name, build: write(name, lambda: (built.append(name), build())[1])
    for name in ["r3_2", "r4_4", "r4_6", "r4_9", "r5_6", "r5_9", "r3_2"]:
        report = registry.reports()[name]
        assert rows(report(run)) == rows(report(t)), name
    assert sorted(built) == ["charge_days", "charge_windows"]


def test_a_run_of_many_reports_joins_charges_to_their_offenses_once(spark):
    from cohortlens.plans import registry
    from cohortlens.sources.store import RunTables
    from tests.util import rows, tables

    days = ["2020-01-01", "2020-03-01", "2020-06-01", "2021-01-01", None]
    charges = [(p, [1, 2, 3, 9, None][(k + n) % 5], days[(3 * k + n) % 5], None, ["Convicted", "Dismissed", "Convicted", None][(2 * k + n) % 4])
               for n, p in enumerate(["1", "2", "3", "4", "5", "6", "6", None]) for k in range(10)]
    offenses = [(1, "Theft", "F"), (2, "Theft", "F"), (2, "Fraud", None), (3, None, "M"), (None, "Arson", "F")]  # 2 twice, 9 lacks
    stays = [(p, "2020-07-01", end, s, 1.0) for p, end, s in [
        ("1", None, "Graduated"), ("2", "2021-03-01", "Terminated"), ("3", "2020-02-01", "Graduated"), ("4", "2021-01-01", None),
        ("5", "2022-01-01", "Graduated"), ("6", "2021-01-01", "Terminated"), ("6", "2021-01-01", "Terminated"), (None, None, "Graduated")]]
    people = [(p, None, None, None, "F", None) for p in ["1", "2", "3", "4", "5", "6", "6"]]
    t = tables(spark, participant=people, enrollment=stays, participant_charge=charges, charge_offense=offenses)
    run, built = RunTables(spark, t), []
    write = run.once
    run.once = lambda name, build: write(name, lambda: (built.append(name), build())[1])
    for name in ["r1_4", "r1_5", "r3_5", "r4_5", "r5_2", "x3"]:
        report = registry.reports()[name]
        found = rows(report(run))
        assert found and found == rows(report(t)), name
    assert sorted(built) == ["classed_charges", "felony_windows", "prior_classes"]


def test_participants_are_dealt_only_for_the_offenses_that_are_shown(spark):
    from cohortlens.plans.section1 import top_offenses
    from tests.util import tables

    n = 40
    charges = [(f"p{k % 7}", i, "2020-01-01", None, "Convicted") for i in range(n) for k in range(i + 1)]
    t = tables(spark, participant_charge=charges, charge_offense=[(i, f"o{i}", "F") for i in range(n)])
    df = top_offenses(t)
    assert [tuple(r) for r in df.collect()] == [(f"o{i}", "F", i + 1, min(7, i + 1)) for i in range(n - 1, n - 16, -1)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 15" in plan and plan.index("participant_id") < plan.index("GlobalLimit 15")


def test_duplicate_keys_are_dealt_before_they_are_counted(spark):
    from cohortlens.operators.quality import duplicate_keys

    rows = [("a", 1), ("a", 1), (None, 1), (None, 1), (None, None), ("b", None), ("b", None), ("b", None), ("c", 1), ("c", 2)]
    df = spark.createDataFrame(rows, "k string, v int")
    for part_rows in (3, 100):
        dup = duplicate_keys(df, ["k", "v"], part_rows)
        assert sorted(map(str, map(tuple, dup.collect()))) == sorted(map(str, [("a", 1, 2), (None, 1, 2), ("b", None, 3)]))
    assert duplicate_keys(df, ["k", "v"], 3).select(F.spark_partition_id()).distinct().count() > 1
    plan = duplicate_keys(df, ["k", "v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")  # no counts below the shuffle
    assert duplicate_keys(df.limit(0), ["k", "v"]).count() == 0
