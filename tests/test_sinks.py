"""A6/A7 export formats, A1/A2 header handling, checked on the raw files."""

import glob

import pytest
from pyspark.sql import functions as F

from cohortlens.session import scratch_path
from cohortlens.sources import csv as csv_src
from cohortlens.sources import sinks


def _text(path):
    files = sorted(glob.glob(path.replace("file:", "") + "/part-*"))
    return "".join(open(f).read() for f in files)


def test_export_csv_quotes_every_field_and_doubles_quotes(spark):
    df = spark.createDataFrame([("a", 'say "hi"', 1), ("b", None, 2)], "k string, v string, n long")
    path = scratch_path(spark, "test-export")
    sinks.export_csv(df, path)
    lines = _text(path).splitlines()
    assert lines[0] == '"k","v","n"'
    assert '"a","say ""hi""","1"' in lines
    back = csv_src.read_csv_table(spark, path)
    assert sorted((r.k, r.v) for r in back.collect()) == [("a", 'say "hi"'), ("b", None)]


def test_export_json_keeps_null_fields(spark):
    df = spark.createDataFrame([("a", None)], "k string, v string")
    path = scratch_path(spark, "test-json")
    sinks.export_json(df, path)
    assert '"v":null' in _text(path)


def test_header_names_trimmed_and_positional_read(spark):
    path = scratch_path(spark, "test-csv")
    spark.createDataFrame([("1", "x")], "` Code ` string, `Description ` string") \
        .write.option("header", True).csv(path)
    assert csv_src.read_csv_table(spark, path).columns == ["Code", "Description"]
    pos = csv_src.read_csv_table(spark, path, header=False, names=["c", "d"])
    assert [tuple(r) for r in pos.collect()] == [("1", "x")]


def test_missing_value_tokens_read_as_null(spark):
    path = scratch_path(spark, "test-na")
    spark.createDataFrame([("N/A", "x"), ("NULL", "nan"), ("ok", "#N/A")], "a string, b string") \
        .write.option("header", True).csv(path)
    got = sorted(((r.a, r.b) for r in csv_src.read_csv_table(spark, path).collect()), key=str)
    assert got == sorted([(None, "x"), (None, None), ("ok", None)], key=str)


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_line_breaks_in_quotes_are_found_per_file(spark, tmp_path):
    three = _file(tmp_path, "a.csv", 'Notes\n"first\nsecond"\nthird\n')
    joined = _file(tmp_path, "b.csv", 'Name,Notes\nA,"x\nB,y"\nC,z\n')
    stray = _file(tmp_path, "c.csv", 'Name,Notes\n5" pipe,"open\nB"\nC,z\n')
    plain = _file(tmp_path, "d.csv", 'Name,Notes\nA, "said ""x, y"" " \nB,\n"C",5" pipe\n,\n')
    split, whole = csv_src.files_with_broken_lines(spark, [three, joined, stray, plain])
    assert [p.rsplit("/", 1)[-1] for p in split] == ["d.csv"]
    assert [p.rsplit("/", 1)[-1] for p in whole] == ["a.csv", "b.csv", "c.csv"]
    assert [tuple(r) for r in csv_src.read_csv_table(spark, three).collect()] == [("first\nsecond",), ("third",)]
    assert [tuple(r) for r in csv_src.read_csv_table(spark, joined).collect()] == [("A", "x\nB,y"), ("C", "z")]
    both = csv_src.read_csv_table(spark, [joined, plain]).collect()
    assert len(both) == 2 + 4 and ("A", "x\nB,y") in [tuple(r) for r in both]
    one, other = (sorted(map(str, csv_src.read_csv_table(spark, plain, multi_line=m).collect())) for m in (True, None))
    assert one == other


def test_a_large_file_without_broken_lines_is_read_in_parts(spark, tmp_path):
    big = _file(tmp_path, "big.csv", "k,v\n" + "".join(f'{i},"value, ""{i}"" of a row"\n' for i in range(40_000)))
    broken = _file(tmp_path, "broken.csv", "k,v\n" + "".join(f'{i},"value\n{i} of a row"\n' for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        frames = [csv_src.read_csv_table(spark, p) for p in (big, broken)]
        tasks = [df.select(F.spark_partition_id()).distinct().count() for df in frames]
        assert [df.count() for df in frames] == [40_000, 40_000]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks[0] >= 5 and tasks[1] == 1


@pytest.mark.parametrize("write", [sinks.write_table, sinks.export_csv, sinks.export_json])
def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path, write):
    path = str(tmp_path / "table")
    write(spark.range(3), path)
    before = sorted(p.name for p in (tmp_path / "table").iterdir())
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="bad row"):
        write(broken, path)
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == before
    assert [p.name for p in tmp_path.iterdir()] == ["table"]
    write(spark.range(5), path)
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_only_touched_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, ["k"])
    sinks.replace_partitions(spark.createDataFrame([(3, "b"), (4, "c")], "v int, k string"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_reports_are_published_side_by_side_and_one_failure_leaves_the_others(spark, tmp_path):
    import threading
    import time

    from cohortlens.operators.catalog import publish_reports

    running, most, lock = [0], [0], threading.Lock()

    def report(n, bad=False):
        def run(_):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.3)
            with lock:
                running[0] -= 1
            fail = F.raise_error(F.lit("no such rows")).cast("long") if bad else F.col("id")
            return spark.range(n).select(fail.alias("id"))
        return run

    reports = {"a": report(3), "b": report(4, bad=True), "c": report(5), "d": report(0)}
    log = publish_reports(spark, reports, {}, str(tmp_path / "out"), side_by_side=3)
    got = {r.report_name: (r.ok, r.row_count) for r in log.collect()}
    assert got == {"a": (True, 3), "b": (False, 0), "c": (True, 5), "d": (True, 0)}
    assert "no such rows" in {r.report_name: r.error for r in log.collect()}["b"]
    assert most[0] >= 2 and spark.read.parquet(str(tmp_path / "out" / "c")).count() == 5


def test_the_shuffle_files_of_a_report_go_when_it_is_written(spark, tmp_path):
    import os
    import time

    from cohortlens.operators.catalog import publish_reports

    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    seen, before = {}, shuffles()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def report(_):
        return spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("n"))

    def later(_):  # beside the others' last status line, which is written after them
        for _ in range(100):
            seen["left"] = shuffles() - before
            if not seen["left"]:
                break
            time.sleep(0.1)
        seen["conf"] = spark.conf.get(key)
        return spark.range(1)

    kept = spark.conf.get(key, None)
    log = publish_reports(spark, {"a": report, "b": report, "later": later}, {}, str(tmp_path / "out"), side_by_side=1)
    assert {r.report_name: r.row_count for r in log.collect()} == {"a": 1000, "b": 1000, "later": 1}
    assert not seen["left"] and seen["conf"] == "true"
    assert spark.conf.get(key, None) == kept
