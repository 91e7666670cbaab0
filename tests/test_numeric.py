"""Division by zero, float literals and rounding agree between Spark and the oracle."""

import random

import duckdb
from pyspark.sql import functions as F

from cohortlens.functions.numeric import (pct, pct_unrounded, round_ratio, round_real, sql_pct,
                                          sql_pct_unrounded, sql_round_ratio, sql_round_real)


def test_p1_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (None, 3)], "n long, m long")
    out = df.select(pct("n", "m").alias("p"), round_ratio("n", "m", 2).alias("r"),
                    pct_unrounded("n", "m").alias("u")).collect()
    assert [tuple(r) for r in out] == [(None, None, None), (None, None, None), (None, None, None)]


def test_p3_exact_half_up_on_count_ratios(spark):
    # 201 of 20000 is exactly 1.005 %: exact rounding gives 1.01 (binary rounding would give 1.0)
    df = spark.createDataFrame([(201, 20000), (1, 8), (2, 3), (1, 3)], "n long, m long")
    got = [r[0] for r in df.select(pct("n", "m")).collect()]
    assert got == [1.01, 12.5, 66.67, 33.33]
    assert duckdb.sql(f"SELECT {sql_pct('201', '20000')}").fetchall()[0][0] == 1.01


def test_p2_percentages_are_double(spark):
    df = spark.createDataFrame([(1, 3)], "n long, m long").select(pct_unrounded("n", "m").alias("u"))
    assert df.schema["u"].dataType.simpleString() == "double"


def test_spark_and_sql_twins_agree_on_a_grid(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randint(-500, 5000), rnd.randint(0, 3000)) for _ in range(3000)] + [(201, 20000), (7, 0)]
    reals = [rnd.uniform(-1000, 1000) for _ in range(2000)] + [1.005, 2.675, -0.125, 0.0]
    df = spark.createDataFrame(pairs, "n long, m long")
    s = {(r[0], r[1]): (r[2], r[3], r[4]) for r in df.select(
        "n", "m", pct("n", "m").alias("p"), round_ratio("n", "m", 1).alias("r"),
        pct_unrounded("n", "m").alias("u")).collect()}
    # the Column-composed path equals the single-expression path
    s_cols = {(r[0], r[1]): (r[2], r[3], r[4]) for r in df.select(
        "n", "m", pct(F.col("n"), F.col("m")).alias("p"), round_ratio(F.col("n"), F.col("m"), 1).alias("r"),
        pct_unrounded("n", "m").alias("u")).collect()}
    assert s == s_cols
    con = duckdb.connect()
    con.execute("CREATE TABLE g(n BIGINT, m BIGINT)")
    con.executemany("INSERT INTO g VALUES (?, ?)", pairs)
    dd = {(r[0], r[1]): (r[2], r[3], r[4]) for r in con.execute(
        f"SELECT n, m, {sql_pct('n', 'm')}, {sql_round_ratio('n', 'm', 1)}, {sql_pct_unrounded('n', 'm')} FROM g"
    ).fetchall()}
    assert s == dd
    rf = spark.createDataFrame([(x,) for x in reals], "x double")
    s2 = sorted((r[0], r[1]) for r in rf.select("x", round_real("x", 2)).collect())
    assert s2 == sorted((r[0], r[1]) for r in rf.select("x", round_real(F.col("x"), 2)).collect())
    con.execute("CREATE TABLE h(x DOUBLE)")
    con.executemany("INSERT INTO h VALUES (?)", [(x,) for x in reals])
    d2 = sorted(con.execute(f"SELECT x, {sql_round_real('x', 2)} FROM h").fetchall())
    assert s2 == d2


def test_signed_average_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(-3, 2), (3, 2), (-1, 4)], "s long, c long")
    got = [r[0] for r in df.select(round_ratio("s", "c", 0)).collect()]
    assert got == [-2.0, 2.0, -0.0 if False else 0.0]
    assert all(str(v) != "-0.0" for v in got)


def test_round_real_is_deterministic_ieee(spark):
    df = spark.createDataFrame([(35.75,), (-35.75,), (None,)], "x double")
    assert [r[0] for r in df.select(round_real(F.col("x"), 1)).collect()] == [35.8, -35.8, None]
