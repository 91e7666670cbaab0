"""Cleaning expressions and ingest builds on hand-made raw rows (B-rows, P12, P13, P15, P16)."""

from pyspark.sql import functions as F

from cohortlens.functions.cleaning import (clean_text, collapse_flags, parse_date, parse_number,
                                           person_key, person_key_from_parts, Header,
                                           split_name)
from cohortlens.operators import ingest


def one(df):
    return [tuple(r) for r in df.collect()]


def test_b1_person_key(spark):
    df = spark.createDataFrame([("Doe, J. Ann/B",), (None,), ("  Smith , Al ",)], "n string")
    assert [r[0] for r in df.select(person_key("n")).collect()] == ["doe-jannb", None, "smith-al"]


def test_b2_p16_null_parts_give_null_key(spark):
    df = spark.createDataFrame([("Doe", "Jane"), (None, None), ("Doe", None)], "l string, f string")
    assert [r[0] for r in df.select(person_key_from_parts("l", "f")).collect()] == ["doe-jane", None, None]


def test_b3_split_name(spark):
    df = spark.createDataFrame([("Doe, Jane",), ("Single",), (None,)], "n string")
    last, first = split_name("n")
    assert one(df.select(last, first)) == [("Doe", "Jane"), ("Single", None), (None, None)]


def test_b4_b5_lenient_parsing(spark):
    df = spark.createDataFrame([("1/2/2024", " 12 "), ("2024-03-04", "n/a"), ("unknown", None),
                                ("00/00/0000", "1e3")], "d string, x string")
    got = [(str(r[0]) if r[0] else None, r[1]) for r in df.select(parse_date("d"), parse_number("x")).collect()]
    assert got == [("2024-01-02", 12.0), ("2024-03-04", None), (None, None), (None, 1000.0)]


def test_p12_blank_and_nan_are_null(spark):
    df = spark.createDataFrame([(" x ",), ("",), ("nan",), ("NaN",), (None,), ("  ",)], "s string")
    assert [r[0] for r in df.select(clean_text("s")).collect()] == ["x", None, None, None, None, None]


def test_b10_collapse_flags(spark):
    df = spark.createDataFrame([("1.0", None), ("1.0", "1.0"), (None, ""), (None, "1")], "a string, b string")
    got = [r[0] for r in df.select(collapse_flags({"A": F.col("a"), "B": F.col("b")})).collect()]
    assert got == ["A", "Multi-Racial", None, "B"]


def test_a3_resolve_column_first_in_file_order():
    cols = ["Participant Name", "Dx Code", "Condition Description", "Assessment Date"]
    h = Header(cols)
    assert h.holding("DIAGNOSIS", "CODE", "DX") == "Dx Code"
    assert h.holding("DIAGNOSIS", "DESCRIPTION", "CONDITION") == "Condition Description"
    assert h.named("CHARGE DATE") is None and h.named("dx code") == "Dx Code"
    assert Header(["MHC Charge Date", "Charge Date 2"]).holding("CHARGE", without="MHC") == "Charge Date 2"


def test_b18_days_filled_only_when_whole_column_empty(spark):
    empty = spark.createDataFrame([("Doe, J", "1/1/2024", "1/11/2024", None),
                                   ("Roe, K", "2/1/2024", "2/3/2024", None)],
                                  "`Participant Name` string, `Booking Start` string, `Release Date` string, Days string")
    partial = spark.createDataFrame([("Doe, J", "1/1/2024", "1/11/2024", None),
                                     ("Roe, K", "2/1/2024", "2/3/2024", "5")],
                                    "`Participant Name` string, `Booking Start` string, `Release Date` string, Days string")
    assert sorted(r.days_incarcerated for r in ingest.build_jail(empty).collect()) == [2.0, 10.0]
    got = sorted((r.participant_id, r.days_incarcerated) for r in ingest.build_jail(partial).collect())
    assert got == [("doe-j", None), ("roe-k", 5.0)]


def test_p13_treatment_category_from_file_segment(spark):
    df = spark.createDataFrame([("Doe, J", "1/1/2024", "/x/X_MH_FY23.csv"), ("Doe, J", "1/1/2024", "/x/X_CD_FY23.csv"),
                                ("Doe, J", "1/1/2024", "/x/X_Historical.csv"), ("Doe, J", "1/1/2024", "/x/MHC_Other.csv")],
                               "`Client Name` string, `Start Date` string, source_file string")
    got = [r.treatment_type for r in ingest.build_treatment(df).collect()]
    assert got == ["Mental Health", "Chemical Dependency", "Unknown", "Unknown"]


def test_p15_dimension_distinct_before_trim(spark):
    raw = spark.createDataFrame([
        (1, "1/1/2024", "Doe", "J", " Theft", "f", "A", "G/Convicted"),
        (2, "1/2/2024", "Doe", "J", "Theft", "F", "A", "Dismissed"),
        (3, "1/3/2024", "Roe", "K", " Theft", "f", "A", None),
        (4, None, "Roe", "K", "Fraud", "M", "A", None)],
        "_row long, `Charge Date` string, `Last Name` string, `First Name` string, Offense string, "
        "Class string, `MHC Status` string, `NG/Dismissed` string")
    offense, facts = ingest.build_charges(raw)
    assert sorted(one(offense)) == [(1, "Theft", "F"), (2, "Theft", "F")]
    assert sorted(one(facts.select("participant_id", "offense_id", "outcome")),
                  key=lambda r: (r[0], r[1], r[2] or "")) == [
        ("doe-j", 1, "Convicted"), ("doe-j", 2, "Dismissed"), ("roe-k", 1, None)]


def test_b9_first_per_key_and_b13_dense_ids(spark):
    df = spark.createDataFrame([("a", 3, "x3"), ("a", 1, "x1"), ("b", 2, "y2"), (None, 5, "n")],
                               "k string, _row long, v string")
    got = sorted(one(ingest.first_per_key(df, ["k"], "_row")), key=lambda r: (r[0] or ""))
    assert got == [(None, 5, "n"), ("a", 1, "x1"), ("b", 2, "y2")]
    big = spark.range(0, 3000).select(((F.col("id") * 7919) % 3001).alias("o"))
    ids = ingest.dense_ids(big, "o", "rid")
    got = sorted((r.o, r.rid) for r in ids.collect())
    assert [rid for _, rid in got] == list(range(1, len(got) + 1))


def test_b23_codes_left_pairs_before_right(spark):
    raw = spark.createDataFrame([(0, "C1", "one", None, None, "C2", "two"),
                                 (1, "C2", "dup", None, None, None, None),
                                 (2, " ", "blank", None, None, "C3", "three")],
                                "_row long, a string, b string, c string, d string, e string, f string")
    got = sorted(one(ingest.build_diagnosis_codes(raw)))
    assert got == [("C1", "one"), ("C2", "dup"), ("C3", "three")]


def test_parsing_twins_agree_on_awkward_inputs(spark):
    import duckdb

    from cohortlens.plans.ingest_ops import s_date, s_num
    vals = ["1/2/2024", "01/02/2024", "2/29/2023", "13/1/2024", "1/2/24", "1/2/0024", " 1/2/2024 ",
            "2024-03-04", "2024-3-4", "2024-03-04T10:00:00", "3-4-2024", "1/2/2024 10:00", "", "nan",
            "0/0/2024", "2024/03/04", "\t1/2/2024\n", "12", "1e3", "1,000", "$5", "-3.5", "1_000", ".5", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    s = [(r[0], r[1]) for r in df.orderBy("i").select(parse_date("v"), parse_number("v")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INT, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    d = con.execute(f"SELECT {s_date('v')}, {s_num('v')} FROM t ORDER BY i").fetchall()

    def norm(rows):
        return [tuple("NaN" if isinstance(x, float) and x != x else x for x in r) for r in rows]
    assert norm(s) == norm(d)


def test_whitespace_twins_match_python_strip(spark):
    import duckdb

    from cohortlens.plans.ingest_ops import s_clean, s_key
    vals = ["\x0bDoe, J\x0b", "　Doe, J ", "\xa0Doe, J\xa0", " Doe , J. ", "  ", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    s = [tuple(r) for r in df.orderBy("i").select(person_key("v"), clean_text("v")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INT, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    d = [tuple(r) for r in con.execute(f"SELECT {s_key('v')}, {s_clean('v')} FROM t ORDER BY i").fetchall()]
    assert s == d
    expect = [None if v is None else (v.strip() or None) for v in vals]  # Python's strip
    assert [r[1] for r in s] == expect


def test_no_format_is_tried_on_texts_it_cannot_read(spark):
    """A failing parse throws and catches an exception; each parser is reached through its shape only, and the
    shapes turn away nothing that Spark's parser reads."""
    import itertools
    import random

    from pyspark.sql import functions as F

    from cohortlens.functions.cleaning import DATE_FORMATS, DATE_SHAPES, SHORT_YEAR_FORMATS, parse_date, strip_ws

    rnd = random.Random(4)
    parts = ["1", "01", "001", "12", "13", "31", "0", "-1", "+2", "20", "69", "1999", "2020", "02020", "12020", "+12020", "-2020",
             "Jan", "jan", "SEPT", "Sep", "ſep", "May.", "March", "x", ""]
    texts = ["".join(p) for s in "/-. " for p in ([a, s, b, s, c] for a, b, c in itertools.product(parts, repeat=3)) if rnd.random() < 0.15]
    texts += [f"{a} {b}, {c}" for a, b, c in itertools.product(parts, repeat=3) if rnd.random() < 0.3]
    texts += ["1/2/2020 10:00", "2020-01-02T10:00:00.5", "Customer", "Ann/Marie", "000000012, Customer J.", "1/2/2020\n", "\x1c1/2/20　", None]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    bare = strip_ws("t")
    for fmt in [*DATE_FORMATS, *SHORT_YEAR_FORMATS]:
        lost = df.where(F.try_to_date(bare, fmt).isNotNull() & ~bare.rlike(DATE_SHAPES[fmt]))
        assert lost.count() == 0, (fmt, lost.take(3))
    plan = df.select(parse_date("t").alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") >= plan.count("gettimestamp") > 0
    got = {r.t: str(r.d) for r in df.select("t", parse_date("t").cast("string").alias("d")).collect()}
    assert (got["1/2/2020 10:00"], got["2020-01-02T10:00:00.5"], got["1/2/2020\n"], got["\x1c1/2/20　"], got["Customer"]) == (
        "2020-01-02", "2020-01-02", "2020-01-02", "2020-01-02", "None")


def test_strip_takes_the_characters_that_python_takes(spark):
    from cohortlens.functions.cleaning import STRIP_PATTERN, WS_CHARS, strip_ws
    from pyspark.sql import functions as F

    assert set(WS_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    texts = ["", " ", "a", "　é b \n", "﻿x ", "日 本\x85", " \t\x1f", "a\n b"] + [f"{c}q{c}" for c in WS_CHARS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_ws("t").alias("s"), F.regexp_replace("t", STRIP_PATTERN, "").alias("r"))
    assert all(r.s == r.t.strip() == r.r for r in df.collect())
    plan = df.select("s")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
