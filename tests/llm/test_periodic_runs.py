"""Runs of words against a scan of all periods; the whole table against the contract's definition."""

import hashlib
import random
import zlib

import numpy as np

from cohortlens.llm import periodic_runs, queries
from cohortlens.llm.common import read_table

SF = "/root/testdata/sf0.01"


def brute(w):
    """Every stretch of smallest period q with at least max(6, 4q) words, found period by period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q) and not any(all(w[s + k] == w[s + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_runs_equal_a_scan_of_all_periods():
    r = random.Random(7)
    for _ in range(3000):
        w = [r.randrange(r.randrange(1, 4)) for _ in range(r.randrange(60))]
        unit = [r.randrange(3) for _ in range(r.randrange(1, 6))]
        w = w[:r.randrange(12)] + unit * r.randrange(9) + w[:r.randrange(12)] + unit * r.randrange(9)
        assert periodic_runs.runs(np.array(w, np.int64)) == brute(w)


def test_long_repeats_take_linear_steps():
    for unit in (["a"], list("abcdefghij")):
        words = [w.encode() for w in unit * (100_000 // len(unit))]
        assert periodic_runs._judged(words)[:4] == (1, 0, 100_000, len(unit))


def test_awkward_rows_and_empty_tables(spark, awkward, empty):
    extra = spark.createDataFrame([(30, "a b " * 40), (31, "x x x x x x y y y y y y"), (31, "x x x x x x y y y y y y"), (32, "a a " * 9),
                                   (33, "a a a a a")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text", "key").unionByName(extra, allowMissingColumns=True)
    got = periodic_runs.find_runs(docs, keep_text=True).collect()
    assert len(got) == docs.count()
    want = sorted(((r.doc_id, *expected(split(r.text))) for r in docs.collect()), key=str)
    assert sorted((tuple(r[:8]) for r in got), key=str) == want
    one = next(r for r in got if r.doc_id == 31)
    assert [tuple(x) for x in one.runs] == [(0, 6, 1), (6, 6, 1)] and one.collapsed == "x y"
    assert periodic_runs.find_runs(empty).count() == 0


def test_whole_documents_table(spark):
    got = {r.doc_id: tuple(r[1:]) for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = read_table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        w, h = split(d.text), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) <= 600 or h % 10 == 0 and len(w) < 1500:
            assert got[d.doc_id] == expected(w)
