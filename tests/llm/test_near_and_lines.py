"""Near-duplicates, line dedup and decontamination against brute force on awkward rows."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, line_winnowing, minhash_hamming, queries
from tests.conftest import SF_SMALL
from tests.llm.conftest import PASSAGE, text


def brute_components(rows, size, num, den):
    sets, parent = [], {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append((i, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if w else frozenset()))

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and i is not None and j is not None and den * len(s & u) >= num * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else find(i))) for i, s in sets)


@pytest.mark.parametrize(("size", "threshold"), [(3, (85, 100)), (5, (80, 100))])
def test_components_equal_all_pairs(spark, size, threshold):
    r = random.Random(3)
    rows = []
    for g in range(12):
        base = text(100 + g, 90).split()
        for _ in range(r.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_hamming.near_duplicates(docs, shingle=size, threshold=threshold).collect()
    assert sorted((str(x[0]), x[1], str(x[2])) for x in got) == brute_components(rows, size, *threshold)
    assert all(x.kept == (x.component_id == x.doc_id) for x in got)


def test_a_hot_group_of_near_copies_and_a_hot_passage(spark):
    """More classes than a small key holds: near copies of one text, and texts that share most of a passage."""
    r = random.Random(5)
    base, rows = text(1, 120).split(), []
    for i in range(90):
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, PASSAGE + " " + text(300 + i, 25)) for i in range(60)]
    got = minhash_hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=(85, 100))
    assert sorted((str(x[0]), x[1], str(x[2])) for x in got.collect()) == brute_components(rows, 3, 85, 100)


def test_near_duplicates_of_awkward_rows(spark, awkward, empty):
    got = [tuple(x) for x in minhash_hamming.near_duplicates(awkward).collect()]
    rows = [(x.doc_id, x.text) for x in awkward.collect()]
    assert sorted((str(a), b, str(c)) for a, b, c, _ in got) == brute_components(rows, 5, 80, 100)
    assert minhash_hamming.near_duplicates(empty).count() == 0


def test_chunks_guarantee_the_distance():
    for s in (0.8, 0.85, 0.95):
        cuts = minhash_hamming.chunks(64, s)
        assert sum(n for _, n in cuts) == 64
        assert 2 * len(cuts) > minhash_hamming.reach(64, s, 4.7)  # fewer than two errors somewhere


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 50)] + [(100, 90), (200, 200)], "a long, b long")
    got = dict(map(tuple, minhash_hamming.components_of(links).collect()))
    assert got == {**dict.fromkeys(range(51), 0), 90: 90, 100: 90}


def brute_lines(rows, min_words=50):
    """Delete each line in a run of min_words words that occurs earlier, straight from the definition."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    seqs = [[(p, x.strip(" \t\r\f\v"), len(x.split())) for p, x in enumerate(t.split("\n")) if x.split()] for _, t in docs]
    first, gone = {}, defaultdict(set)
    spans = []
    for d, s in enumerate(seqs):
        for a in range(len(s)):
            n = 0
            for b in range(a, len(s)):
                n += s[b][2]
                if n >= min_words:
                    spans.append(((d, a), tuple(x[1] for x in s[a:b + 1]), b))
                    if b > a + 30:
                        break
    for place, key, _ in sorted(spans):
        first.setdefault(key, place)
    for (d, a), key, b in spans:
        if first[key] < (d, a):
            gone[d].update(range(seqs[d][a][0], seqs[d][b][0] + 1))
    return {docs[d]: "\n".join(x for p, x in enumerate(docs[d][1].split("\n")) if p not in gone[d]) for d in range(len(docs))}


def test_line_dedup_equals_the_definition(spark):
    r = random.Random(9)
    pool = [" ".join(f"l{i}x{j}" for j in range(r.choice([3, 12, 30, 55]))) for i in range(14)]
    rows = [(i, "\n".join(r.choice([*pool, "", "  ", f"own {i}"]) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    out = line_winnowing.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_lines(rows)

    def lines(t):  # blank lines go with the window that holds them, not with the whole run
        return [x for x in t.split("\n") if x.strip()]

    assert {x.doc_id: lines(x.text) for x in out.collect()} == {i: lines(want[i, t]) for i, t in rows}


def test_line_dedup_of_awkward_rows(spark, awkward, empty):
    out = line_winnowing.dedup_lines(awkward, count_col="n_deleted")
    assert out.columns == [*awkward.columns, "n_deleted"] and out.count() == awkward.count()
    want = brute_lines([(x.doc_id, x.text) for x in awkward.collect()])
    got = sorted((str(x.doc_id), str(x.text)) for x in out.collect())
    assert got == sorted((str(x.doc_id), str(want.get((x.doc_id, x.text)))) for x in awkward.collect())
    assert [x.text for x in out.where("doc_id = 9").collect()] == [text(9)]  # the passage stays in 8 only
    assert line_winnowing.dedup_lines(empty).count() == 0


def brute_contamination(rows, items, window=13):
    import hashlib
    import re

    def toks(t):
        t = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = []
    for i, t in rows:
        w, hit, found = toks(t), set(), set()
        for item, x in items:
            q = toks(x)
            k = min(window, len(q))
            grams = {tuple(q[a:a + k]) for a in range(len(q) - k + 1)} if q else set()
            for a in range(len(w) - k + 1 if k else 0):
                if tuple(w[a:a + k]) in grams:
                    hit.update(range(a, a + k))
                    found.add(item)
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((str(i), len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


ITEMS = [(1, PASSAGE), (2, "One"), (2, "one"), (3, ""), (4, None), (None, text(4)), (5, text(0, 80)[50:160].upper()), (6, "É é long5 long6")]


def test_contamination_equals_brute_force(spark, awkward, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.contamination(awkward, items).drop("key").collect()
    rows = [(x.doc_id, x.text) for x in awkward.collect()]
    assert sorted((str(x[0]), *x[1:]) for x in got) == brute_contamination(rows, ITEMS)
    assert decontamination.contamination(empty, items).count() == 0
    none = decontamination.contamination(awkward, items.limit(0)).where("contaminated or n_hit > 0")
    assert none.count() == 0


def test_the_shuffle_way_equals_the_broadcast_way(spark, awkward):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    a, b = (sorted(map(str, decontamination.contamination(awkward, items, broadcast_rows=n).collect())) for n in (0, 10**6))
    assert a == b


def test_proximity_finds_what_a_phrase_misses(spark):
    words = PASSAGE.split()
    broken = " ".join(w for i, w in enumerate(words) if i % 9)
    docs = spark.createDataFrame([(1, broken), (2, text(2))], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert not decontamination.contamination(docs, items).where("n_hit > 0").count()
    near = decontamination.proximity_matches(docs, spark.createDataFrame([(1, " ".join(words[:18]))], "item_id long, text string"), slack=3, share=0.7)
    assert [(x.doc_id, x.item_id) for x in near.collect()] == [(1, 1)]


def test_proximity_finds_an_item_without_its_rarest_word(spark):
    words = PASSAGE.split()[:13]
    rows = [(i, " ".join("other" if w == words[6] else w for w in words)) for i in (1, 2)]
    docs = spark.createDataFrame([*rows, (3, f"alone {words[6]}")], "doc_id long, text string")
    near = decontamination.proximity_matches(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert sorted(tuple(r) for r in near.collect()) == [(1, 1, 0, 12 / 13), (2, 1, 0, 12 / 13)]


def brute_proximity(rows, items, slack, share):
    out = []
    for i, t in rows:
        w = t.split()
        for item, x in items:
            q = x.split()
            if not q:
                continue

            def held(s, reach, w=w, q=q):
                return sum(v in w[max(s + a - reach, 0):max(s + a + reach + 1, 0)] for a, v in enumerate(q))

            held_at = [(held(s, slack) / len(q), held(s, 0), -s) for s in range(-len(q) - slack, len(w) + slack)]
            matched, _, back = max(held_at)
            if matched >= share:
                out.append((i, item, -back, matched))
    return sorted(out)


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_proximity_equals_brute_force(spark, broadcast_rows):
    r = random.Random(21)
    items = [(i, " ".join(f"t{r.randrange(40)}" for _ in range(r.choice([1, 2, 5, 13, 15, 30])))) for i in range(25)] + [(99, "")]
    rows = []
    for i in range(60):
        w = r.choice(items)[1].split()
        for _ in range(round(len(w) * r.choice([0, 0.1, 0.2, 0.3]))):
            w[r.randrange(len(w))] = f"t{r.randrange(50)}"
        for _ in range(r.randrange(3)):
            w.insert(r.randrange(len(w) + 1), "added")
        pad = [f"t{r.randrange(50)}" for _ in range(r.randrange(12))]
        rows.append((i, " ".join(pad + w[r.randrange(3):])))
    near = decontamination.proximity_matches(spark.createDataFrame(rows, "doc_id long, text string"),
                                             spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows)
    want = brute_proximity(rows, items, 3, 0.8)
    assert len(want) > 60 and sorted(tuple(x) for x in near.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, duck, name):
    s, d = queries.SPARK[name](spark, SF_SMALL).toArrow(), duck.sql(queries.SQL[name]).to_arrow_table()
    cols = sorted(s.column_names)
    assert cols == sorted(d.column_names)
    assert sorted(str([r[c] for c in cols]) for r in s.to_pylist()) == sorted(str([r[c] for c in cols]) for r in d.to_pylist())


def test_parities_of_sets_over_the_threshold_are_never_too_far_apart():
    rng = np.random.default_rng(11)
    far = 0
    for n in (1, 5, 40, 400, 6000):
        for _ in range(40):
            a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            swapped = rng.integers(0, n // 3 + 1)
            b = np.concatenate([a[swapped:], rng.integers(0, 1 << 64, swapped, dtype=np.uint64)])
            x, y = (np.array(minhash_hamming.parities(np.unique(v)), np.int64).view(np.uint64) for v in (a, b))
            differing = int(np.bitwise_count(x ^ y).sum())
            assert differing <= 2 * swapped
            near = 100 * (n - swapped) >= 80 * (n + swapped)
            assert not near or 180 * differing <= 20 * 2 * n
            far += not near and n <= 400 and 180 * differing > 20 * 2 * n
    assert far > 30  # and most of the others are told apart


def test_lines_are_trimmed_once(spark):
    """A lambda works every use of its argument out anew, so the trimming stands in a step of its own."""
    from cohortlens.llm.line_winnowing import deleted_lines

    df = spark.createDataFrame([(1, "a b\n c ")], "doc_id long, text string")
    plan = deleted_lines(df, min_words=2)._jdf.queryExecution().analyzed().toString()
    assert plan.count("btrim(") == plan.count("split(text") > 0  # the plan holds the lines several times


def test_words_lower_a_to_z_alone_and_drop_no_word(spark):
    texts = [None, "", " ", "One two", " É ÉCOLE École ", "a--B\tc\n", "ÄB1 x", "KK İI", "...", "A", "x\x00Y", "ſS ẞT"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    cut = F.translate("text", decontamination.UPPER, decontamination.LOWER)
    plain = F.filter(F.split(cut, decontamination.NOT_WORD, -1), lambda w: w != "")
    out = df.select("id", decontamination.words(F.col("text")).alias("got"), plain.alias("want"))
    assert [r.got for r in out.orderBy("id").collect()] == [r.want for r in out.orderBy("id").collect()]
    plan = df.select(decontamination.words(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "lower(" in plan  # no interpreted pass over the words


def test_words_are_counted_without_a_result_object_for_each(spark):
    texts = [None, "", " ", "One two", " É ÉCOLE École ", "a--B\tc\n", "A", "x\x00Y", "...", "Z@[`{z:/09", "日本 한국", "\n a1\n\nB2 ", "\x7f\x80é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = decontamination.contamination(docs, items)
    want = [len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for t in texts]
    assert [r.n_words for r in out.orderBy("doc_id").collect()] == want
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_line_dedup_cuts_a_text_once_for_its_lines_and_once_for_the_result(spark, monkeypatch):
    """Not for the filter by words, for each reading of the windows or for each deleted span."""
    seen, write = [], line_winnowing.written
    monkeypatch.setattr(line_winnowing, "written", lambda df, name: seen.append(df) or write(df, name))
    lines = ["a  b", "\tc d ", "e\x0bf g", "", "h i"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["x", *lines, "y", *lines]))], "doc_id long, text string")
    out = line_winnowing.dedup_lines(docs, min_words=9, count_col="n")
    assert sorted(map(tuple, out.collect())) == [(1, "\n".join(lines), 0), (2, "x\ny", 10)]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in [*seen, out]]
    assert [p.count("split(text#") for p in plans] == [1, 1]


def test_words_of_a_line(spark):
    lines = ["", "a", "a b", "a  b", "a\tb c", "a\r\x0b\fb", "é ü\u00a0x", "a b c  d e"]
    df = spark.createDataFrame([(x,) for x in lines], "t string").select(line_winnowing._n_words(F.col("t")))
    assert [r[0] for r in df.collect()] == [len(re.findall(r"[^ \t\n\x0B\f\r]+", x)) for x in lines]
