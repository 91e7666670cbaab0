"""Every pipeline stage against brute force on its own input, over the small test documents plus
planted copies, passages and benchmark text."""

from collections import Counter

import corpus_pipeline
from cohortlens.llm import quality_cnn
from cohortlens.llm.common import read_table, written
from tests.conftest import SF_SMALL
from tests.llm.conftest import text
from tests.llm.test_near_and_lines import brute_components, brute_contamination, brute_lines


def test_stages_equal_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    first = docs.orderBy("doc_id").limit(12).collect()
    bench = [tuple(r) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    passage = " ".join(f"{w}{i}" for i, w in enumerate("an honest passage of more than fifty words".split() * 8))
    extra = [(100_000 + i, r.text + " end.", r.lang, r.source, r.n_chars) for i, r in enumerate(first)]
    extra += [(200_000 + i, f"{r.text}\n{passage}", r.lang, r.source, r.n_chars) for i, r in enumerate(first[:6])]
    extra += [(300_000 + i, t, "en", "s", len(t)) for i, (_, t) in enumerate(bench[:4])]
    extra += [(400_000, None, "en", None, None), (None, None, None, None, None), (400_001, "", None, "s", 0), tuple(first[0]), tuple(first[0])]
    docs = written(docs.union(spark.createDataFrame(extra, docs.schema)), "test-docs")
    seen = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_SMALL), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.schema.simpleString() == seen[""].schema.simpleString()
    rows = {k: [(r.doc_id, r.text) for r in d.collect()] for k, d in seen.items() if k != "packing"}

    model = quality_cnn.train(seen[""], read_table(spark, SF_SMALL, "labels"))
    good = {r.doc_id for r in quality_cnn.score_documents(seen[""], model).where("predicted = 1").collect()}
    assert Counter(rows["quality"]) == Counter(x for x in rows[""] if x[0] in good)

    cut = brute_lines(rows["quality"])
    want = [(i, cut[i, t]) for i, t in rows["quality"] if t is not None and cut[i, t].split()]
    assert Counter((i, "".join(t.split())) for i, t in rows["line_dedup"]) == Counter((i, "".join(t.split())) for i, t in want)
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].collect())

    component = {i: c for i, _, c in brute_components(rows["line_dedup"], 5, 80, 100)}
    want = {i for i in component if component[i] == i or component[i] == "None"}
    assert Counter(str(i) for i, _ in rows["near_dedup"]) == Counter(want)

    bad = {i for i, *_, c in brute_contamination(rows["near_dedup"], bench) if c}
    assert bad and sorted(str(i) for i, _ in rows["decontamination"]) == sorted(str(i) for i, _ in rows["near_dedup"] if str(i) not in bad)

    pieces = seen["packing"].collect()
    assert {str(r.doc_id) for r in pieces} == {str(i) for i, _ in rows["decontamination"]}
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.05 * sum(fill.values()) / 1024 + 2


def test_rows_that_share_an_id_are_judged_apart(spark):
    a, b, c, d, e = (text(i) for i in range(500, 505))
    rows = [(1, a, "en"), (1, b, "en"), (2, a + " end", "en"), (3, c, "en"), (3, d, "en"), (0, c + " end", "en"),
            (5, e, "en"), (5, e, "de"), (None, e, "en"), (6, "", "en"), (6, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n in (1, 5):
        got = corpus_pipeline.near_dedup(spark, docs.repartition(n), SF_SMALL)
        assert got.columns == docs.columns
        assert Counter(tuple(r) for r in got.collect()) == Counter(r for r in rows if r not in (rows[2], rows[3], rows[6]))


def test_an_empty_table_passes_every_stage(spark):
    docs = read_table(spark, SF_SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_SMALL), f"test-empty-{name}")
        assert docs.count() == 0
