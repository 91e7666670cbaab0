"""Token counts against the library itself: random texts, chunks composed in any order, whole tables."""

import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

from cohortlens.llm import queries, token_counts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(token_counts.default_vocabulary())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def machine():
    v = token_counts.default_vocabulary()
    return token_counts.Compiled(v, token_counts.class_runs(v))


def texts(seed, n, length):
    r = random.Random(seed)
    alphabets = ["ab'  \n\tsretvl1.é", "a ", "'stremvld LL", "0123456789abcdef", ["<|endoftext|>", "<|endof", "a", " ", " \n"],
                 [chr(c) for c in (0x85, 0xA0, 0x3000, 0x4E00, 0x661, 0x1F600, 0x301, 0x2028, 65, 32, 39)]]
    return ["".join(r.choices(r.choice(alphabets), k=r.randrange(length))) for _ in range(n)]


def test_counts_equal_the_library(machine, library):
    all_of = texts(1, 4000, 50) + ["", "aaaa" * 2000, " " * 700, "don't we'll 're", "".join(map(chr, range(0x300, 0x3000)))]
    assert machine.counts(all_of).tolist() == [library(t) for t in all_of]


def test_state_maps_compose_in_any_order(machine, library):
    r = random.Random(2)
    for text in texts(3, 250, 60):
        if not text:
            continue
        k = r.randrange(1, 9)
        if "<|endoftext|>" in text:
            continue
        maps = [machine.state_map(text[a:a + k], text[a - 1] if a else "", a + k >= len(text)) for a in range(0, len(text), k)]
        while len(maps) > 1:
            i = r.randrange(len(maps) - 1)
            maps[i:i + 2] = [machine.compose(maps[i], maps[i + 1])]
        assert maps[0][0][3] == library(text)


def test_long_texts_awkward_rows_and_empty_tables(spark, awkward, empty, library):
    special = spark.createDataFrame([(20, "a<|endoftext|> b" * 300), (21, "<|endoftext|>" * 100), (22, "b" * 3000), (22, "b" * 3000)],
                                    "doc_id long, text string")
    docs = awkward.select("doc_id", "text", "key").unionByName(special, allowMissingColumns=True)
    got = token_counts.count_tokens(docs, chunk=700)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((r.doc_id, len((r.text or "").encode()), library(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_whole_documents_table(spark, library):
    from cohortlens.llm.common import read_table

    got = {r.doc_id: r for r in queries.op13_token_counts(spark, SF).collect()}
    docs = read_table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = library(d.text)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len(d.text.encode()), n > 1024)
