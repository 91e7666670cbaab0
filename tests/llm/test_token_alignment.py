"""Token alignment against the definition: both libraries on whole texts, all pairs of ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortlens.llm import queries, token_alignment, token_counts
from cohortlens.llm.common import read_table

FILES = token_alignment.default_files()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute():
    """text -> (n_a, n_b, n_groups, n_links, digest, {(a, b): times})."""
    a_lib = Tokenizer.from_file(FILES[0])
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = token_counts.byte_letters()

    def ranges(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def piece(i):
        name = b_lib.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b_lib.is_byte(i) else name.replace("▁", " ").encode()

    def one(text):
        nothing = (0, 0, 0, 0, "", {})
        if not text:
            return nothing
        a = [(i, bytes(letters[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in b_lib.encode(text)]
        if any(b"".join(raw for _, raw in t) != (" " + text).encode() for t in (a, b)):
            return nothing
        a, b = ranges(a), ranges(b)
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = ["|".join(",".join(str(i) for i, _, e in t if lo < e <= hi) for t in (a, b)) for lo, hi in zip([0, *ends], ends)]
        links, j0 = Counter(), 0
        for i, s, e in a:
            while b[j0][2] <= s:
                j0 += 1
            for j, u, _ in b[j0:]:
                if u >= e:
                    break
                links[i, j] += 1
        return len(a), len(b), len(ends), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest(), dict(links)

    return one


def expected(docs, brute):
    """Rows of the contract for (id, text) pairs."""
    found = [(i, brute(t)) for i, t in docs]
    count = Counter(p for _, f in found for p in f[5])
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return Counter((i, *f[:4], sum(n for p, n in f[5].items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in f[5].items()), f[4])
                   for i, f in found)


def plain(row):
    return (*row[:5], {(int(p) >> 18, int(p) & (1 << 18) - 1): int(n) for p, n in zip(row[5], row[6])})


def texts(seed, n, length):
    r = random.Random(seed)
    alphabets = ["ab'  \n\tsretvl1.é", "a ", ["<s>", "</s>", "<unk>", "<0x0A>", "▁", " ", "<|endoftext|>", "a"],
                 [chr(c) for c in (0x85, 0xA0, 0x3000, 0x4E00, 0x1F600, 0x301, 65, 32, 39, 0xFB01)], " the quick brown fox, jumped! over 12 lazy dogs' "]
    return ["".join(r.choices(r.choice(alphabets), k=r.randrange(length))) for _ in range(n)]


def test_alignment_equals_the_definition(brute):
    tool = token_alignment.Aligner(*FILES)
    all_of = texts(1, 1500, 50) + ["", " ", "x" * 3000, "a▁b"]
    assert [plain(r)[:5] + (plain(r)[5],) for r in tool.align(all_of)] == [brute(t) for t in all_of]


def test_fragments_compose_in_any_order(brute):
    tool, r = token_alignment.Aligner(*FILES), random.Random(4)
    opened = 0
    for text in texts(3, 400, 90):
        if not text:
            continue
        chunks = token_alignment.chunks_of(text, r.randrange(1, 9), r.choice([3, 8, 50]))
        assert "".join(c[1] for c in chunks) == " " + text
        frags = [tool.fragment(*c) for c in chunks]
        opened += sum(f["ok"] and len(f["tail"][0]) + len(f["tail"][1]) > 0 for f in frags)
        while len(frags) > 1:
            i = r.randrange(len(frags) - 1)
            frags[i:i + 2] = [tool.compose(frags[i], frags[i + 1])]
        assert plain(tool.finished(frags[0])) == brute(text)
    assert opened > 50


def test_long_texts_awkward_rows_and_empty_tables(spark, awkward, empty, brute):
    extra = spark.createDataFrame([(20, "a▁b " * 500), (21, "word " * 400), (22, "b" * 3000), (22, "b" * 3000), (23, "  \n" * 400)],
                                  "doc_id long, text string")
    docs = awkward.select("doc_id", "text", "key").unionByName(extra, allowMissingColumns=True)
    docs = docs.where("length(text) < 20000 or text is null")
    got = token_alignment.align_tokens(docs, chunk=600)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == expected([(r.doc_id, r.text) for r in docs.collect()], brute)
    assert token_alignment.align_tokens(empty).count() == 0


def test_whole_documents_table(spark, brute):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    assert Counter(map(tuple, queries.op11_token_alignment(spark, SF).collect())) == expected(docs, brute)
