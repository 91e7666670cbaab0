"""Classifiers, packing, chat windows, URL graph, PII and nearest neighbours on small fixtures."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import chat_windows, hnsw, packing, pii_crf, quality_cnn, queries, toxicity_fm, url_graph
from cohortlens.llm.common import read_table
from cohortlens.llm.training import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_rows_are_the_stated_third(spark):
    got = {r.id for r in spark.range(2000).where(held_out("id")).collect()}
    assert got == {i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 == 1}


@pytest.mark.parametrize(("module", "label", "threshold"), [(quality_cnn, "quality", 0.5), (toxicity_fm, "toxic", 0.7)])
def test_held_out_accuracy_and_awkward_rows(spark, awkward, empty, module, label, threshold):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = module.train(docs, labels)
    got = module.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = sum((r.score >= threshold) == (r[label] == 1) for r in got)
    assert len(got) > 80 and right / len(got) >= 0.93
    scored = module.score_documents(awkward, model).collect()
    assert len(scored) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in scored)
    assert len({r.score for r in scored if r.doc_id == 4}) == 1
    assert module.score_documents(empty, model).count() == 0
    assert module.score_documents(awkward, module.train(docs, labels.limit(0))).count() == awkward.count()


def _plain_score(model, text):
    """The network by its definition, window by window and chunk by chunk."""
    q = quality_cnn
    steps = max(1, -(-len(text) // q.STEP))
    padded = text + b"\0" * (steps * q.STEP + q.WIDTH - len(text))
    taps = model["w"].reshape(q.STEP * q.EMBED, q.TAPS, q.FILTERS).astype(float)
    out = []
    for i in range(steps):
        z = model["b"].astype(float)
        for k in range(q.TAPS):
            part = padded[(i + k) * q.STEP:(i + k + 1) * q.STEP]
            z = z + model["emb"][np.frombuffer(part, np.uint8)].astype(float).ravel() @ taps[:, k]
        out.append(np.maximum(z, 0))
    half = q.CHUNK // 2
    starts = range(0, max(1, steps - half), half)
    chunks = np.array([np.max(out[i:i + q.CHUNK], axis=0) for i in starts])
    x = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0), [min(1, len(text) / (q.CHUNK * q.STEP))]])
    hidden = np.maximum(x @ model["h"] + model["hb"], 0)
    return 1 / (1 + np.exp(-(hidden @ model["out"] + model["bias"][0])))


def test_scores_equal_a_plain_convolution_whole_and_piecewise():
    rng = np.random.default_rng(0)
    train = [bytes(rng.integers(97, 123, rng.integers(0, 900), dtype=np.uint8)) for _ in range(16)]
    model = quality_cnn.fit(train, [0, 1] * 8, epochs=2)
    sizes = [0, 1, 3, 4, 127, 128, 129, 256, 257, 384, 385, 1000, 5000]
    texts = [bytes(rng.integers(32, 123, n, dtype=np.uint8)) for n in sizes]
    got = quality_cnn.scores(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + sizes))
    assert np.allclose(got, [_plain_score(model, t) for t in texts], atol=1e-5)
    for n in (quality_cnn.PIECE + 1, quality_cnn.PIECE + 131, 2 * quality_cnn.PIECE, 2 * quality_cnn.PIECE + 77):
        text = bytes(rng.integers(32, 123, n, dtype=np.uint8))
        assert abs(quality_cnn.scores(model, np.frombuffer(text, np.uint8), np.array([0, n]))[0] - _plain_score(model, text)) < 1e-5


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (0, 5, 130, 700, 1500)]
    y, weight = np.array([0, 1, 1, 0, 1.0]), np.array([1, 2, 0.5, 1, 1.0])
    model = {k: v.astype(float) for k, v in quality_cnn.fit(texts, [0, 1, 1, 0, 1], epochs=1).items()}
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])

    def loss():
        p = quality_cnn.scores(model, buf, off)
        return (weight * -np.log(np.where(y == 1, p, 1 - p))).mean() + 0.5e-4 * (model["h"] ** 2).sum()

    grad = quality_cnn._gradients(model, texts, y, weight)
    for name, g in grad.items():
        flat, g = model[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in np.argsort(-abs(g))[:12]:
            keep, eps = flat[i], 1e-6
            flat[i] = keep + eps
            up = loss()
            flat[i] = keep - eps
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - g[i]) <= 1e-4 * max(1, abs(g[i])), name


def test_a_pair_of_terms_weighs_more_than_its_parts():
    texts = ["aaaa x", "bbbb x", "aaaa bbbb", "x y"] * 40
    model = toxicity_fm.fit([t.encode() for t in texts], [0, 0, 1, 0] * 40)
    buf = np.frombuffer(b"".join(t.encode() for t in texts[:4]), np.uint8)
    s = toxicity_fm.scores(model, buf, np.cumsum([0] + [len(t) for t in texts[:4]]))
    assert s[2] > 0.8 and max(s[0], s[1], s[3]) < 0.3


def test_terms_neutral_alone_are_learned_as_a_pair():
    pairs = {"grp ins": 1, "oth fri": 1, "grp fri": 0, "oth ins": 0}
    model = toxicity_fm.fit([t.encode() for t in pairs] * 300, list(pairs.values()) * 300)
    buf = np.frombuffer("".join(pairs).encode(), np.uint8)
    s = toxicity_fm.scores(model, buf, np.cumsum([0] + [len(t) for t in pairs]))
    assert s[0] > 0.9 and s[1] > 0.9 and s[2] < 0.1 and s[3] < 0.1


def test_the_score_equals_a_plain_sum_over_pairs():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 12))).encode() for _ in range(60)]
    model = toxicity_fm.fit(texts * 8, [int(b"a" in t and b"b" in t) for t in texts] * 8)
    assert len(model["w"]) >= 2
    for t in texts:
        off = np.array([0, len(t)])
        terms = toxicity_fm._terms(np.frombuffer(t, np.uint8), off, model["table"])[1]
        raw = model["w0"][0] + model["w"][terms].sum()
        raw += sum(model["v"][i] @ model["v"][j] for k, i in enumerate(terms) for j in terms[k + 1:])
        assert abs(toxicity_fm.scores(model, np.frombuffer(t, np.uint8), off)[0] - 1 / (1 + np.exp(-raw))) < 1e-9


def test_nearest_of_ids_with_several_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.9987, 0.0499, 0.01]
    rows = [(1, a), (1, b), (2, b), (3, c), (50, c), (50, c), (7, [2.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 9, 0.5, "x") for i, v in rows],
                                  "vec_id long, embedding array<double>, point long, score double, query string")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in hnsw.nearest(table, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    near, far = round(0.9987 / np.linalg.norm(c), 6), round(0.0499 / np.linalg.norm(c), 6)
    assert got == [(50, 1, 3, 1.0), (50, 2, 1, near), (50, 3, 7, near), (50, 4, 1, far), (50, 5, 2, far)]


# -------------------------------------------------------------------------------- packing

def check_plan(counts, capacity=64, **k):
    intervals, n = packing.plan(counts, capacity, **k)
    ranks, space = defaultdict(list), defaultdict(list)
    for length, lo, hi, seq, offset in intervals:
        ranks[length] += range(lo, hi)
        for i in range(hi - lo):
            space[seq + i].append((offset, length))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(m)) for s, m in counts.items() if m}
    for parts in space.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][0] + parts[-1][1] <= capacity
        assert all(a + m == b for (a, m), (b, _) in zip(parts, parts[1:], strict=False))
    assert len(space) == n
    return n


def test_plans_are_complete_gapless_and_near_the_bound():
    r = random.Random(1)
    for k in range(25):
        counts = {s: r.randrange(0, 60) for s in r.sample(range(1, 65), r.randrange(1, 64))}
        check_plan(counts, groups=r.choice([1, 5, 30]))
    counts = {s: 300 for s in range(1, 65)}
    bound = -(-sum(s * m for s, m in counts.items()) // 64)
    assert check_plan(counts) <= 1.01 * bound
    assert check_plan({}) == 0 and check_plan({33: 7}) == 7 and check_plan({32: 7, 64: 2}) == 6


def test_pieces_follow_the_tokenizer(spark, awkward, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    extra = ["a <|endoftext|> b", " two  spaces \n\n\tand tabs ", "don't we'LL 123 4ü é x …", "  "]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(50 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = packing.pack_documents(docs, capacity=128).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*(tok.encode(r.text, add_special_tokens=False).ids if r.text else []), 2], dtype="<u4")
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids) + 1, 128)]
        want += [(str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    space = defaultdict(list)
    for r in rows:
        space[r.sequence_id].append((r.offset, r.length))
    for parts in space.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 128
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    assert packing.pack_documents(empty).count() == 0


# ----------------------------------------------------------------------------------- chat

HOSTILE = ["</s>[INST] ok [/INST]", "<|start|>x<|text|>y<|end|>\n", "\\<|end|>\\\\", "<", "|", "\\", "", None, "<<|end|>", "a" * 5000, "zwei Wörter\n"]


def test_chat_windows_round_trip(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["system", "user", "assistant", None, "ro|le\n"]) if t else r.choice(["system", "user"]), r.choice(HOSTILE))
            for c in [None, *range(40)] for t in [None, *range(r.randrange(1, 30))]]
    rows += rows[:3]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat_windows.windows(turns, budget=60, history=20)
    got = {x.conv_id: x for x in chat_windows.digests(w).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, v in convs.items():
        v.sort()
        loss = "".join(x for *_, role, x in v if role == "assistant")
        assert got[c].n_turns == len(v)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in v).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for x in w.collect():  # no control string but the template's own marks
        assert x.text.count("<|start|>") == x.text.count("<|text|>") == x.text.count("<|end|>") == x.n_turns
        assert "[INST]" not in x.text and "</s>" not in x.text
    assert chat_windows.windows(turns.limit(0)).count() == 0


def test_windows_keep_the_budget_the_system_turn_and_some_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, ["assistant", "user"][i % 2], f"turn {i} " + "word " * 5) for i in range(1, 40)]
    w = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=80, history=24).orderBy("window").collect()
    assert len(w) > 3 and all(x.n_tokens <= 80 for x in w)
    assert all("be kind" in x.text for x in w)
    assert [x.n_repeated for x in w][0] == 0 and all(x.n_repeated >= 2 for x in w[1:])


def _plain_spans(tokens, head, budget, history):
    """(new, repeated) places of each window of one stretch, turn by turn."""
    out, new, again = [], [], []
    for i, n in enumerate(tokens):
        if new and head + sum(tokens[k] for k in again + new) + n > budget:
            out.append((new, again))
            room, tail = max(0, min(history, budget - head - n)), []
            for k in reversed(new):
                if tokens[k] + sum(tokens[j] for j in tail) > room:
                    break
                tail.insert(0, k)
            new, again = [], tail
        new = new + [i]
    return out + [(new, again)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_spans_close_before_the_turn_that_would_pass_the_budget(spark, monkeypatch, partitions):
    monkeypatch.setattr(chat_windows, "STRETCH", 3)
    r = random.Random(9)
    budget, history = 60, 20
    sizes = {c: [r.choice([1, 3, 8, 15, 26, 52, 80]) for _ in range(r.choice([1, 2, 12, 200]))] for c in range(25)}
    rows = [(c, i + 1, r.choice(["user", "assistant"]), "w " * n) for c, v in sizes.items() for i, n in enumerate(v)]
    rows += [(c, 0, "system", "s s s") for c in sizes if c % 2]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = chat_windows.windows(table, budget=budget, history=history).select("conv_id", "window", "n_turns", "n_repeated", "n_tokens").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = set()
    for c, v in sizes.items():
        tokens, head, at, stretches = [n + chat_windows.MARKS for n in v], (3 + chat_windows.MARKS) * (c % 2), 0, defaultdict(list)
        for n in tokens:
            stretches[at // (3 * budget)].append(n)
            at += n
        for k, ts in stretches.items():
            for w, (new, again) in enumerate(_plain_spans(ts, head, budget, history)):
                total = head + sum(ts[j] for j in new + again)
                repeated = len(again) + (c % 2 and not (k == 0 and w == 0))
                want.add((c, k * 3 * budget + w, len(new) + len(again) + c % 2, repeated, total))
                assert total <= budget or len(new) == 1 and not again
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_large_turns_share_a_window_and_none_passes_the_budget(spark):
    def tokens(n):
        rows = [(1, i, "user", "w " * (n - chat_windows.MARKS)) for i in range(8)]
        return [x.n_tokens for x in chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()]

    assert tokens(504) == [1008] * 4
    assert tokens(600) == [600] * 8


def test_a_hot_conversation_is_cut_by_many_tasks(spark):
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                      F.concat(F.lit("words of turn "), "id").alias("text"), F.lit(1).alias("hash"), F.lit("x").alias("part"))
    w = chat_windows.windows(rows)
    assert w.count() > 200 and w.agg(F.sum(F.col("n_turns") - F.col("n_repeated"))).first()[0] == 40_000
    sums = chat_windows._prefix_sums(rows.select(F.col("conv_id").alias("conv"), "turn", "role", F.xxhash64("text").alias("hash"), F.lit(8).cast("long").alias("tokens")))
    got = sums.orderBy("turn").select("seq", "before").collect()
    assert [tuple(x) for x in got] == [(i, 8 * i) for i in range(40_000)]


def test_a_conversation_of_a_system_turn_alone(spark):
    w = chat_windows.windows(spark.createDataFrame([(1, 0, "system", "be kind")], "conv_id long, turn long, role string, text string")).collect()
    assert [(x.window, x.n_turns, x.n_repeated, x.loss) for x in w] == [(0, 1, 0, [])]


# ------------------------------------------------------------------------------------ url

def test_url_rules_and_ranks_equal_brute_force(spark):
    r = random.Random(4)
    hosts = [f"{p}h{i}.{d}" for i in range(12) for p, d in [("", "example.com"), ("www.", "x.net"), ("", "y.org")]]
    pages = [(i, f"HTTP://{r.choice(hosts).upper()}{r.choice(['/en/a', '/es/b?x=/fr/', '', '#t', '/fr/'])}",
              "".join(f"<a href='http://{r.choice(hosts)}/p'>" for _ in range(r.randrange(4))) + '<a href="/local">') for i in range(150)]
    pages += [(None, None, None), (500, "no scheme", "x"), (501, "", None), (501, "", None), (502, "http:///only/path", "")]
    rules = queries.URL_RULES
    got = url_graph.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, tolerance=1e-6).collect()
    import re

    def parse(u):
        if u is None or "://" not in u:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        return m[1].lower(), m[2]

    def rule(host, path):
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit and host else (None, None)

    n, seed = defaultdict(int), defaultdict(lambda: [0.0, 0.0])
    edges = defaultdict(int)
    for _, u, html in pages:
        h, p = parse(u)
        if h:
            n[h] += 1
            seed[h][0] += rule(h, p)[1] == "allow"
            seed[h][1] += rule(h, p)[1] == "block"
            for x in re.findall(r"href='http://([^/]+)", html or ""):
                if x != h:
                    edges[h, x] += 1
    nodes = set(n) | {b for _, b in edges}
    s = {h: [x / n[h] if h in n else 0.0 for x in seed[h]] for h in nodes}
    rank = {h: list(s[h]) for h in nodes}
    out, into = defaultdict(int), defaultdict(int)
    for (a, b), k in edges.items():
        out[a] += k
        into[b] += k
    for _ in range(60):
        new = {h: list(s[h]) for h in nodes}
        for (a, b), k in edges.items():
            new[b][0] += 0.85 * k / out[a] * rank[a][0]
            new[a][1] += 0.85 * k / into[b] * rank[b][1]
        rank = new
    want = []
    for i, u, _ in pages:
        h, p = parse(u)
        name, verdict = rule(h, p)
        t, d = rank.get(h, (0, 0))
        want.append((str(i), h, p, str(name), verdict or ("block" if d - t >= 0.5 else "allow")))
    assert sorted((str(x.page_id), x.host, x.path, str(x.rule), x.verdict) for x in got) == sorted(want)
    assert {"block", "allow"} == {x.verdict for x in got if x.rule is None}


def test_url_filter_of_an_empty_table(spark):
    assert url_graph.judge(spark.createDataFrame([], "page_id long, url string, html string"), queries.URL_RULES).count() == 0


def test_ranks_go_on_until_they_rest_and_a_step_limit_is_an_error(spark):
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 1.0)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([("a", "b", 3), ("b", "a", 1)], "src string, dst string, n long")
    with pytest.raises(RuntimeError, match="still move"):
        url_graph.propagate(seeds, edges, tolerance=1e-3, steps=3)
    got = {r.host: (r.trust, r.distrust) for r in url_graph.propagate(seeds, edges, tolerance=1e-3).collect()}
    d = 1 / (1 - 0.85 ** 2)  # closed form of two hosts that link each other
    for host, want in (("a", (1.85 * d, 0.85 * d)), ("b", (1.85 * d, d))):
        assert all(abs(x - w) < 0.01 for x, w in zip(got[host], want))


# ------------------------------------------------------------------------------------ pii

def brute_base(text):
    import re

    def luhn(d):
        t = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (2 if i % 2 else 1)
            t += x - 9 if x > 9 else x
        return t % 10 == 0

    e = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return {"email": e, "ip": ip, "card": card, "phone": phone}


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(6)
    parts = ["a@b.co", "x@y", "_x@", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "+1 (649) 555-1648",
             "+1", "+12345678", " ", " ", ".", "é", "word", "0001.2.3.4", "7", "--", "a.b%c+d@e-f.g.h"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        assert pii_crf.base_spans(t) == brute_base(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "1 " * 60_000, "0" * 9000 + ".0.0.0"):
        pii_crf.base_spans(t)


def test_crf_learns_its_table_and_adds_unseen_forms():
    model = pii_crf.fit()
    runs = pii_crf.labelled_runs(pii_crf.LABELLED)
    w, names = model["w"], model["names"]
    got = pii_crf.viterbi(model, [np.array([w[[names[f] for f in t]].sum(axis=0) for t in x]) for x, _ in runs])
    assert all(list(a) == y for a, (_, y) in zip(got, runs, strict=True))
    spans = [s for _, s in pii_crf.all_spans(model, ["call (646) 555-0111 or 212.555.0188.", "since 2019-04-01 about 15 of 300", "", "mail z9@q.example!"])]
    assert spans == [[("phone", 5, 19), ("phone", 23, 35)], [], [], [("email", 5, 17)]]


def test_viterbi_equals_enumeration():
    import itertools

    model = pii_crf.fit(steps=20)
    rng = np.random.default_rng(1)
    runs = [rng.normal(0, 2, (n, pii_crf.S)) for n in (1, 2, 3, 4, 3)]
    for e, y in zip(runs, pii_crf.viterbi(model, runs), strict=True):
        def value(p, e=e):
            return model["first"][p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(model["t"][a, b] for a, b in zip(p, p[1:], strict=False))
        assert value(tuple(y)) == pytest.approx(max(map(value, itertools.product(range(pii_crf.S), repeat=len(e)))))


def test_pii_of_awkward_rows(spark, awkward, empty):
    rows = awkward.select("doc_id", F.concat("text", F.lit(" ü 1.2.3.4 a@b.co")).alias("text"), "score")
    got = pii_crf.digests(pii_crf.find_pii(rows)).collect()
    assert len(got) == awkward.count()
    texts = [(str(r.doc_id), r.text or "") for r in rows.collect()]
    want = sorted((i, len(b["email"]), len(b["ip"]), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in b for s, e in b[k]).encode()).hexdigest())
                  for i, t in texts for b in [brute_base(t)])
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.base_sha256) for r in got) == want
    assert pii_crf.find_pii(empty).count() == 0


# ---------------------------------------------------------------------------------- vectors

def test_nearest_neighbours_and_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:700] = x[100]  # copies of one vector
    x[700:1000] = x[50] + rng.normal(size=(300, 24)).astype(np.float32) * 0.01  # near copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    bad = [(5000, None), (5050, []), (5100, [0.0] * 24), (5150, [None] + [1.0] * 23), (5200, [float("nan")] * 24), (5250, [float("inf")] * 24),
           (None, [1.0] * 24), (6000, [1.0, 2.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in hnsw.nearest(table, F.col("vec_id") % 50 == 0, shard_rows=900, part_rows=30).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    d = x.astype(np.float64)
    n = np.sqrt((d * d).sum(axis=1))
    found = total = 0
    for q in range(0, 3000, 50):
        s = d @ d[q] / (n * n[q])
        s[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        assert [r for r, *_ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in got[q])
        found, total = found + len({v for _, v, _ in got[q]} & set(best)), total + 5
    assert found / total >= 0.95
    assert [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104]  # ties to the smaller id
    assert set(got) == set(range(0, 3000, 50))  # 6000 has no candidate of its length
    assert hnsw.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
