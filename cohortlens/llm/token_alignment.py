"""Alignment of two tokenizers' tokens by an associative fragment monoid (operator 11).

Vocabulary A (byte-level BPE) encodes a space and the text, vocabulary B (pieces, which adds that space itself)
the text.  Byte offsets where tokens of both end cut the tokens into groups; an A and a B token are linked if their
byte ranges overlap.

A byte-range chunk of a text yields a fragment: an open prefix (tokens up to the first common
end), closed groups, an open suffix (tokens after the last common end).  Two neighbouring fragments
compose by closing the group of the left one's suffix and the right one's prefix; a fragment without a
common end is all prefix.  This is associative, so the fragments of a long text are folded by a tree
over Spark tasks (``tree_reduce``); a text up to ``CHUNK`` characters is a single chunk.

Chunks begin and end anywhere.  A token belongs to the chunk it ends in; to get it exactly, a chunk
carries the characters back and on to the nearest place where both tokenizers cut for certain: a space
after a character that is no white space (no piece of B has a space after other characters; this is checked
when the file is read).  A chunk end further than ``REACH`` from such a place moves to the next one.

How many documents hold a pair of ids linked is counted by one aggregation over the documents' distinct pairs, which
are kept as a table, and joined back to them; the counts are broadcast below a checked number of rows.

Defined results: a text that is null or empty, or whose tokens of A or B do not spell a space and the text, has no
tokens: zeros and '' for the digest; rows with null or repeated ids are documents each for itself; equal
long texts are aligned once; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, tree_reduce, worker_cache, written

CHUNK = 1 << 16
REACH = 1 << 12
BLOCK = 1 << 19
ID_BITS = 18
KEPT_UNITS = 200_000
COUNT_ROWS = 2_000_000  # counts are broadcast up to here: two longs and a flag each

_SAFE = re.compile(r"(?<=\S) ")
_UNIT = re.compile(r" +[^ ]*")


class _Units(dict):
    """Ids of B for a run of spaces and what follows up to the next space; None if they spell it differently."""

    def __init__(self, model, spelt: list[bytes]):
        self.model, self.spelt, self.space = model, spelt, model.piece_to_id("▁")

    def __missing__(self, unit: str):
        ids = self.model.encode(unit[1:]) if len(unit) > 1 else [self.space]
        if b"".join(map(self.spelt.__getitem__, ids)) != unit.encode():
            ids = None
        if len(unit) < 200:
            if len(self) >= KEPT_UNITS:
                self.clear()
            self[unit] = ids
        return ids


class Aligner:
    """Both vocabularies, alignment of token lists, and the monoid of fragments."""

    def __init__(self, bytes_file: str, pieces_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(re.sub(r"\.json$", ".tiktoken", bytes_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a_code = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_spelt = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_spelt[i] = token
        model = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece with a space inside: texts cannot be cut at spaces")
        b_spelt = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        if max(len(self.a_spelt), len(b_spelt)) > 1 << ID_BITS:
            raise ValueError("a vocabulary of too many ids")
        self.units = _Units(model, b_spelt)
        self.a_len = np.array([len(t) for t in self.a_spelt])
        self.b_len = np.array([len(t) for t in b_spelt])
        top = max(len(self.a_spelt), len(b_spelt))
        self.written = [f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(top)]
        self.top = top

    def encode(self, span: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B of a span that begins with a space at a certain cut; None if one spells it differently."""
        if not span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = self.a_code.encode_ordinary(span)
        units = self.units
        b = [units[u] for u in _UNIT.findall(span)]
        if None in b or b"".join(map(self.a_spelt.__getitem__, a)) != span.encode():
            return None
        return np.array(a, np.int64), np.array([i for ids in b for i in ids], np.int64)

    def closed(self, a: np.ndarray, b: np.ndarray, a_text: np.ndarray, b_text: np.ndarray) -> tuple:
        """Align whole groups of texts, given by ids and the text of each token (in order).

        Returns (groups of each text as written tokens, first written token of each text, number of groups and
        links by text, and text, pair and times of each distinct pair)."""
        n_texts = int(a_text[-1]) + 1 if len(a) else 0
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        if not len(a):
            none = np.zeros(0, np.int64)
            return [], np.zeros(1, np.int64), none, none, none, none, none
        at = np.searchsorted(b_end, a_end)
        a_cut = b_end[at] == a_end
        b_cut = np.zeros(len(b), bool)
        b_cut[at[a_cut]] = True
        # places of tokens when every group writes its A tokens, then its B tokens
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        a_until, b_until = np.flatnonzero(a_cut) + 1, np.flatnonzero(b_cut) + 1
        b_before = np.append(0, b_until[:-1])
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + b_before[a_group]] = a + np.where(a_cut, self.top, 0)
        b_last = np.zeros(len(b), bool)
        b_last[np.searchsorted(b_text, np.arange(n_texts), side="right") - 1] = True
        codes[np.arange(len(b)) + a_until[b_group]] = b + np.where(b_last, 3, np.where(b_cut, 2, 0)) * self.top
        first = np.searchsorted(a_text, np.arange(n_texts + 1)) + np.searchsorted(b_text, np.arange(n_texts + 1))
        strings = list(map(self.written.__getitem__, codes.tolist()))
        # links: each A token with the B tokens from the one over its first byte to the one over its last
        low = np.searchsorted(b_end, a_end - self.a_len[a], side="right")
        n = at - low + 1
        link_a = np.repeat(np.arange(len(a)), n)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + low[link_a]
        pair = a[link_a] << ID_BITS | b[link_b]
        distinct, times = np.unique(a_text[link_a] << 2 * ID_BITS | pair, return_counts=True)
        groups = np.bincount(a_text[a_cut], minlength=n_texts)
        links = np.bincount(a_text, weights=n, minlength=n_texts).astype(np.int64)
        return strings, first, groups, links, distinct >> 2 * ID_BITS, distinct & ((1 << 2 * ID_BITS) - 1), times

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, pairs, times) of every text."""
        out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
        made = [(i, self.encode(" " + t)) for i, t in enumerate(texts) if t]
        made = [(i, m) for i, m in made if m is not None]
        if not made:
            return out
        sizes = [(len(a), len(b)) for _, (a, b) in made]
        number = np.arange(len(made))
        a_text, b_text = (np.repeat(number, [s[k] for s in sizes]) for k in (0, 1))
        a, b = (np.concatenate([m[k] for _, m in made]) for k in (0, 1))
        strings, first, groups, links, owner, pair, times = self.closed(a, b, a_text, b_text)
        cut = np.searchsorted(owner, np.arange(len(made) + 1)).tolist()
        for k, (i, _) in enumerate(made):
            digest = hashlib.sha256("".join(strings[first[k]:first[k + 1]]).encode()).hexdigest()
            out[i] = (*sizes[k], int(groups[k]), int(links[k]), digest, pair[cut[k]:cut[k + 1]], times[cut[k]:cut[k + 1]])
        return out

    # ---- fragments: (ok, has a common end, head, tail, groups as written, n_a, n_b, n_groups, n_links, pairs, times)

    def fragment(self, before: str, body: str, after: str) -> dict:
        """The fragment of a chunk with the characters around it up to certain cuts."""
        made = self.encode(before + body + after)
        if made is None:
            return {"ok": False}
        a, b = made
        lo = len(before.encode())
        hi = lo + len(body.encode())
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_own, b_own = (a_end > lo) & (a_end <= hi), (b_end > lo) & (b_end <= hi)
        a, b, a_end, b_end = a[a_own], b[b_own], a_end[a_own], b_end[b_own]
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        none = np.zeros(0, np.int64)
        frag = {"ok": True, "cut": len(shared) > 0, "head": (a, b), "tail": (none, none), "n_a": len(a), "n_b": len(b),
                "body": self._whole(none, none)}
        if len(shared):
            x, y = (np.searchsorted(e, [shared[0], shared[-1]], side="right") for e in (a_end, b_end))
            frag["head"], frag["tail"] = (a[:x[0]], b[:y[0]]), (a[x[1]:], b[y[1]:])
            frag["body"] = self._whole(a[x[0]:x[1]], b[y[0]:y[1]])
        return frag

    def _whole(self, a: np.ndarray, b: np.ndarray) -> tuple:
        """(written, groups, links, pairs, times) of closed groups of one text."""
        strings, _, groups, links, _, pair, times = self.closed(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64))
        return "".join(strings), int(groups.sum()), int(links.sum()), pair, times

    @staticmethod
    def _joined(parts: list[tuple]) -> tuple:
        pair, at = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([p[4] for p in parts]), minlength=len(pair)).astype(np.int64)
        return ";".join(p[0] for p in parts if p[0]), sum(p[1] for p in parts), sum(p[2] for p in parts), pair, times

    def compose(self, left: dict, right: dict) -> dict:
        """The fragment of two neighbouring chunks."""
        if not (left["ok"] and right["ok"]):
            return {"ok": False}

        def join(x, y):
            return tuple(np.concatenate(p) for p in zip(x, y))

        out = {"ok": True, "cut": left["cut"] or right["cut"], "n_a": left["n_a"] + right["n_a"], "n_b": left["n_b"] + right["n_b"],
               "head": left["head"], "tail": right["tail"]}
        if not right["cut"]:
            side = "tail" if left["cut"] else "head"
            out["tail"] = left["tail"]
            out[side] = join(left[side], right["head"])
            out["body"] = left["body"]
        elif not left["cut"]:
            out["head"] = join(left["head"], right["head"])
            out["body"] = right["body"]
        else:
            out["body"] = self._joined([left["body"], self._whole(*join(left["tail"], right["head"])), right["body"]])
        return out

    def finished(self, frag: dict) -> tuple:
        """Like a row of ``align``, from the fragment of a whole text."""
        if not frag["ok"]:
            return 0, 0, 0, 0, "", [], []
        written_, groups, links, pair, times = self._joined([self._whole(*frag["head"]), frag["body"], self._whole(*frag["tail"])])
        return frag["n_a"], frag["n_b"], groups, links, hashlib.sha256(written_.encode()).hexdigest(), pair, times


def chunks_of(text: str, chunk: int = CHUNK, reach: int = REACH) -> list[tuple[str, str, str]]:
    """(characters before back to a certain cut, chunk, characters after up to one) of a space and the text."""
    text = " " + text
    edges = [(0, 0, 0)]  # place, certain cut at or before it, certain cut at or after it
    while edges[-1][0] + chunk < len(text):
        at = edges[-1][0] + chunk
        back = [m.start() for m in _SAFE.finditer(text, max(1, at - reach), at + 1)]
        found = _SAFE.search(text, at)
        after = found.start() if found else len(text)
        near = back and back[-1] > edges[-1][0] and after <= at + reach
        edges.append((at, back[-1], after) if near else (after, after, after))
    if edges[-1][0] < len(text):
        edges.append((len(text),) * 3)
    return [(text[p0:x], text[x:y], text[y:p1]) for (x, p0, _), (y, _, p1) in zip(edges, edges[1:])]


def aligner(files: tuple[str, str]) -> Aligner:
    kept = worker_cache()
    if ("token_alignment", files) not in kept:
        kept["token_alignment", files] = Aligner(*files)
    return kept["token_alignment", files]


def default_files() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_RESULT = ", ".join(f"{c} long" for c in _NUMBERS) + ", groups_sha256 string, pairs array<long>, times array<long>"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.string())]
    return cols + [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (5, 6)]


_NAMES = [*_NUMBERS, "groups_sha256", "pairs", "times"]


def _align_short(rows: DataFrame, files: tuple[str, str]) -> DataFrame:
    def run(batches):
        tool = aligner(files)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            made, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                    size += len(texts[j])
                    j += 1
                made += tool.align(texts[i:j])
                i = j
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(made)], names=["__id", *_NAMES])

    return rows.mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, {_RESULT}")


def align_long(texts: DataFrame, files: tuple[str, str], chunk: int = CHUNK) -> DataFrame:
    """(key, text) of long texts -> (key, results): chunks, their fragments and a tree of compositions."""
    def cut(batches):
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = chunks_of(text, chunk)
                cols = [pa.array([key] * len(found)), pa.array(range(len(found)), pa.int64())]
                cols += [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "seq", "before", "body", "after"])

    def fragments(batches):
        tool = aligner(files)
        for b in batches:
            made = [pickle.dumps(tool.fragment(*f)) for f in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["key", "seq", "frag"])

    def combine(frags):
        tool = aligner(files)
        made = pickle.loads(frags[0])
        for f in frags[1:]:
            made = tool.compose(made, pickle.loads(f))
        return pickle.dumps(made)

    def finish(batches):
        tool = aligner(files)
        for b in batches:
            made = [tool.finished(pickle.loads(f)) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(made)], names=["key", *_NAMES])

    chunks = texts.mapInArrow(cut, "key string, seq long, before string, body string, after string")
    # chunks of equal texts are equal: one of them is kept, on the map side already
    chunks = chunks.groupBy("key", "seq").agg(*[F.first(c).alias(c) for c in ("before", "body", "after")])
    whole = tree_reduce(chunks.mapInArrow(fragments, "key string, seq long, frag binary"), combine, name="token-fragments")
    return whole.mapInArrow(finish, f"key string, {_RESULT}")


def aligned_rows(docs: DataFrame, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id_col, numbers, digest, and the distinct linked pairs (A id << 18 | B id) with
    how often each is linked."""
    files = files or default_files()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    short = _align_short(rows.where(F.coalesce(F.length("__text"), F.lit(0)) <= chunk), files)
    longer = rows.where(F.length("__text") > chunk).withColumn("key", F.sha2("__text", 256))
    found = align_long(longer.select("key", "__text"), files, chunk)
    return short.unionByName(longer.select("__id", "key").join(found, "key").drop("key")).withColumnRenamed("__id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (no pair of its A id has more)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = written(counts.withColumn("a", F.shiftright("pair", ID_BITS)), "token-pairs")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = aligned_rows(docs, files, id_col, text_col, chunk).withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows, "token-alignment")  # numbers of rows are fixed from here on
    counts = broadcast_if_small(written(pair_counts(rows), "token-pair-counts"), COUNT_ROWS)
    links = rows.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("__row", "l.pairs", "l.times")
    sums = links.join(counts, links.pairs == counts.pair).groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "__row", "left").select(
        id_col, *_NUMBERS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
