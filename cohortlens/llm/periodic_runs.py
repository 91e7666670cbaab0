"""Periodic runs of words by maximal-pair enumeration (operator 12).

A run is a stretch of consecutive words with smallest period q and at least ``max(MIN_LENGTH,
MIN_EXPONENT * q)`` words that no neighbouring word extends.  Such a run (start, length, q) is the pair of
equal stretches of length - q words that begin at start and start + q, differ in the words on their
left and in those on their right: a maximal pair whose distance is at most a third of its length.

Per text, words get numbers, and

1. places whose ``SEED`` words occur again in the text are found by one sort of hashes; shorter
   repeats cannot belong to a run, so texts without such places are done;
2. the other texts get a suffix array by prefix doubling and the lengths of common prefixes
   between neighbours (numpy and one linear scan);
3. the LCP-interval tree is walked bottom up, down to nodes of ``SEED`` words.  A node of length l keeps its places
   in order, each with its left word (its class); a smaller child is merged into the larger one's
   list.  Places of one node within l/3 of each other form an arithmetic progression in which
   all but the first have the same left word, so two look-ups in the list find every pair of
   different children, different classes and distance up to l/3: the maximal pairs that are runs,
   without any extension.  Pairs of a multiple of a run's period have its start and end; the smallest distance stays.

Work is O(n log n) numpy sorting plus O(n) Python steps on texts that do repeat.  One pass over the table in Arrow
batches, no shuffle; a text is held by one task as numbers of its words.

Defined results: a null, empty or blank text has no words, no runs and collapses to the empty
text; ties for the longest run go to the smallest start, then period; rows with null or repeated ids are
judged each for itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT, SEED = 6, 4, 5


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers from 0."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def repeated_seeds(ids: np.ndarray) -> np.ndarray:
    """Places whose next ``SEED`` words occur elsewhere in the text, too (a hash may add places, never lose one)."""
    n = len(ids) - SEED + 1
    if n < 2:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(SEED):
        h = (h + ids[k:k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.flatnonzero(hit)


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the end of the text comes before every word."""
    n = len(ids)
    rank, k = ids + 1, 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:] if k < n else 0
        pair = rank * (n + 2) + second
        order = np.argsort(pair, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 1
        step[1:] = pair[order[1:]] != pair[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank.max() == n:
            return order
        k *= 2


def common_prefixes(ids: np.ndarray, order: np.ndarray) -> list[int]:
    """For each place in the suffix array but the first, the words it shares with the one before."""
    n = len(ids)
    words, suffixes = ids.tolist(), order.tolist()
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    out, h = [0] * n, 0
    for i, r in enumerate(at.tolist()):
        if r == 0:
            h = 0
            continue
        j = suffixes[r - 1]
        top = n - max(i, j)
        while h < top and words[i + h] == words[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def _pairs_between(small: list[int], large: list[int], left: list[int], length: int, found: dict) -> None:
    """Maximal pairs of a place in each of two children of a node, at most length / 3 apart."""
    reach = length // (MIN_EXPONENT - 1)
    for p in small:
        lo, at = bisect_left(large, p - reach), bisect_left(large, p)
        if lo < at and left[large[lo]] != left[p]:  # only the first of a progression differs
            _note(large[lo], p, length, found)
        if at < len(large) and large[at] <= p + reach and left[large[at]] != left[p]:
            for x in large[at:bisect_right(large, p + reach)]:  # p is the first of a progression
                _note(p, x, length, found)


def _note(i: int, j: int, length: int, found: dict) -> None:
    period = j - i
    if length + period >= MIN_LENGTH:
        key = (i, length + period)
        found[key] = min(period, found.get(key, period))


def _merge(a: list[int], b: list[int], left: list[int], length: int, found: dict) -> list[int]:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    _pairs_between(small, large, left, length, found)
    if len(small) * 16 > len(large):
        return sorted(large + small)
    for p in small:
        insort(large, p)
    return large


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    seeds = repeated_seeds(ids)
    if len(seeds) == 0:
        return []
    order = suffix_order(ids)
    lcp = common_prefixes(ids, order)
    left = [-1, *ids[:-1].tolist()]  # the class of each place: its left word
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, list[int]]] = []  # open nodes: length, places in order
    # nodes of under SEED words are too short for a run and are not opened
    for place, shared in zip(order.tolist(), lcp[1:] + [0]):
        current = [place]
        while stack and stack[-1][0] > shared:
            length, places = stack.pop()
            current = _merge(places, current, left, length, found)
        if shared >= SEED:
            if stack and stack[-1][0] == shared:
                length, places = stack.pop()
                current = _merge(places, current, left, length, found)
            stack.append((shared, current))
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def _judged(words: list[bytes]) -> tuple:
    found = runs(numbered(words)) if len(words) >= MIN_LENGTH else []
    start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), start, length, period, 1000 * length // period if found else None,
            hashlib.sha256(text.encode()).hexdigest(), b" ".join(collapsed(words, found)), found)


def repeat_words(words: list[bytes], seed: int) -> list[bytes]:
    """The contract's stand-in text of an id whose hash is ``seed``: of every tenth id, the words from a on repeat with period p."""
    n = len(words)
    if seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[:n - a]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: Column | None = None,
              keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, n_runs, the longest run (start, length, period, exponent_milli),
    runs_sha256, collapsed_sha256; with ``keep_text`` also the runs themselves and the collapsed text.

    ``seed`` (a long column) has ``repeat_words`` applied to each text first; null leaves it as it is."""
    def run(batches):
        for b in batches:
            rows = []
            for text, s in zip(b.column(1), b.column(2).to_pylist()):
                words = (text.as_py() or "").encode().split()
                rows.append(_judged(words if s is None else repeat_words(words, s)))
            cols = [b.column(0)] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            cols += [pa.array([r[5] for r in rows], pa.string()),
                     pa.array([hashlib.sha256(r[6]).hexdigest() for r in rows], pa.string())]
            if keep_text:
                cols += [pa.array([[dict(zip(("start", "length", "period"), f)) for f in r[7]] for r in rows], runs_type),
                         pa.array([r[6].decode() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    runs_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    names = ["__id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    names += ["runs", "collapsed"] if keep_text else []
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"),
                       (F.lit(None) if seed is None else seed).cast("long").alias("__seed"))
    id_type = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {id_type}, " + ", ".join(f"{c} long" for c in names[1:6]) + ", runs_sha256 string, collapsed_sha256 string"
    if keep_text:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
