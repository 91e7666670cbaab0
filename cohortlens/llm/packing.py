"""Best-fit packing by the linear grouping scheme (operator 8).

Documents become token ids (a public byte-level BPE vocabulary plus an end id); only those
longer than a sequence are cut.  Pieces are packed into sequences of ``capacity`` tokens:

1. one shuffle-light count of pieces per length: a table of at most ``capacity`` rows, whatever
   the size of the corpus, is all that the driver sees;
2. lengths over ``small`` are put into ``groups`` groups of equal cardinality, in falling
   order, and rounded up to the largest of their group;
3. the few rounded sizes are packed by configurations (patterns of sizes in one sequence): the
   fractional optimum by column generation with a knapsack, rounded down;
4. actual lengths are substituted group by group in falling order, the last place of a
   configuration by the largest piece that fits what the rounding left free.  That
   shifts the groups, so half of each configuration is used at a time and steps 2 to 4 repeat on
   the rest, until a few pieces per group are left;
5. these, and then the small ones, go by best fit into the space that remains.

The plan is a list of intervals (length, first rank, last rank -> first sequence, offset),
whose number depends on the capacity and not on the data, so it is broadcast.  A piece finds
its sequence by its rank among the pieces of its length; ranks are counted in hashed
buckets, so that a hot length is spread over many tasks.

Defined results: a null or empty text is its end id alone (one piece of length 1); rows with
null or repeated ids are packed like any other, each row apart; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 200_000


# ------------------------------------------------------------------------- token ids

_TWO_SPACES = re.compile(r"\s\s")


def encoder(vocabulary: str):
    """text -> uint32 ids of the vocabulary file (a ``.tiktoken`` list of ranks or a
    ``.json`` of byte-level BPE beside such a list).

    The ranks give the same ids as the JSON of the same name (tests compare them); runs of
    white space need the pattern's look-ahead, other texts take the equal pattern without it,
    which is twice as fast.  The special string keeps its id 50256 in texts."""
    import public_tokenizers
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_encoders_by_file", {})  # outlives a task in its worker
    if vocabulary not in kept:
        ranks_file = re.sub(r"\.json$", ".tiktoken", vocabulary)
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": 50256}
        full = public_tokenizers.PATTERN
        plain = full.replace(r"|\s+(?!\S)|\s+", r"|\s")
        both = [tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens=special)
                for n, p in (("full", full), ("plain", plain))]

        def encode(text: str) -> np.ndarray:
            return both[not _TWO_SPACES.search(text)].encode_to_numpy(text, allowed_special="all").astype("<u4")

        kept[vocabulary] = encode
    return kept[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 (and ids)."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        encode = encoder(vocabulary)
        for b in batches:
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                ids = np.append(encode(text) if text else np.zeros(0, "<u4"), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[x:y].tobytes()
                    at.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(part))
                    kept.append(part if keep_ids else None)
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


# ------------------------------------------------------------------------------ plan

class _Bins:
    """Open sequences by remaining space; runs of equal sequences are kept as ranges."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.plan = capacity, 0, []
        self.space: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def open(self, n: int) -> int:
        first, self.next = self.next, self.next + n
        return first

    def place(self, length: int, rank: int, n: int, seq: int, offset: int) -> None:
        self.plan.append((length, rank, rank + n, seq, offset))

    def best_fit(self, length: int, rank: int, n: int) -> None:
        """Put n pieces of a length, from a rank on, where the least space is left over."""
        for room in range(length, self.capacity + 1):
            have = self.space[room]
            while n and have:
                seq, m = have.pop()
                k = min(n, m)
                if k < m:
                    have.append((seq + k, m - k))
                self.place(length, rank, k, seq, self.capacity - room)
                self.space[room - length].append((seq, k))
                rank, n = rank + k, n - k
            if not n:
                return
        per = self.capacity // length
        for bins, each in ((n // per, per), (1 if n % per else 0, n % per)):
            if bins:
                seq = self.open(bins)
                for k in range(each):
                    self.place(length, rank, bins, seq, k * length)
                    rank += bins
                self.space[self.capacity - each * length].append((seq, bins))


def _patterns(sizes: list[int], need: list[int], capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each: the fractional optimum rounded down."""
    k, need = len(sizes), np.array(need, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = need / np.diag(basis)
    for _ in range(rounds):
        y = np.linalg.solve(basis.T, np.ones(k))
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = np.array(sizes)
        for c in range(int(order.min()), capacity + 1):  # unbounded knapsack over the duals
            fit = order <= c
            v = np.where(fit, y + best[np.maximum(c - order, 0)], -1.0)
            i = int(v.argmax())
            best[c], took[c] = (v[i], i) if v[i] > best[c - 1] else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        col, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                col[took[c]] += 1
                c -= sizes[took[c]]
        d = np.linalg.solve(basis, col)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        basis[:, out] = col
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if x[j] + 1e-9 >= 1]


def _groups(falling: list[int], have: list[int], groups: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Equal-cardinality groups of falling lengths: (rounded size, pieces, lengths) of each."""
    total, filled, cut = sum(have), 0, 0
    out: dict[int, list] = {}  # a hot length can fill whole groups: these are one
    for s, n in zip(falling, have, strict=True):
        while n:
            if filled >= cut:
                size = s
                cut = total * (1 + filled * groups // total) // groups + 1
            k = min(n, cut - filled)
            group = out.setdefault(size, [0, []])
            group[0] += k
            group[1].append(s)
            filled, n = filled + k, n - k
    return list(out), [n for n, _ in out.values()], [m for _, m in out.values()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 30, small: int | None = None) -> tuple[list[tuple], int]:
    """(intervals (length, first rank, end rank, first sequence, offset), number of sequences)."""
    small = capacity // 3 if small is None else small
    bins = _Bins(capacity)
    used = dict.fromkeys(counts, 0)  # ranks given so far, by length
    if counts.get(capacity):
        bins.place(capacity, 0, counts[capacity], bins.open(counts[capacity]), 0)

    def take(length: int, parts: list, after: list) -> list:
        """Give pieces of a length to the first of these runs of equal sequences."""
        rest = []
        for seq, n, room in parts:
            k = min(n, counts[length] - used[length])
            if k:
                bins.place(length, used[length], k, seq, capacity - room)
                used[length] += k
                after.append((seq, k, room - length))
            if n > k:
                rest.append((seq + k, n - k, room))
        return rest

    while True:
        falling = sorted((s for s, n in counts.items() if small < s < capacity and n > used[s]), reverse=True)
        sizes, need, members = _groups(falling, [counts[s] - used[s] for s in falling], groups)
        configurations = [(p, -(-k // 2)) for p, k in _patterns(sizes, need, capacity)] if sum(need) > 64 * groups else []
        if not configurations:
            break
        for pattern, times in configurations:
            slots = [g for g in range(len(sizes)) for _ in range(pattern[g])]
            first = min(times, sum(counts[s] - used[s] for s in members[slots[0]]))
            parts = [(bins.open(first), first, capacity)]
            for g in slots[:-1]:
                after: list = []
                for s in members[g]:
                    parts = take(s, parts, after)
                parts = after + parts
            done: list = []  # the last slot takes the largest that fits the actual space
            for s in falling:
                fits = [x for x in parts if x[2] >= s]
                if fits and used[s] < counts[s]:
                    parts = [x for x in parts if x[2] < s] + take(s, fits, done)
            for seq, n, room in done + parts:
                bins.space[room].append((seq, n))
    for s in sorted(counts, reverse=True):
        if s < capacity and counts[s] > used[s]:
            bins.best_fit(s, used[s], counts[s] - used[s])
    return bins.plan, bins.next


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (a written table: it is read three times) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    intervals, _ = plan(counts, capacity)
    buckets = 16 + sum(counts.values()) // BUCKET_ROWS
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    per = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = per.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    place = F.row_number().over(W.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32"))
    ranked = (rows.withColumn("place", place).join(base, ["length", "bucket"])
              .withColumn("rank", F.col("base") + F.col("place") - 1))
    table = spark.createDataFrame([tuple(map(int, i)) for i in intervals], "at long, lo long, hi long, seq long, offset long")
    found = ranked.join(F.broadcast(table), (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.withColumn("sequence_id", F.col("seq") + F.col("rank") - F.col("lo")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **tokens) -> DataFrame:
    """Cut, count and pack all documents; one row per piece."""
    return pack(written(pieces_of(docs, capacity=capacity, **tokens), "packing-pieces"), capacity,
                tokens.get("id_col", "doc_id"))
