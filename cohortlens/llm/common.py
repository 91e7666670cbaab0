"""Shared helpers: scratch tables on the shared folder, checked broadcasts, text blocks, hashing."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Python stages in it get Arrow batches of ``batch_rows`` rows, for bounded memory.
    Cuts lineage: a lost executor re-reads files instead of recomputing what came before.
    The files go when the application ends (``scratch_path``)."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A few given rows as a table, from literals alone."""
    row = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, columns.items(), strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*row)))


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting: beyond ``max_rows`` the join stays a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


# ---- what outlives a task in its worker ----------------------------------------------------


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker.  Functions of this package travel by
    value, so their own module globals begin anew with every task."""
    name = "_cohortlens_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept


def tree_reduce(parts: DataFrame, combine, fan_in: int = 8, name: str = "tree") -> DataFrame:
    """Fold the fragments of every key in order: (key, seq, frag binary) -> (key, frag).

    ``combine`` maps a list of successive fragments to one and is associative.  A round joins
    ``fan_in`` neighbours of a key, so no task ever holds more of one key than that; rounds
    follow the longest key's number of fragments.  Every round is a table in the shared folder."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        frag = combine([v.as_py() for v in table.column("frag")])
        return pa.table({"key": table.column("key").slice(0, 1), "seq": table.column("seq").slice(0, 1),
                         "frag": pa.array([frag], pa.binary())})

    schema = "key string, seq long, frag binary"
    parts = written(parts.select("key", F.col("seq").cast("long").alias("seq"), "frag"), name)
    last = parts.agg(F.max("seq")).first()[0] or 0
    while last > 0:
        step = parts.select("key", F.floor(F.col("seq") / fan_in).alias("seq"), F.col("seq").alias("pos"), "frag")
        parts = written(step.groupBy("key", "seq").applyInArrow(run, schema), name)
        last //= fan_in
    return parts.select("key", "frag")


def text_blocks(column: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into row ranges of about ``max_bytes`` of UTF-8.

    Yields (first row, end row, bytes, row offsets into bytes); null texts are empty.  A
    longer text is a block of its own, whole."""
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if n == 0:
        return
    _, off_buf, data = arr.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[arr.offset:arr.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


# ---- hashing of words and shingles, vectorised over a block ------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TERM = np.zeros(256, dtype=bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if len(have) <= 1 << 20:
            _POWERS[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _edges(word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each maximal run of ``word`` bytes; runs end at row ends."""
    n = len(word)
    brk = np.zeros(n + 1, dtype=bool)
    brk[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | brk[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | brk[1:n]
    return np.flatnonzero(start), np.flatnonzero(end)


def _running(buf: np.ndarray) -> np.ndarray:
    acc = _BYTE[_LOWER[buf]]
    acc *= _powers("p", _P, len(buf))
    np.cumsum(acc, out=acc)
    return acc


def _span_hash(acc: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans s..e (inclusive), whatever their place."""
    h = acc[e] - np.where(s > 0, acc[s - 1], np.uint64(0))
    h *= _powers("i", _P_INV, len(acc))[s]
    return mix(h ^ (e - s).astype(np.uint64))


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of a block, A-Z lower-cased.

    Returns (hashes, first word of each row and the end): words never cross rows."""
    if len(buf) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    s, e = _edges(~_SPACE[buf], off)
    return _span_hash(_running(buf), s, e), np.searchsorted(s, off)


def term_hashes(buf: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the terms of a block: words of ASCII letters, digits and bytes over 127,
    A-Z lower-cased, and the leading ``prefixes`` bytes of longer words."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s, e = _edges(_TERM[buf], off)
    acc = _running(buf)
    row = np.searchsorted(off, s, side="right") - 1
    rows, hashes = [row], [_span_hash(acc, s, e)]
    for k in prefixes:
        long = e - s >= k
        rows.append(row[long])
        hashes.append(mix(_span_hash(acc, s[long], s[long] + k - 1) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(hashes)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a row's ``size``-word shingles; fewer words form one shingle; none, none."""
    if len(h) == 0:
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    acc = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        acc = mix(acc * _P + h[k:k + n])
    return acc
