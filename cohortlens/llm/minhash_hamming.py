"""MinHash near-dedup by a multi-index Hamming join (operator 10).

A document's set holds its distinct w-word shingles.  Its signature has ``components`` MinHash
values cut to 16 bits; the distance of two signatures is the number of differing components.
Two sets of similarity s differ in about (1 - s) of them, so all pairs of at least the
threshold lie, but for a probability under about 1e-5, within

    r = components * (1 - s) + 4.7 standard deviations.

The signature is cut into m = ceil((r + 1) / 2) chunks: by the pigeonhole principle, two
signatures within r differ in at most one component of some chunk.  Chunk errors are
enumerated by leaving out one component of the chunk in turn, so such a pair shares a key
(of 48 bits or more: unlike texts meet by chance only beyond any real corpus);
every pair within r is a candidate.  Candidates within a wider distance (6.5 standard
deviations, so that no likely link goes) are confirmed on their full sets.

Shape of the job (nothing expands into all pairs of a group of copies):

* documents of equal sets are one class, represented by its smallest id (map-side combine);
* classes that share a key are first linked as a star to the key's smallest id, confirmed,
  and joined into components;
* then only pairs of classes of different components remain.  In keys of up to
  ``SMALL_KEY`` classes they are joined directly; classes of larger keys go through an exact
  prefix-filter join instead: a pair over the threshold must share one of the rarest shingles
  of either (the first ``n - ceil(s * n) + 1`` by the count of their hash bucket), with enough shingles behind it,
  and the parities of the sets over ``PARITIES`` hash places may differ in no more places than sets of the
  threshold have shingles apart (no pair over the threshold does, so nothing is lost);
* components by alternating large-star and small-star steps on tables in the shared folder.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; rows with a null id are returned with a null component and kept; rows that share an
id are the same node (each row's set counts); an empty table gives an empty table.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, mix, shingle_hashes, text_blocks, word_hashes, written

COMPONENTS = 64
SMALL_KEY = 24
BUCKETS, SLICES = 1 << 20, 64
EARLIER = 48  # shingles before a shared one that are searched for an earlier shared one
PARITIES = 1024  # bits of the parity sketch of a set
_RNG = np.random.default_rng(77)
_MUL = _RNG.integers(0, 1 << 64, 1024, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, 1024, dtype=np.uint64)


def reach(components: int, similarity: float, deviations: float) -> int:
    """Distance that pairs of a similarity exceed only beyond so many standard deviations."""
    p = 1 - similarity
    return math.ceil(components * p + deviations * math.sqrt(components * p * (1 - p)))


def chunks(components: int, similarity: float) -> list[tuple[int, int]]:
    """(start, length) of the chunks that guarantee the distance threshold."""
    r = reach(components, similarity, 4.7)
    m = min(-(-(r + 1) // 2), components // 2)
    cuts = [components * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signature(s: np.ndarray, components: int) -> bytes:
    """16 bits of the minimum of each of ``components`` hash functions over a set."""
    low = np.full(components, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 4096):
        v = np.multiply.outer(_MUL[:components], s[i:i + 4096])
        v += _ADD[:components, None]
        np.minimum(low, v.min(axis=1), out=low)
    return ((low >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _sets(batch: pa.RecordBatch, size: int):
    """(row, sorted distinct shingle hashes) of a batch whose second column is the text."""
    for i, _j, buf, off in text_blocks(batch.column(1)):
        h, first = word_hashes(buf, off)
        for k in range(len(off) - 1):
            yield i + k, np.unique(shingle_hashes(h[first[k]:first[k + 1]], size))


def _signatures(size: int, components: int):
    def run(batches):
        for b in batches:
            n, k1, k2, sig = [], [], [], []
            for _, s in _sets(b, size):
                n.append(len(s))
                k1.append(np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0))
                k2.append(s.sum(dtype=np.uint64))
                sig.append(signature(s, components) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)),
                 pa.array(np.array(k2, np.uint64).view(np.int64)), pa.array(sig, pa.binary())],
                names=["id", "n_shingles", "k1", "k2", "sig"])
    return run


def _set_rows(size: int):
    def run(batches):
        for b in batches:
            sets = [s.astype(np.uint64).tobytes() for _, s in _sets(b, size)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "s"])
    return run


def _confirm(num: int, den: int):
    """Keep the pairs whose full sets reach the threshold, in integers."""
    def run(batches):
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            sa, sb = b.column("sa"), b.column("sb")
            for i in range(len(b)):
                x = np.frombuffer(sa[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(sb[i].as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if len(x) and den * len(x) >= num * len(y):
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    common = int((y[at] == x).sum())
                    keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield b.select(["a", "b"]).filter(pa.array(keep))
    return run


def _near(reach: int):
    """Keep the pairs whose signatures differ in at most ``reach`` components."""
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(len(b), -1) for c in ("ga", "gb"))
            yield b.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= reach))
    return run


def _links(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int, name: str) -> DataFrame:
    """Of candidate pairs (a, b), those confirmed on full sets, as a written table."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = broadcast_if_small(ids)  # texts move only if there are too many ids to send to them
    sets = written(docs.join(ids, "id", "left_semi").mapInArrow(_set_rows(size), "id long, s binary"), f"{name}-sets")
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb"))
    return written(both.mapInArrow(_confirm(num, den), "a long, b long").distinct(), f"{name}-links")


def components_of(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): component = smallest id reachable.

    Alternates large-star and small-star until no edge changes; a hub's edges are reduced by
    a partial minimum and joined back, so AQE can split a hub."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, name)

    def fingerprint(x):
        row = x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = None
    now = fingerprint(e)
    while now != before and now[0]:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                             F.col("m").alias("v")).where("u <> v").distinct())
        e = written(small, name)
        before, now = now, fingerprint(e)
    return (e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
            .union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
            .groupBy("id").agg(F.min("component").alias("component")))


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return entries.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    threshold: tuple[int, int] = (80, 100), components: int = COMPONENTS) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept (module docstring)."""
    num, den = threshold
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = written(d.mapInArrow(_signatures(shingle, components),
                                "id long, n_shingles long, k1 long, k2 long, sig binary"), "near-signatures")
    classes = (sigs.where("n_shingles > 0 and id is not null").groupBy("n_shingles", "k1", "k2")
               .agg(F.min("id").alias("id"), F.min("sig").alias("sig")))
    classes = written(classes, "near-classes")
    keys = [F.xxhash64(F.lit(start * 64 + i), F.substring("sig", 2 * start + 1, 2 * i),
                       F.substring("sig", 2 * (start + i) + 3, 2 * (length - i - 1)))
            for start, length in chunks(components, num / den) for i in range(length)]
    entries = classes.select("id", F.col("n_shingles").alias("n"), F.explode(F.array(*keys)).alias("key"))
    shared = (entries.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub"))
              .where("size > 1"))
    entries = written(entries.join(shared, "key"), "near-keys")
    texts = d.where("id is not null")

    # two sets of sizes x <= y can only reach the threshold if x / y does
    fits = "{den} * least(n, n2) >= {num} * greatest(n, n2)".format(num=num, den=den)
    hubs = entries.where("id = hub").select("key", F.col("n").alias("n2")).dropDuplicates(["key"])
    star = entries.where("id <> hub").join(hubs, "key").where(fits).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    near = _near(reach(components, num / den, 6.5))

    def within(pairs):  # wider than the guaranteed distance: only hopeless pairs go
        g = classes.select("id", "sig")
        both = (pairs.join(g.select(F.col("id").alias("a"), F.col("sig").alias("ga")), "a")
                .join(g.select(F.col("id").alias("b"), F.col("sig").alias("gb")), "b"))
        return both.select("a", "b", "ga", "gb").mapInArrow(near, "a long, b long")

    tested = written(star, "near-star")
    links = _links(written(within(tested), "near-star-within"), texts, shingle, num, den, "near-star")
    labels = written(components_of(links), "near-labels")

    left = _labelled(entries, labels)
    mixed = left.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key")
    left = written(left.where("size > 2").join(mixed, "key", "left_semi"), "near-open")
    x = left.where(F.col("size") <= SMALL_KEY).select("key", "id", "n", "label", "hub")
    y = x.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    direct = (x.where("id <> hub").join(y, "key").where(f"id < id2 and label <> label2 and {fits}")
              .select(F.col("id").alias("a"), F.col("id2").alias("b")))
    dense = left.where(F.col("size") > SMALL_KEY).groupBy("id").agg(F.first("label").alias("label"))
    prefix = _prefix_pairs(dense, texts, shingle, num, den)
    pairs = written(direct.union(prefix).distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
    links = links.union(_links(written(within(pairs), "near-pairs-within"), texts, shingle, num, den, "near-rest"))
    labels = written(components_of(links), "near-components")

    classes = classes.select("n_shingles", "k1", "k2", F.col("id").alias("rep"))
    found = sigs.select("id", "n_shingles", "k1", "k2").join(classes, ["n_shingles", "k1", "k2"], "left")
    out = found.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _bucket_counts(batches):
    """(slice, counts) of a task: how many shingles its sets have in each bucket, a few rows of fixed size."""
    counts = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for v in b.column(0):
            np.add.at(counts, (np.frombuffer(v.as_buffer(), np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
    parts = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, SLICES)] if counts.any() else []
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])


def _summed_slice(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(v.as_py()), np.int64) for v in table["counts"])
    return pa.table({"slice": table["slice"].slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def parities(s: np.ndarray) -> list[int]:
    """Whether an odd number of a set's hashes falls on each of ``PARITIES`` places, 64 of them a number.

    Common members cancel out, so two sets differ in at most as many places as they have members apart."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _prefixes(counts, num: int, den: int):
    """(id, label, h, n, r, back, odd) of the prefix of each set: its shingles by the count of their bucket, then by
    hash; h is the r-th of n, ``back`` are up to ``EARLIER`` prefix shingles before it, ``odd`` the set's parities."""
    def run(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for i, label, v in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("s")):
                s = np.frombuffer(v.as_buffer(), dtype=np.uint64)
                f = counts.value[(s % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.lexsort((s, f))[:len(s) + (-len(s) * num // den) + 1]
                r = np.flatnonzero(f[order] > 1)  # a bucket of one holds a shingle that no other set has
                h = s[order[r]].view(np.int64)
                for c, x in zip(cols, ([i] * len(r), [label] * len(r), h.tolist(), [len(s)] * len(r), (r + 1).tolist(),
                                       [h[max(0, k - EARLIER):k].tolist() for k in range(len(r))], [parities(s)] * len(r))):
                    c += x
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "label", "h", "n", "r", "back", "odd"])
    return run


def _prefix_pairs(dense: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Exact candidates among the classes of large keys: pairs that share one of the first
    ``n - ceil(n * num / den) + 1`` shingles of both.

    Any order of all shingles would do; rare ones first keeps the pairs few.  The order goes by the counts of
    ``BUCKETS`` hash buckets among these classes, a table of fixed size that every task has, so that
    no shingle outside a prefix is moved."""
    sets = texts.join(broadcast_if_small(dense.select("id")), "id", "left_semi").mapInArrow(_set_rows(size), "id long, s binary")
    sets = written(sets.join(dense, "id").select("id", "label", "s"), "near-dense")
    schema = "slice int, counts binary"
    found = sets.select("s").mapInArrow(_bucket_counts, schema).groupBy("slice").applyInArrow(_summed_slice, schema).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in found:
        counts.reshape(SLICES, -1)[r.slice] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    prefixes = sets.mapInArrow(_prefixes(dense.sparkSession.sparkContext.broadcast(counts), num, den),
                               "id long, label long, h long, n long, r long, back array<long>, odd array<long>")
    ranked = written(prefixes, "near-prefixes")
    mixed = ranked.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("h")
    x = ranked.join(mixed, "h", "left_semi").select("h", "id", "label", "n", "r", "back", "odd")
    y = x.select("h", *[F.col(c).alias(f"{c}2") for c in ("id", "label", "n", "r", "back", "odd")])
    # the first shingle that two sets share bounds their overlap by what follows it in either; a
    # pair with a common shingle shortly before comes from that one already
    enough = f"{num + den} * (1 + least(n - r, n2 - r2)) >= {num} * (n + n2)"
    differing = " + ".join(f"bit_count(odd[{i}] ^ odd2[{i}])" for i in range(PARITIES // 64))
    close = f"{num + den} * ({differing}) <= {den - num} * (n + n2)"
    return (x.join(y, "h").where(f"id < id2 and label <> label2 and {enough} and {close} and not arrays_overlap(back, back2)")
            .select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct())
