"""Approximate nearest neighbours by sharded HNSW graphs (operator 1).

Each shard's hierarchical navigable small-world graph is a row of flat arrays: vectors, and per
level the members and a fixed-width table of neighbour numbers (-1: none).  Points are inserted in
batches: a batch searches the graph so far and itself, keeps diverse neighbours, and neighbours
over their width are pruned by the same rule.  Searches move all queries of a block forward in step,
so the work is in array operations.

Shape of the job:

* equal vectors are one point with its ``k + 1`` smallest ids, which is all that ties to smaller ids
  can need; so copies neither flood a graph nor gather in a task;
* points are dealt to shards of ``shard_rows`` points, or of ``SHARD_BYTES`` of vectors where that is less, by
  a hash, built where they are, and written to the shared folder;
* the stated queries (distinct vectors) go in parts of ``part_rows`` to every shard (cogroup by shard
  and part, no cross join); each shard returns its ``k + 1`` best by exact cosine in double
  precision, and shard results are merged by a partial then final top list per query.

Defined results: vectors that are null, empty or zero or hold a null or non-finite component
take no part, nor do rows without an id; vectors of different lengths are never compared; equal rows
are one; an id with several vectors is a candidate with each of them, and a query with each of them (with
ranks from 1 for each); a query is not its own candidate; one with fewer candidates returns them all;
an empty table or query set gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

M, M0 = 16, 32
EF_BUILD, EF_SEARCH = 96, 160
SHARD_ROWS, SHARD_BYTES, PART_ROWS = 16_384, 1 << 26, 32_768


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _search_level(vec: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, width: int = 4):
    """(numbers, similarities) of up to ``ef`` near points of each query, -1 where none.

    vec has a zero row at its end, nbr's last row is all -1."""
    n, rows = len(vec) - 1, np.arange(len(q))
    seen = np.zeros((len(q), n + 1), dtype=bool)
    idx = np.full((len(q), ef), -1, dtype=np.int64)
    sim = np.full((len(q), ef), -np.inf, dtype=np.float32)
    first = entry.shape[1]
    idx[:, :first] = entry
    sim[:, :first] = np.where(entry >= 0, np.einsum("qed,qd->qe", vec[entry], q), -np.inf)
    todo = idx >= 0
    seen[rows[:, None], np.where(entry >= 0, entry, n)] = True
    while True:
        s = np.where(todo, sim, -np.inf)
        rows = np.flatnonzero(todo.any(axis=1))
        if not len(rows):
            return idx, sim
        at = np.argpartition(-s[rows], min(width, ef) - 1, axis=1)[:, :width]
        r = rows[:, None]
        ok = s[r, at] > -np.inf
        todo[r, at] = False
        near = nbr[np.where(ok, idx[r, at], n)].reshape(len(rows), -1).astype(np.int64)
        near = np.where((near < 0) | seen[r, near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[r, near] = True
        got = np.matmul(vec[near], q[rows][:, :, None])[:, :, 0]
        got[near == n] = -np.inf
        all_sim = np.concatenate([sim[rows], got], axis=1)
        all_idx = np.concatenate([idx[rows], np.where(near == n, -1, near)], axis=1)
        all_todo = np.concatenate([todo[rows], near < n], axis=1)
        top = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
        sim[rows] = np.take_along_axis(all_sim, top, axis=1)
        idx[rows] = np.take_along_axis(all_idx, top, axis=1)
        todo[rows] = np.take_along_axis(all_todo, top, axis=1)


def _diverse(vec: np.ndarray, idx: np.ndarray, sim: np.ndarray, width: int) -> np.ndarray:
    """Per row up to ``width`` of the candidates: nearest first, those nearer to the row than to any
    chosen before; then the nearest of the others fill up."""
    order = np.argsort(-sim, axis=1, kind="stable")
    idx, sim = np.take_along_axis(idx, order, axis=1), np.take_along_axis(sim, order, axis=1)
    v = vec[idx]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros(idx.shape, dtype=bool)
    nearest = np.full(idx.shape, -np.inf, dtype=np.float32)  # of each candidate to the chosen
    for j in range(idx.shape[1]):
        take = (idx[:, j] >= 0) & (nearest[:, j] < sim[:, j]) & (chosen.sum(axis=1) < width)
        chosen[:, j] = take
        nearest[take] = np.maximum(nearest[take], between[take, j])
    rank = np.where(chosen, 0, np.where(idx >= 0, 1, 2))
    keep = np.argsort(rank, axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(idx, keep, axis=1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def build(vectors: np.ndarray, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top: (members, neighbours); the last holds all points.

    Points are ordered by level, so the members of a level are the first so many."""
    n = len(vectors)
    level = np.sort((-np.log(np.random.default_rng(seed).random(n)) / math.log(M)).astype(int))[::-1]
    unit = np.vstack([_unit(vectors), np.zeros((1, vectors.shape[1]), np.float32)]).astype(np.float32)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for lev in range(int(level[0]), -1, -1):
        size = int((level >= lev).sum())
        width = M if lev else M0
        nbr = np.full((n + 1, width), -1, dtype=np.int32)
        above = int((level > lev).sum())
        done = 0
        while done < size:
            b = np.arange(done, min(size, done + max(64, min(256, done))))
            q = unit[b]
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            idx, sim = np.broadcast_to(b, own.shape), own
            if done:
                entry = _descend(unit, levels, q) if above and done >= above else np.zeros((len(b), 1), np.int64)
                i, s = _search_level(unit, nbr, q, entry, EF_BUILD)
                idx, sim = np.concatenate([i, idx], axis=1), np.concatenate([s, sim], axis=1)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :EF_BUILD]
            idx, sim = np.take_along_axis(idx, best, axis=1), np.take_along_axis(sim, best, axis=1)
            got = _diverse(unit, np.where(np.isfinite(sim), idx, -1), sim, M)
            nbr[b, :M] = got
            _link_back(unit, nbr, b, got)
            done += len(b)
        levels.append((np.arange(size, dtype=np.int32), nbr[:-1][:size].copy()))
    return levels


def _link_back(unit: np.ndarray, nbr: np.ndarray, b: np.ndarray, got: np.ndarray) -> None:
    """Add each new point to the lists of its neighbours, pruning lists that overflow."""
    to, src = got.ravel(), np.repeat(b, got.shape[1])
    src, to = src[to >= 0], to[to >= 0]
    known = (nbr[to] == src[:, None]).any(axis=1)
    src, to = src[~known], to[~known]
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    src, to = src[order], to[order]
    point, start, n = np.unique(to, return_index=True, return_counts=True)
    extra = np.full((len(point), int(n.max())), -1, dtype=np.int64)
    extra[np.repeat(np.arange(len(point)), n), np.arange(len(to)) - np.repeat(start, n)] = src
    cand = np.concatenate([nbr[point], extra], axis=1)
    width = nbr.shape[1]
    for i in range(0, len(point), 512):
        c, p = cand[i:i + 512], point[i:i + 512]
        sim = np.where(c >= 0, np.matmul(unit[c], unit[p][:, :, None])[:, :, 0], -np.inf)
        full = (c >= 0).sum(axis=1) > width
        keep = np.argsort(c < 0, axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(c, keep, axis=1)
        if full.any():
            out[full] = _diverse(unit, c[full], sim[full], width)
        nbr[p] = out


def _descend(unit: np.ndarray, levels: list, q: np.ndarray) -> np.ndarray:
    """Entry points (queries, 4) from the levels built so far, top first."""
    entry = np.zeros((len(q), 1), dtype=np.int64)
    for members, nbr in levels:
        table = np.full((len(unit), nbr.shape[1]), -1, dtype=np.int32)
        table[:len(nbr)] = nbr
        idx, sim = _search_level(unit, table, q, entry, 8)
        best = np.argsort(-sim, axis=1)[:, :4]
        entry = np.take_along_axis(idx, best, axis=1)
    return entry


def search(unit: np.ndarray, levels: list, q: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
    """Numbers (queries, ef) of near points, -1 where fewer; unit without the zero row."""
    unit = np.vstack([unit, np.zeros((1, unit.shape[1]), np.float32)])
    entry = _descend(unit, levels[:-1], q)
    nbr = np.vstack([levels[-1][1], np.full((1, levels[-1][1].shape[1]), -1, np.int32)])
    return _search_level(unit, nbr, q, entry, ef)[0]


# ------------------------------------------------------------------------------- Spark

def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), dim)


def _build_shard(table: pa.Table) -> pa.Table:
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    low = table["low"].to_numpy()
    order = np.lexsort((table["point"].to_numpy(), low))
    ids, low, vec = table["point"].to_numpy()[order], low[order], _matrix(table["vec"], dim)[order]
    levels = build(vec)
    return pa.table({
        "dim": [dim], "shard": pa.array([shard], pa.int64()), "ids": [ids.astype("<i8").tobytes()], "lows": [low.astype("<i8").tobytes()], "vectors": [vec.astype("<f8").tobytes()],
        "sizes": pa.array([[len(m) for m, _ in levels]], pa.list_(pa.int32())),
        "neighbours": pa.array([[t.astype("<i4").tobytes() for _, t in levels]], pa.list_(pa.binary()))},
        schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()), ("lows", pa.binary()), ("vectors", pa.binary()),
                          ("sizes", pa.list_(pa.int32())), ("neighbours", pa.list_(pa.binary()))]))


INDEX = "dim int, shard long, ids binary, lows binary, vectors binary, sizes array<int>, neighbours array<binary>"


def usable(id_col: Column, vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return id_col.isNotNull() & vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def index(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, flat arrays) of distinct points (point, low, vec), a written table."""
    n = {r["dim"]: max(1, -(-r["n"] // max(1, min(shard_rows, SHARD_BYTES // (8 * r["dim"]))))) for r in points.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    shards = F.create_map(*[F.lit(x) for kv in n.items() for x in kv]) if n else F.create_map(F.lit(0), F.lit(1))
    dealt = points.select("point", "low", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vec"), shards[F.col("dim")]).cast("long"))
    return written(dealt.groupBy("dim", "shard").applyInArrow(_build_shard, INDEX), "hnsw-index")


def _search_part(k: int, ef: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, ids, lows, scores = [], [], [], []
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            own, low = (np.frombuffer(left[c][0].as_py(), "<i8") for c in ("ids", "lows"))
            vec = np.frombuffer(left["vectors"][0].as_py(), "<f8").reshape(-1, dim)
            levels = [(None, np.frombuffer(t, "<i4").reshape(s, -1)) for s, t in zip(left["sizes"][0].as_py(), left["neighbours"][0].as_py(), strict=True)]
            unit, norm = _unit(vec), np.sqrt((vec * vec).sum(axis=1))
            qid, q = right["query"].to_numpy(), _matrix(right["vec"], dim)
            for i in range(0, len(q), 256):
                block = q[i:i + 256]
                got = search(unit, levels, _unit(block), ef)
                dot = np.einsum("qed,qd->qe", vec[got], block)
                score = dot / (norm[got] * np.sqrt((block * block).sum(axis=1))[:, None])
                score = np.where(got >= 0, score, -np.inf)
                order = np.lexsort((np.where(got >= 0, low[got], 0), -score), axis=1)[:, :k]
                s, g = np.take_along_axis(score, order, axis=1), np.take_along_axis(got, order, axis=1)
                ok = g >= 0
                qs.append(np.repeat(qid[i:i + 256], ok.sum(axis=1)))
                ids.append(own[g[ok]])
                lows.append(low[g[ok]])
                scores.append(s[ok])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pa.table({"query": cat(qs, np.int64), "point": cat(ids, np.int64), "low": cat(lows, np.int64), "score": cat(scores, np.float64)})
    return run


def nearest(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, part_rows: int = PART_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, <id_col>, score): each query's k nearest by cosine, from 1."""
    rows = table.where(usable(F.col(id_col), F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    order = W.partitionBy("vec").orderBy("id")
    members = (rows.select("id", "vec").withColumn("r", F.dense_rank().over(order)).where(f"r <= {k + 1}")
               .groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    # a point's number names its vector, not an id: an id may have several; written, so fixed from here on
    members = written(members.select(F.monotonically_increasing_id().alias("point"), F.get("ids", F.lit(0)).alias("low"), "vec", "ids"),
                      "hnsw-points")
    graph = index(members, shard_rows)
    asked = written(rows.where("is_query").select(F.col("id").alias("query_id"), "vec").distinct()
                    .join(members.select("point", "vec"), "vec").select("query_id", F.col("point").alias("query"), "vec"), "hnsw-queries")
    distinct = asked.select("query", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim")).dropDuplicates(["query"])
    parts = max(1, -(-distinct.count() // part_rows))
    shards = graph.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    left = graph.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = (distinct.join(shards, "dim").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
             .select("query", "vec", "dim", "part", F.explode("shards").alias("shard")))
    found = written(left.groupBy("dim", "shard", "part").cogroup(right.groupBy("dim", "shard", "part"))
                    .applyInArrow(_search_part(k + 1, ef), "query long, point long, low long, score double"), "hnsw-found")
    top = W.partitionBy("query").orderBy(F.desc("score"), "low", "point")
    best = found.withColumn("r", F.row_number().over(top)).where(f"r <= {k + 1}").drop("r")
    best = best.join(members.select("point", "ids"), "point").select("query", "point", "score", F.explode("ids").alias("id"))
    pairs = asked.select("query_id", "query").join(best, "query").where("not (id = query_id and point = query)")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "id", "point")))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", F.col("id").alias(id_col), "score")
