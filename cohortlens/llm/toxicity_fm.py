"""Toxicity: a factorization machine over hashed terms (operator 5).

A document is its set of hashed terms (words and word beginnings); its score is

    sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

so that pairs of terms, such as an insult with the mention of a group, carry weights of their
own.  The pairwise sum costs one pass: half of |sum v_i|^2 - sum |v_i|^2.

Fitting on the driver: a bounded labelled sample; a hashed term enters the model if its own frequency
differs between the labels by at least ``MIN_Z`` standard errors, or if that of its pair with some other term does
and exceeds what either says alone by as much (``telling_pairs``): so terms that are neutral alone and
matter together are learned.  Adam with L2 on all weights.  Scoring: one Arrow pass over all documents, whole texts, no shuffle.

Defined results: null and empty texts have no terms and score sigmoid(w0); repeated rows
score alike; an empty table gives an empty table; without labelled rows of both labels every
score is the share of label 1 (0 without any rows).  Columns of the result's names in the input
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import term_hashes, text_blocks
from .training import held_out, labelled_sample

BITS, RANK, MIN_Z = 20, 6, 5.0
PREFIXES = (4, 5)
PAIR_BLOCK = 128


def _terms(buf: np.ndarray, off: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hashed term), sorted; with ``table``, only terms of the model, as its numbers."""
    row, h = term_hashes(buf, off, PREFIXES)
    t = (h >> np.uint64(64 - BITS)).astype(np.int64)
    if table is not None:
        t = table[t]
        row, t = row[t >= 0], t[t >= 0]
    key = np.unique((row << BITS) | t)
    return key >> BITS, key & ((1 << BITS) - 1)


def _raw(m: dict, row: np.ndarray, t: np.ndarray, rows: int):
    v = m["v"][t]
    s = np.stack([np.bincount(row, weights=v[:, f], minlength=rows) for f in range(RANK)], axis=1)
    q = np.bincount(row, weights=(v * v).sum(axis=1), minlength=rows)
    lin = np.bincount(row, weights=m["w"][t], minlength=rows)
    return m["w0"][0] + lin + 0.5 * ((s * s).sum(axis=1) - q), v, s


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _difference(pos, tot, n1: float, n0: float):
    """How many standard errors a share differs between label 1 (``pos`` of n1) and label 0 (the rest of ``tot``, of n0)."""
    share = (tot + 1) / (n1 + n0 + 2)
    return (pos / n1 - (tot - pos) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))


def telling_pairs(row: np.ndarray, t: np.ndarray, y: np.ndarray, z: np.ndarray, tot: np.ndarray) -> np.ndarray:
    """Terms of pairs whose joint frequency differs between the labels by ``MIN_Z`` standard errors more than that of
    either term.  A pair of fewer than MIN_Z squared texts cannot, so rarer terms are not paired."""
    terms = np.flatnonzero(tot >= MIN_Z ** 2)
    at = np.full(len(tot), -1, dtype=np.int64)
    at[terms] = np.arange(len(terms))
    place = np.argsort(np.argsort(-y, kind="stable"))  # texts of label 1 come first
    held = np.zeros((len(y), len(terms)), np.float32)
    keep = at[t] >= 0
    held[place[row[keep]], at[t[keep]]] = 1
    n1, n0 = float(y.sum()), float((1 - y).sum())
    own, toxic = np.abs(z[terms]).astype(np.float32), held[:int(n1)]
    told = np.zeros(len(terms), bool)
    for i in range(0, len(terms), PAIR_BLOCK):  # bounded memory: a block of rows of the matrix of pairs
        both, pos = held[:, i:i + PAIR_BLOCK].T @ held, toxic[:, i:i + PAIR_BLOCK].T @ toxic
        gain = np.abs(_difference(pos, both, n1, n0)) - np.maximum(own[i:i + PAIR_BLOCK, None], own[None, :])
        told |= (gain >= MIN_Z).any(axis=0)
    return terms[told]


def fit(texts: list[bytes], labels: list[int], steps: int = 400, l2: float = 5e-4, seed: int = 3) -> dict:
    y = np.array(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, t = _terms(buf, off)
    pos = np.bincount(t, weights=y[row], minlength=1 << BITS)
    tot = np.bincount(t, minlength=1 << BITS)
    n1, n0 = float(y.sum()), float((1 - y).sum())
    z = _difference(pos, tot, n1, n0)
    alone = np.flatnonzero((np.abs(z) >= MIN_Z) & (tot >= 3))
    chosen = np.union1d(alone, telling_pairs(row, t, y, z, tot))
    table = np.full(1 << BITS, -1, dtype=np.int32)
    table[chosen] = np.arange(len(chosen))
    keep = table[t] >= 0
    row, t = row[keep], table[t[keep]]
    rng = np.random.default_rng(seed)
    m = {"w0": np.zeros(1), "w": np.zeros(len(chosen)), "v": rng.normal(0, 0.02, (len(chosen), RANK))}
    mom = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in m.items()}
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for i in range(1, steps + 1):
        raw, v, s = _raw(m, row, t, len(y))
        d = (_sigmoid(raw) - y) * weight
        grad = {"w0": np.array([d.sum()]) + 0.05 * m["w0"],
                "w": np.bincount(t, weights=d[row], minlength=len(chosen)) + l2 * m["w"] / 10,
                "v": np.zeros_like(m["v"])}
        gv = d[row][:, None] * (s[row] - v)
        for f in range(RANK):
            grad["v"][:, f] = np.bincount(t, weights=gv[:, f], minlength=len(chosen))
        grad["v"] += l2 * m["v"]
        for k, x in m.items():
            m1, m2 = mom[k]
            m1 += 0.1 * (grad[k] - m1)
            m2 += 0.01 * (grad[k] ** 2 - m2)
            x -= 0.05 * (m1 / (1 - 0.9 ** i)) / (np.sqrt(m2 / (1 - 0.99 ** i)) + 1e-9)
    return m | {"table": table}


def scores(model: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    if "constant" in model:
        return np.full(rows, model["constant"])
    row, t = _terms(buf, off, model["table"])
    return _sigmoid(_raw(model, row, t, rows)[0])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", **sample) -> dict:
    return fit(*labelled_sample(docs, labels, label_col, **sample))


def score_documents(docs: DataFrame, model: dict, threshold: float = 0.7, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted of every row."""
    model = spark_value(docs, model)

    def run(batches):
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, j, buf, off in text_blocks(b.column(2)):
                s[i:j] = scores(model.value, buf, off)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])
    cols = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)), F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def spark_value(df: DataFrame, value):
    """A broadcast variable for a model of fixed size (4 MB: the table of hashed terms)."""
    return df.sparkSession.sparkContext.broadcast(value)
