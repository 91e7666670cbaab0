"""Quality classifier: a byte-level convolutional network in numpy (operator 3).

Bytes are embedded (``EMBED`` numbers each); learned filters of ``WIDTH`` bytes move over the
whole text in steps of ``STEP`` bytes, so successive windows overlap.  Chunks of ``CHUNK`` windows
begin every half chunk, so each window lies in two of them (at the ends of a text in one).  Each chunk is
max-pooled, as the larger of its halves' maxima; the maximum and the mean of the chunk vectors over all
chunks of the document, and the share of the first chunk that a short text fills, go through a small
hidden layer to one probability.

Fitting: Adam on a bounded labelled sample (``training.labelled_sample``), with exact
gradients through both poolings, on the driver; the weights are a few thousand numbers that
travel in the closure.  Scoring: one pass over the documents by Arrow batches, no shuffle;
long texts are scored piece by piece in bounded memory.

Defined results: a null text counts as empty; an empty text is one chunk of padding and has a
score like any other; repeated rows have equal scores; an empty table gives an empty table;
input columns of the same names as the results are ignored.  Without labelled rows of both
labels every score is the share of label 1 (0.5 without any rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .training import held_out, labelled_sample

EMBED, STEP, TAPS, FILTERS, CHUNK, HIDDEN = 8, 4, 3, 32, 64, 16
WIDTH, HALF = STEP * TAPS, CHUNK // 2
GOOD = 0.8  # weight of label 1 in fitting: to lose a clean document costs four times a junk one kept
BLOCK = 1 << 17  # bytes of text scored at once: some 20 MB of arrays
PIECE = CHUNK * STEP * 256


def _layout(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, first window of each half chunk, row of each half chunk, windows that reach into
    the next row).

    Each row is padded with zeros to whole steps and by the bytes its last window needs."""
    size = np.diff(off)
    windows = np.maximum(1, -(-size // STEP))
    steps = windows + TAPS - 1
    at = np.concatenate([[0], np.cumsum(steps)])
    flat = np.zeros(int(at[-1]) * STEP, dtype=np.uint8)
    dest = np.repeat(at[:-1] * STEP - off[:-1], size) + np.arange(len(buf))
    flat[dest] = buf
    over = (at[1:, None] - np.arange(1, TAPS)).ravel()
    per_row = -(-windows // HALF)
    row = np.repeat(np.arange(len(size)), per_row)
    first = np.concatenate([[0], np.cumsum(per_row)])[:-1]
    start = at[row] + (np.arange(len(row)) - first[row]) * HALF
    return flat, start, row, over


def _filters(model: dict, flat: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedded steps, rectified filter outputs of every window; 0 for windows ``over`` a row)."""
    a = model["emb"][flat].reshape(len(flat) // STEP, STEP * EMBED)
    z = a @ model["w"]  # (steps, TAPS * FILTERS)
    out = z[:, :FILTERS] + model["b"]
    for k in range(1, TAPS):
        out[:-k] += z[k:, k * FILTERS:(k + 1) * FILTERS]
    np.maximum(out, 0, out=out)
    out[over] = 0
    return a, out


def _chunks(half_max: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(maxima of the chunks, their rows, first and last half of each): two successive halves of a row
    are a chunk, as is a row's only half."""
    pair = np.append(row[1:] == row[:-1], False)
    alone = ~pair & np.append(True, row[1:] != row[:-1])
    left = np.flatnonzero(pair | alone)
    right = left + pair[left]
    return np.maximum(half_max[left], half_max[right]), row[left], left, right


def _pooled(chunk_max: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[maximum, mean, filled share] of each row's chunks; size: the rows' bytes."""
    first = np.searchsorted(row, np.arange(len(size)))
    n = np.diff(np.append(first, len(row)))
    return np.hstack([np.maximum.reduceat(chunk_max, first, axis=0),
                      np.add.reduceat(chunk_max, first, axis=0) / n[:, None],
                      np.minimum(1, size / (CHUNK * STEP))[:, None]])


def _head(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ model["h"] + model["hb"], 0)
    return hidden, _sigmoid(hidden @ model["out"] + model["bias"][0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gradients(m: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted mean log loss (and of the hidden layer's L2 term)."""
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    flat, start, row, over = _layout(np.concatenate(raw), off)
    a, z = _filters(m, flat, over)
    hm = np.maximum.reduceat(z, start, axis=0)
    cm, chunk_row, left, right = _chunks(hm, row)
    x = _pooled(cm, chunk_row, np.diff(off))
    hidden, p = _head(m, x)
    d = (p - y) * weight / len(texts)
    dh = np.outer(d, m["out"]) * (hidden > 0)
    grad = {"out": hidden.T @ d, "bias": np.array([d.sum()]), "h": x.T @ dh + 1e-4 * m["h"], "hb": dh.sum(axis=0)}
    dx = dh @ m["h"].T
    n = np.bincount(chunk_row, minlength=len(texts))
    dcm = dx[chunk_row, FILTERS:2 * FILTERS] / n[chunk_row][:, None]
    dhm = dx[row, :FILTERS] * (hm == x[row, :FILTERS])  # two chunks share the half of the document's maximum
    dhm[left] += dcm * (hm[left] == cm)
    dhm[right] += dcm * (hm[right] == cm) * (right > left)[:, None]
    half_of = np.searchsorted(start, np.arange(len(z)), side="right") - 1
    hit = (z == hm[half_of]) & (z > 0)
    dz = dhm[half_of] * hit
    grad["b"] = dz.sum(axis=0)
    full = np.zeros((len(z), TAPS * FILTERS), z.dtype)
    for k in range(TAPS):
        full[k:, k * FILTERS:(k + 1) * FILTERS] = dz[:len(z) - k]
    grad["w"] = a.T @ full
    da = (full @ m["w"].T).reshape(-1, EMBED)
    grad["emb"] = np.stack([np.bincount(flat, weights=da[:, e], minlength=256) for e in range(EMBED)], axis=1)
    return grad


def fit(texts: list[bytes], labels: list[int], epochs: int = 7, batch: int = 16, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    m = {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
         "w": rng.normal(0, 0.15, (STEP * EMBED, TAPS * FILTERS)).astype(np.float32),
         "b": np.zeros(FILTERS, np.float32),
         "h": rng.normal(0, 0.15, (2 * FILTERS + 1, HIDDEN)).astype(np.float32), "hb": np.zeros(HIDDEN, np.float32),
         "out": rng.normal(0, 0.2, HIDDEN).astype(np.float32), "bias": np.zeros(1, np.float32)}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    weight = np.where(y == 1, GOOD / y.mean(), (1 - GOOD) / (1 - y.mean())).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0003
        order = rng.permutation(len(texts))
        for ids in (order[i:i + batch] for i in range(0, len(order), batch)):
            grad = _gradients(m, [texts[i] for i in ids], y[ids], weight[ids])
            step += 1
            for k, v in m.items():
                gk = grad[k].astype(np.float32)
                m1, m2 = mom[k]
                m1 += 0.1 * (gk - m1)
                m2 += 0.01 * (gk * gk - m2)
                v -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-7)
    return m


def scores(model: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of a block; a single long row goes piecewise."""
    rows = len(off) - 1
    if "constant" in model:
        return np.full(rows, model["constant"])
    if rows == 1 and len(buf) > PIECE:
        top, total, n, last = np.full(FILTERS, -np.inf), np.zeros(FILTERS), 0, np.zeros((0, FILTERS), np.float32)
        for i in range(0, len(buf), PIECE):
            part = buf[i:i + PIECE + WIDTH - STEP]  # the bytes that the last windows reach into
            flat, start, _, over = _layout(part, np.array([0, len(part)]))
            steps = min(len(buf) - i, PIECE)
            z = _filters(model, flat, over)[1][:max(1, -(-steps // STEP))]
            hm = np.concatenate([last, np.maximum.reduceat(z, start[start < len(z)], axis=0)])
            cm, last = np.maximum(hm[:-1], hm[1:]), hm[-1:]  # chunks that reach over two pieces included
            top, total, n = np.maximum(top, hm.max(axis=0)), total + cm.sum(axis=0), n + len(cm)
        x = np.concatenate([top, total / n, [1.0]])[None, :]
    else:
        flat, start, row, over = _layout(buf, off)
        cm, row, *_ = _chunks(np.maximum.reduceat(_filters(model, flat, over)[1], start, axis=0), row)
        x = _pooled(cm, row, np.diff(off))
    return _head(model, x)[1].astype(np.float64)


def _block_scores(model: dict, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for i, j, buf, off in text_blocks(column, BLOCK):
        out[i:j] = scores(model, buf, off)
    return np.round(out, 6)  # equal texts score alike, whatever block they share


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", **sample) -> dict:
    return fit(*labelled_sample(docs, labels, label_col, **sample))


def score_documents(docs: DataFrame, model: dict, threshold: float = 0.5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted of every row."""
    def run(batches):
        for b in batches:
            s = _block_scores(model, b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])
    cols = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)), F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows scored at least ``threshold``, with all their columns: a filter without a join.

    Only the texts go to Python, and only the verdicts come back."""
    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(_block_scores(model, text) >= threshold)

    return docs.where(good(F.col(text_col)))
