"""Quality classifier: a small convolutional network on bytes, in NumPy.

A document is read as UTF-8 bytes, whole, in chunks of ``CHUNK`` window starts; a chunk's bytes overlap the next one's by
the filter width. A filter gives every window the sum of one learned weight per place and byte value. A chunk keeps each
filter's largest response (not below 0); a document keeps the largest and the mean over its chunks, and a logistic
unit joins these numbers into one probability. Responses are sums of table rows picked by byte, for all windows at once.

The network is trained by Adam on at most ``FIT_ROWS`` labelled documents of at most ``FIT_BYTES`` bytes, the first in the
order of a hash of the id; rows whose crc32(id as text) mod 5 is 0 are held out and never fitted on. Gradients pass the
maxima to the windows that made them. Labels, language, source and id are no inputs of a score. The sample is the only
bound; every document is scored on its whole text.

NULL and empty texts have no chunks, all features 0 and the score of the bias. A NULL id is not held out. Repeated texts have equal scores. An empty
table gives an empty result; without labels of both kinds the score is the label's share (0.5 without any). Columns
besides id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS, WIDTH, CHUNK = 16, 5, 512
FIT_ROWS, FIT_BYTES = 3000, 1 << 16
FOLDS, THRESHOLD = 5, 0.3
#: Window starts whose responses are held at once.
PIECE = 1 << 16


@dataclass
class Network:
    """taps (place, byte, filter), bias (filter), weights (max then mean of each filter) and their bias."""

    taps: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def _responses(net: Network, data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Filter responses of the windows that start at first to last; ``data`` goes on for the width behind them."""
    out = np.take(net.taps[0], data[first:last], axis=0)
    for j in range(1, WIDTH):
        out += np.take(net.taps[j], data[first + j : last + j], axis=0)
    return out


def _padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with zero bytes behind each, and the starts and texts of their chunks."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    begin = bounds[:-1] + np.arange(n) * WIDTH
    out = np.zeros(len(data) + n * WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * WIDTH, size)] = data
    chunks = -(-size // CHUNK)
    of = np.repeat(np.arange(n), chunks)
    start = A.ranges(np.zeros(n, np.int64), chunks) * CHUNK + begin[of]
    end = np.minimum(start + CHUNK, begin[of] + size[of])
    return out, np.stack([start, end], axis=1), of


def features(net: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest and mean chunk maximum of every filter, of every text."""
    n = len(bounds) - 1
    padded, chunks, of = _padded(data, bounds)
    most = np.zeros((len(chunks), FILTERS), np.float32)
    i = 0
    while i < len(chunks):
        j = max(i + 1, int(np.searchsorted(chunks[:, 1], chunks[i, 0] + PIECE, side="right")))
        first, last = int(chunks[i, 0]), int(chunks[j - 1, 1])
        response = _responses(net, padded, first, last)
        edges = (chunks[i:j] - first).reshape(-1)[:-1]  # chunk, gap or nothing, chunk, ...
        steps = np.maximum.reduceat(response, edges, axis=0)[::2]
        most[i:j] = np.maximum(steps + net.bias, 0)
        i = j
    out = np.zeros((n, 2 * FILTERS), np.float32)
    if len(of):
        edges = A.runs(of)
        who = of[edges[:-1]]
        out[who, :FILTERS] = np.maximum.reduceat(most, edges[:-1], axis=0)
        out[who, FILTERS:] = np.add.reduceat(most, edges[:-1], axis=0) / np.diff(edges)[:, None]
    return out


def probability(net: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(features(net, data, bounds).astype(np.float64) @ net.weights + net.offset)))


def _start(seed: int) -> Network:
    """Random filters over kinds of bytes (capitals, letters, digits, blanks, marks, others), so that each begins with a sense."""
    rng = np.random.default_rng(seed)
    kind = np.zeros((256, 8))
    for k, chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (32,), (10, 13), (44, 46, 58, 59), (33, 63, 39, 34), (35, 36, 37, 38, 42, 60, 62, 124))):
        kind[list(chars), k] = 1
    taps = np.einsum("bk,wkf->wbf", kind, rng.normal(0, 0.5, (WIDTH, 8, FILTERS))) + rng.normal(0, 0.05, (WIDTH, 256, FILTERS))
    return Network(taps.astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS), 0.0)


def train(texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Network:
    net = _start(seed)
    good = float(np.mean(y)) if len(y) else 0.5
    if good in (0.0, 1.0) or not len(y):
        net.weights[:] = 0
        net.offset = float(np.log((good + 1e-3) / (1 - good + 1e-3)))
        return net
    net.offset = float(np.log(good / (1 - good)))
    rng = np.random.default_rng(seed + 1)
    params = [net.taps, net.bias, net.weights, np.array([net.offset])]
    moment, square = [np.zeros_like(p, np.float64) for p in params], [np.zeros_like(p, np.float64) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            grads = [np.zeros_like(p, np.float64) for p in params]
            for r in rows:
                _accumulate(net, params, grads, texts[r], float(y[r]), len(rows))
            step += 1
            pace = rate * (1 - epoch / epochs)
            for p, g, m, v in zip(params, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(p.dtype)
            net.offset = float(params[3][0])
    _refit(net, texts, y)
    return net


def _refit(net: Network, texts: list[bytes], y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> None:
    """Fit the logistic unit to the end on the finished filters (Newton steps), which sharpens the scores."""
    column = pa.array(texts, pa.binary())
    x = np.concatenate([features(net, part.data, part.bounds) for part in A.text_slices(column)]).astype(np.float64)
    scale = np.maximum(x.std(axis=0), 1e-6)
    x = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
    w = np.append(net.weights * scale, net.offset)
    keep = np.append(np.full(x.shape[1] - 1, ridge * len(y) / 100), 1e-6)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * (keep * w * w).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6), slope)
        size = 1.0
        while size > 1e-3 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    net.weights, net.offset = w[:-1] / scale, float(w[-1])


def _accumulate(net: Network, params: list, grads: list, text: bytes, label: float, share: int) -> None:
    """Add the gradient of one document's log loss."""
    raw = np.frombuffer(text, np.uint8)
    data, chunks, _ = _padded(raw, np.array([0, len(raw)]))
    x = np.zeros(2 * FILTERS)
    if len(chunks):
        response = _responses(net, data, 0, int(chunks[-1, 1])) + net.bias
        where = np.stack([response[a:b].argmax(axis=0) + a for a, b in chunks])
        most = np.maximum(np.take_along_axis(response, where, axis=0), 0)
        top = most.argmax(axis=0)
        x[:FILTERS], x[FILTERS:] = most[top, np.arange(FILTERS)], most.mean(axis=0)
    p = 1 / (1 + np.exp(-np.clip(x @ net.weights + net.offset, -30, 30)))
    d = (p - label) / share
    grads[2] += d * x
    grads[3] += d
    if len(chunks):
        back = np.tile(d * net.weights[FILTERS:] / len(chunks), (len(chunks), 1))
        back[top, np.arange(FILTERS)] += d * net.weights[:FILTERS]
        back *= most > 0
        grads[1] += back.sum(axis=0)
        for j in range(WIDTH):
            np.add.at(grads[0][j], (data[where + j], np.arange(FILTERS)), back)


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Network:
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
        .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= FIT_BYTES)
    got = sorted((r["text"], r["label"]) for r in sample.join(F.broadcast(known), "_id").select("text", "label").collect())
    return train([t.encode() for t, _ in got], np.array([float(k) for _, k in got]))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.text_slices(batch.column("_text")):
                p = probability(net, part.data, part.bounds)
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(part.first, part.last - part.first), pa.array(p)], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)
    return out.select(id_col, F.coalesce(is_held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
