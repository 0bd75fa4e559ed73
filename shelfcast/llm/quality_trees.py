"""Quality rules: gradient-boosted trees over document statistics, monotone in chosen ones.

Two verdicts meet in ``kept``. The base rules (word count, share of repeated word windows) are fixed; a document
that passes them is judged by the trees. The trees are fitted on a bounded sample of labelled documents (``FIT_ROWS``)
with histogram splits; a split on a constrained feature is allowed only where the child values are in the right order,
and the bounds between siblings are handed down, so the score never rises (or falls) against the constraint. The fitted
trees are a few flat NumPy arrays: every task walks all rows of a batch through all trees one level at a time.

NULL and empty texts have all statistics 0 and fail the base rules. Repeated and tied rows are judged alike, each row
on its own text. An empty table gives an empty result; without labels of both kinds the trees are empty and only the
base rules decide. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The trees are fitted on at most so many labelled documents, the first in the order of a hash of the id.
FIT_ROWS = 20_000
#: Rejected below this chance of good quality.
KEEP_FROM = 0.5
WINDOW = 3
SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature -> direction in which the chance of good quality may move as it grows (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "mark_share": 0, "digit_share": 0, "words_per_line": 0, "distinct_share": 1,
}


def _per_text(n: int, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weights, minlength=n)[:n]


def _byte_counts(part: A.Slice, table: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[part.data], dtype=np.int64)])
    return total[part.bounds[1:]] - total[part.bounds[:-1]]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int8)
    out[np.frombuffer(chars, np.uint8)] = 1
    return out


_SYMBOL, _SPACE = _table(SYMBOLS), _table(b" \t\n\x0b\x0c\r")
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _MARK = _table(b"0123456789"), _table(b".,;:!?")
_LEAD = (np.arange(256) & 0xC0 != 0x80).astype(np.int8)


def statistics(part: A.Slice, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The base statistics and the features of every text of a slice."""
    n = len(part.bounds) - 1
    start, end, of = A.word_spans(part.data, part.bounds, A.NOT_SPACE)
    total = A.prefix_hash(A._BYTE[part.data])
    word = A.span_hash(total, start, end)
    n_words = _per_text(n, of)
    points = _byte_counts(part, _LEAD)
    out = {"n_words": n_words, "word_chars": points - _byte_counts(part, _SPACE), "n_symbols": _byte_counts(part, _SYMBOL)}

    breaks = np.flatnonzero(part.data == 10)
    # Where a text ends in a line break, its last, empty line stands before the first of the next text.
    line_start = np.concatenate([breaks + 1, part.bounds[:-1]])
    line_of = np.concatenate([A.owner(breaks, part.bounds), np.arange(n)])
    order = np.argsort(line_start, kind="stable")
    line_start, line_of = line_start[order], line_of[order]
    line_end = np.minimum(np.concatenate([line_start[1:], [len(part.data)]]), part.bounds[line_of + 1])
    full = np.flatnonzero(line_end > line_start)
    line_end[full] -= part.data[line_end[full] - 1] == 10
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_of, key = line_of[with_word], A.span_hash(total, line_start[with_word], line_end[with_word])
    out["n_dup_lines"] = _per_text(n, line_of) - _distinct(n, line_of, key)

    out["n_repeat_words"] = _repeats(n, of, word, window)
    words = np.maximum(n_words, 1)
    letters = np.maximum(_byte_counts(part, _LETTER), 1)
    chars = np.maximum(out["word_chars"], 1)
    lines = np.maximum(_per_text(n, line_of), 1)
    out |= {
        "log_words": np.log1p(n_words), "mean_word": out["word_chars"] / words, "symbol_share": out["n_symbols"] / chars,
        "dup_line_share": out["n_dup_lines"] / lines, "repeat_share": out["n_repeat_words"] / words,
        "upper_share": _byte_counts(part, _UPPER) / letters, "mark_share": _byte_counts(part, _MARK) / words,
        "digit_share": _byte_counts(part, _DIGIT) / chars, "words_per_line": n_words / lines,
        "distinct_share": _distinct(n, of, word) / words,
    }
    return out


def _distinct(n: int, of: np.ndarray, key: np.ndarray) -> np.ndarray:
    order = np.lexsort((key, of))
    k, o = key[order], of[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return _per_text(n, o[new])


def _repeats(n: int, of: np.ndarray, word: np.ndarray, window: int) -> np.ndarray:
    """Words that lie in a window of ``window`` words found twice or more in their text."""
    m = len(word) - window + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    key = np.zeros(m, dtype=A.U64)
    for j, weight in enumerate(A.powers(window)):
        key += word[j : j + m] * weight
    at = np.flatnonzero(of[:m] == of[window - 1 :])
    order = at[np.lexsort((key[at], of[at]))]
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(word) + 1, dtype=np.int64)
    hit = order[twice]
    covered[hit] += 1
    covered[hit + window] -= 1
    return _per_text(n, of[np.cumsum(covered[:-1]) > 0])


@dataclass
class Trees:
    """Complete binary trees as arrays (tree, node): feature (-1: leaf), threshold, value. A child of i is 2i + 1 or 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of good quality of the rows of ``x``, all at once, one level after the other."""
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = f[node] >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f[node], 0)] > t[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += v[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 64, ridge: float = 1.0, least: int = 10,
) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins, with monotone constraints."""
    size = 2 ** (depth + 1) - 1
    good = min(max(float(np.mean(y)) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    prior = float(np.log(good / (1 - good)))
    if not len(y) or y.min() == y.max():
        return Trees(np.full((0, size), -1), np.zeros((0, size)), np.zeros((0, size)), prior if len(y) else 20.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    feature = np.full((trees, size), -1)
    threshold, value = np.zeros((trees, size)), np.zeros((trees, size))
    total = np.full(len(y), prior)
    for k in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        todo = [(0, np.arange(len(y)), -np.inf, np.inf)]
        while todo:
            node, rows, low, high = todo.pop()
            best = None
            if node < 2**depth - 1 and len(rows) >= 2 * least:
                best = _best_split(code[rows], g[rows], h[rows], edges, directions, low, high, ridge, least)
            if best is None:
                leaf = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
                value[k, node] = rate * leaf
                total[rows] += rate * leaf
                continue
            j, cut, left, right = best
            feature[k, node], threshold[k, node] = j, edges[j][cut]
            middle = (left + right) / 2
            below = code[rows, j] <= cut
            bounds = ((low, middle), (middle, high)) if directions[j] > 0 else ((middle, high), (low, middle)) if directions[j] < 0 else ((low, high),) * 2
            todo += [(2 * node + 1, rows[below], *bounds[0]), (2 * node + 2, rows[~below], *bounds[1])]
    return Trees(feature, threshold, value, prior)


def _best_split(code, g, h, edges, directions, low, high, ridge, least):
    sum_g, sum_h = g.sum(), h.sum()
    gain_of = lambda v, a, b: -(2 * a * v + (b + ridge) * v * v)  # noqa: E731  of giving value v to a node
    whole = gain_of(np.clip(-sum_g / (sum_h + ridge), low, high), sum_g, sum_h)
    best, most = None, whole + 1e-6
    for j, e in enumerate(edges):
        if not len(e):
            continue
        gl, hl, n = (np.cumsum(np.bincount(code[:, j], w, minlength=len(e) + 1))[:-1] for w in (g, h, None))
        left, right = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (sum_g - gl, sum_h - hl)))
        gain = gain_of(left, gl, hl) + gain_of(right, sum_g - gl, sum_h - hl)
        fine = (n >= least) & (len(g) - n >= least) & ((right - left) * directions[j] >= 0)
        gain = np.where(fine, gain, -np.inf)
        c = int(np.argmax(gain))
        if gain[c] > most:
            best, most = (j, c, float(left[c]), float(right[c])), float(gain[c])
    return best


def _matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([stats[f] for f in FEATURES], axis=1).astype(np.float64)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in A.text_slices(batch.column("text")):
            x = _matrix(statistics(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(part.first, part.last - part.first), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"]
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents, chosen by a hash of the id; the fit itself is small NumPy work."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(known), "_id").select("text", "label")
    got = sample.mapInArrow(_features_of, "label int, x array<double>").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["label"].to_numpy(dtype=np.float64) if len(got) else np.zeros(0)
    order = np.lexsort((y, *x.T[::-1])) if len(y) else slice(None)  # the rows arrive in any order
    return fit_trees(x[order], y[order], np.array(list(FEATURES.values())))


def _verdict(stats: dict[str, np.ndarray], trees: Trees, keep_from: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fails the base rules, score, kept) of every text."""
    failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
    score = trees.score(_matrix(stats))
    return failed, score, ~failed & (score >= keep_from)


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Base statistics, base verdict, score and verdict of every document; its other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.text_slices(batch.column("text")):
                stats = statistics(part)
                failed, score, kept = _verdict(stats, trees, keep_from)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(part.first, part.last - part.first),
                        *(pa.array(stats[b].astype(np.int64)) for b in BASE),
                        pa.array(failed), pa.array(score), pa.array(kept),
                    ],
                    ["_id", *BASE, "base_failed", "score", "kept"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).mapInArrow(
        run, f"_id {kind}, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, score double, kept boolean"
    )
    return out.withColumnRenamed("_id", id_col)


def kept_documents(docs: DataFrame, trees: Trees, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were. Judged where they lie: no join, no shuffle."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for part in A.text_slices(batch.column(columns.index(text))):
                kept[part.first : part.last] = _verdict(statistics(part), trees, keep_from)[2]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
