"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into shards of whole documents. A shard's index lists, for each of its terms, the ascending
places where it stands (all words of the shard numbered through, a gap between documents), and is written as one row of a
table: terms, posting bounds, postings, documents. Building and searching a shard needs no other shard, so there is no
shuffle at all, and a very common term costs no more than its own postings.

The benchmark is cut into phrases (windows of consecutive words). In a shard each phrase starts from the postings of its
rarest term and is intersected with the next rarest, each list moved by the term's place in the phrase, until the list is
empty or all terms agree: exact phrase matches. With ``slack`` > 0 proximity matches are returned too: every term within
``slack`` places of where it belongs. All phrases of a shard advance together, one term a step.

Terms are 64-bit hashes of the words. The phrases, at most ``MAX_BENCHMARK_BYTES`` of benchmark text a round, are sent to
all tasks; a larger benchmark is searched in several rounds over the same index, one after the other, each written and its
phrases freed before the next. Rounds are merged by the shard's number and the document's place in it, never by id.

NULL and empty texts have no words, no hits and no items. An item of fewer words than the window is one phrase; one
without words has none. Repeated items and documents each get their own matches. Empty tables give an empty result (no
documents) or no hits (no benchmark). NULL ids stay NULL. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm.tables import buckets_for, given, numbered, result_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
#: Bytes of text in a shard, at most; a longer text is a shard of its own.
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text whose phrases are sent to the tasks at once.
MAX_BENCHMARK_BYTES = 8 << 20
INDEX = "ids binary, firsts binary, terms binary, bounds binary, postings binary"


def terms_of(part: A.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every lower-cased word of a slice."""
    data = A.LOWER[part.data]
    start, end, of = A.word_spans(data, part.bounds, A.ALNUM)
    return A.byte_hashes(data, start, end), of


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: document ids, first place of each document, sorted terms, bounds of their postings, postings.

    To be written before it is searched: the number of a shard holds for the written table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for part in A.text_slices(batch.column("_text"), SHARD_BYTES):
                term, of = terms_of(part)
                place = (np.arange(len(term)) + of).astype(np.uint32)
                count = np.bincount(of, minlength=part.last - part.first)
                firsts = np.concatenate([[0], np.cumsum(count + 1)]).astype(np.int64)
                order = np.argsort(term, kind="stable")
                edges = A.runs(term[order])
                words = term[order[edges[:-1]]] if len(term) else np.zeros(0, A.U64)
                row = (ids[part.first : part.last], firsts, words, edges if len(term) else edges[:1], place[order])
                yield pa.RecordBatch.from_arrays([pa.array([A.pack(x)], pa.binary()) for x in row], ["ids", "firsts", "terms", "bounds", "postings"])

    shards = docs.select(numbered(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, INDEX)
    return shards.withColumn("shard", F.monotonically_increasing_id())


class Phrases:
    """The distinct phrases of a benchmark: terms (phrase, place), their lengths, and the items each stands in."""

    def __init__(self, items: list, texts: list, window: int):
        rows, owners = [], []
        number = {item: i for i, item in enumerate(dict.fromkeys(items))}
        part = next(A.text_slices(pa.array(texts, pa.string()), 1 << 62), None)
        term, of = terms_of(part) if part is not None else (np.zeros(0, A.U64), np.zeros(0, np.int64))
        for item, first, last in zip(range(len(items)), *(np.searchsorted(of, np.arange(len(items)), side=s) for s in ("left", "right")), strict=True):
            words = term[first:last]
            for at in range(max(1, len(words) - window + 1) if len(words) else 0):
                rows.append(words[at : at + window])
                owners.append(number[items[item]])
        self.items = list(number)
        self.length = np.array([len(r) for r in rows], np.int64)
        self.terms = np.zeros((len(rows), window), A.U64)
        for i, r in enumerate(rows):
            self.terms[i, : len(r)] = r
        key = np.concatenate([self.length[:, None].astype(A.U64), self.terms], axis=1)
        key, of_phrase = np.unique(key, axis=0, return_inverse=True) if len(rows) else (key, np.zeros(0, np.int64))
        self.length, self.terms = key[:, 0].astype(np.int64), np.ascontiguousarray(key[:, 1:])
        pairs = np.unique(np.stack([of_phrase.reshape(-1), np.array(owners, np.int64)], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.owners, self.owner_bounds = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.length) + 1))


def search(phrases: Phrases, firsts: np.ndarray, terms: np.ndarray, bounds: np.ndarray, postings: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start place) of the matches in a shard, rarest terms first, all phrases together.

    With ``slack`` the start is where the rarest term puts the phrase; the other terms may stand up to ``slack`` away
    from their places, in the same document.
    """
    n, width = phrases.terms.shape
    none = np.zeros(0, np.int64)
    if not n or not len(terms):
        return none, none
    at = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    used = np.arange(width) < phrases.length[:, None]
    count = np.where(terms[at] == phrases.terms, bounds[at + 1] - bounds[at], 0)
    count = np.where(used, count, np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    alive = np.flatnonzero(count[np.arange(n), order[:, 0]] > 0)
    first = order[alive, 0]
    length = count[alive, first]
    phrase = np.repeat(alive, length)
    start = postings[A.ranges(bounds[at[alive, first]], length)].astype(np.int64) - np.repeat(first, length)
    # A posting list is ascending and its term has one number, so term number and place make one ascending key.
    span = int(firsts[-1]) + width + slack + 1
    keys = np.repeat(np.arange(len(terms)) * span, np.diff(bounds)) + postings
    for step in range(1, width):
        more = phrases.length[phrase] > step
        if not more.any():
            break
        column = order[phrase, step]
        number = at[phrase, column]
        want = start + column
        place = np.searchsorted(keys, number * span + np.maximum(want - slack, 0))
        found = keys[np.minimum(place, len(keys) - 1)]
        fits = (count[phrase, np.minimum(column, width - 1)] > 0) & (found <= number * span + want + slack) & (found >= number * span) & (place < len(keys))
        keep = ~more | fits
        phrase, start = phrase[keep], start[keep]
    # No match starts before its document or reaches over its end (each document is followed by a gap).
    doc = np.searchsorted(firsts, np.maximum(start, 0), side="right") - 1
    doc = np.minimum(doc, len(firsts) - 2)
    inside = (start >= firsts[doc]) & (start + phrases.length[phrase] <= firsts[doc + 1] - 1)
    return phrase[inside], start[inside]


def _round_count(benchmark: DataFrame, text: str) -> int:
    """1 unless the benchmark is larger than ``MAX_BENCHMARK_BYTES``."""
    size = benchmark.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return buckets_for(size, MAX_BENCHMARK_BYTES) if size > MAX_BENCHMARK_BYTES else 1


def _rounds(benchmark: DataFrame, groups: int, item_col: str, text: str) -> Iterator[tuple[list, list]]:
    """The items in ``groups`` groups, collected one at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text).alias("text"))
    for k in range(groups):
        got = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == k).collect()
        got.sort(key=lambda r: (r["item"] is not None, r["item"] or ""))
        yield [r["item"] for r in got], [r["text"] for r in got]


_KINDS = {"ids": np.int64, "firsts": np.int64, "terms": A.U64, "bounds": np.int64, "postings": np.uint32}


def _shard(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in _KINDS.items())


def _matches(index: DataFrame, spread: Broadcast, slack: int, whole: bool = True) -> DataFrame:
    """Per document: shard, place in it, n_words, and of this round: spans of hit words and the items; all or only with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = spread.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, firsts, terms, bounds, postings = _shard(batch, i)
                phrase, start = search(p, firsts, terms, bounds, postings, slack)
                n = len(ids)
                doc = np.searchsorted(firsts, start, side="right") - 1
                if slack:
                    low, high = np.maximum(start - slack, firsts[doc]), np.minimum(start + p.length[phrase] + slack, firsts[doc + 1] - 1)
                else:
                    low, high = start, start + p.length[phrase]
                cover = np.zeros(int(firsts[-1]) + 1, np.int64)
                np.add.at(cover, low, 1)
                np.add.at(cover, high, -1)
                hit = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                begin, end = edge[::2], edge[1::2]
                of = np.searchsorted(firsts, begin, side="right") - 1
                length = p.owner_bounds[phrase + 1] - p.owner_bounds[phrase]
                item = p.owners[A.ranges(p.owner_bounds[phrase], length)]
                pairs = np.unique(np.stack([np.repeat(doc, length), item], axis=1), axis=0)
                cut = np.searchsorted(pairs[:, 0], np.arange(n + 1))
                span = np.searchsorted(of, np.arange(n + 1))
                begin, end = begin - firsts[of], end - firsts[of]
                spans = [[{"start": int(a), "end": int(b)} for a, b in zip(begin[u:v], end[u:v], strict=True)] for u, v in zip(span[:-1], span[1:], strict=True)]
                items = [[p.items[k] for k in pairs[u:v, 1]] for u, v in zip(cut[:-1], cut[1:], strict=True)]
                shard = np.full(n, batch.column("shard")[i].as_py(), np.int64)
                out = pd.DataFrame({"shard": shard, "place": np.arange(n), "doc_id": ids, "n_words": np.diff(firsts) - 1, "spans": spans, "items": items})
                yield pa.RecordBatch.from_pandas(out if whole else out[np.diff(span) > 0], schema=_OUT, preserve_index=False)

    return index.mapInArrow(run, _ROW)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose spans are merged where they overlap or touch."""
    for batch in batches:
        column = batch.column("spans")
        value = column.flatten()
        row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        start, end = (value.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        # Each row's places lie behind all places of the row before, so that a running maximum stays in the row.
        span = int(end.max(initial=0)) + 1
        reach = np.maximum.accumulate(row * span + end) - row * span
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(row)) - 1 if len(at) else at
        merged = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(reach[last])], ["start", "end"])
        merged = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(column) + 1)), pa.int32()), merged)
        yield pa.RecordBatch.from_arrays([merged if n == "spans" else batch.column(n) for n in _OUT.names], schema=_OUT)


_ROW = "shard long, place long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_OUT = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0, id_col: str = "doc_id", text: str = "text",
            item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans of hit words (start, end; merged) and the sorted distinct items that occur, per document.

    ``slack`` 0 gives exact phrase matches, more gives proximity matches. Every row of ``docs`` gives one row. The index
    is a table of the run; ``build_index`` and ``find`` are there for one that is kept.
    """
    return result_of(lambda: find(written(build_index(docs, id_col, text)), benchmark, window, slack, item_col, item_text))


def find(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``matches`` over a stored index. The result does not depend on the number of rounds."""
    context, groups, done = index.sparkSession.sparkContext, _round_count(benchmark, item_text), []
    for k, (items, texts) in enumerate(_rounds(benchmark, groups, item_col, item_text)):
        spread = context.broadcast(Phrases(items, texts, window))
        found = _matches(index, spread, slack, whole=not k)
        if groups > 1:
            found = written(found)
            spread.destroy()
        done.append(found)
    out = done[0]
    if groups > 1:
        each = reduce(DataFrame.unionByName, done).groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        out = each.mapInArrow(_joined, _ROW)
    return out.select(given("doc_id").alias("doc_id"), "n_words", "spans", "items")


def hits(found: DataFrame) -> DataFrame:
    """Digest of ``matches``: n_hit words, n_items, items_sha256 and contaminated, per document."""
    positions = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    return found.select(
        "doc_id", "n_words", F.size(F.array_distinct(positions)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
