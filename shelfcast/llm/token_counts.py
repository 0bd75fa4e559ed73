"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a slice are one ragged array of symbols, at first their bytes. In every round each sequence
finds its merge of lowest rank among all its neighbouring pairs and applies it wherever that pair stands (left to right
where occurrences overlap); all sequences do so at once. Sequences without a pair in the merge table are done, and their
surviving symbols are counted. This equals merging one pair at a time: a new symbol's own merges always rank later.

Counts go from distinct pre-tokens to occurrences to documents. NULL and empty texts have 0 tokens and 0 bytes; repeated
documents are counted each; an empty table gives an empty result. Special strings inside texts count as one token, as the
library has it. Columns besides id and text are not read.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm import pretokens as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 1024
_NEVER = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge table of a byte-level vocabulary as a hash table of pairs."""

    def __init__(self, file: str):
        model = json.loads(file)["model"]
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.bits = max(10, int(len(pairs) * 8).bit_length())
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NEVER, np.int32)
        key, rank = (left << 32) | right, np.arange(len(pairs), dtype=np.int32)
        at = self._home(key)
        while len(key):  # each round places one key in every free slot; the rest moves on by one
            free = self.key[at] < 0
            _, chosen = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[chosen]
            self.key[at[chosen]], self.rank[at[chosen]] = key[chosen], rank[chosen]
            rest = np.ones(len(key), bool)
            rest[chosen] = False
            key, rank, at = key[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (A.mix(key.astype(A.U64)) >> A.U64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = self._home(key)
        out = np.full(len(key), _NEVER, np.int32)
        there = self.key[at]
        same = there == key
        out[same] = self.rank[at[same]]
        open_ = np.flatnonzero(~same & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.key[at[open_]]
            same = there == key[open_]
            out[open_[same]] = self.rank[at[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out

    def count(self, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Symbols that survive of every sequence of a ragged array. length: of each, at least 1."""
        out = length.copy()
        number = np.arange(len(length))
        sequence = np.repeat(number, length)
        while len(symbols):
            rank = np.full(len(symbols), _NEVER, np.int32)
            inner = np.flatnonzero(sequence[1:] == sequence[:-1])
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            starts = A.runs(sequence)[:-1]
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(symbols)))
            going = lowest < _NEVER
            done = ~going
            out[sequence[starts[done]]] = size[done]
            lowest = np.repeat(lowest, size)
            hit = (rank == lowest) & (lowest < _NEVER)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # In a run of overlapping hits, every other one is applied.
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            offset = at - np.repeat(at[fresh], np.diff(np.append(np.flatnonzero(fresh), len(at))))
            at = at[offset % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(going, size)
            keep[at + 1] = False
            symbols, sequence = symbols[keep], sequence[keep]
        return out

    def count_bytes(self, words: list[bytes], specials: list[str]) -> np.ndarray:
        length = np.array([len(w) for w in words], dtype=np.int64)
        out = self.count(self.of_byte[np.frombuffer(b"".join(words), np.uint8)], length)
        marks = {s.encode() for s in specials}
        for i, w in enumerate(words):
            if w in marks:
                out[i] = 1
        return out


def _counter(file: str, specials: list[str]):
    merges = Merges(file)
    return lambda words: (merges.count_bytes(words, specials), np.ones(len(words), np.int64))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every document. tokenizer: path of a byte-level BPE file, read by the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        memory = docs.sparkSession.sparkContext.broadcast(P.Memory(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, specials = memory.value.get(_counter)
        for batch in batches:
            for part in A.text_slices(batch.column("_text")):
                begin, end, of = P.pretokens(part, specials)
                number = known.look_up(part, begin, end)
                each = known.flat[known.bounds[number]]
                n = np.bincount(of, each, minlength=part.last - part.first).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(part.first, part.last - part.first), pa.array(np.diff(part.bounds)), pa.array(n), pa.array(n > limit)],
                    ["_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("_id", id_col)
