"""Alignment of two tokenizers' tokens over whole texts, and how often each pair of ids is linked in the corpus.

Texts are cut before a blank or line feed that follows no white space, and between a letter or digit and a punctuation mark that
no piece holds side by side: no token of either vocabulary crosses such a place, so distinct chunks are encoded and aligned
once and remembered for the next slices. Within a chunk, the tokenizers library gives character offsets and sentencepiece the spans of its proto. The ends both name are
coarse cuts. A token that holds a part of a character, or is a byte of one, has no end of its own there: the stretch
between two coarse cuts that holds such a token is cut further where the decoded bytes of both sides end together. A
chunk whose decoded bytes differ from its text on either side leaves its document without tokens.

Tokens of both sides between two cuts are a group, and all of its pairs are linked. Slices of whole texts are written as
shards of counted links. The number of documents that hold a pair is summed from the shards' distinct pairs, joined back to them
(once for each shard, not for each document), and handed to the shard's documents.

Defined results: NULL and empty texts, and texts that either side changes, have no tokens: zeros and an empty digest. Rows that
share an id, or have none, are documents of their own. An empty table gives an empty result. Special tokens' strings inside
texts are plain text. Columns besides id and text are not read. Ids are integers.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm import pretokens, tables
from shelfcast.llm.token_counts import byte_letters

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text in one shard, about, and chunks encoded at once.
SHARD_BYTES, ENCODED = 2 << 20, 4_096
#: Links of a group that are listed one by one before they are counted.
LARGE_GROUP = 64
BLANK, LINE = 0x20, 0x0A
MARKS = ".,;:!?)]}\"%"
SHARDS = pa.schema([
    ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("digest", pa.list_(pa.string())),
    ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("which", pa.binary()), ("links", pa.binary()),
])
SHARDS_DDL = (
    "shard long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, "
    "pairs array<long>, docs array<long>, held array<long>, which binary, links binary"
)


def chunk_spans(data: np.ndarray, bounds: np.ndarray, parted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of the chunks. ``parted`` tells of two ASCII characters whether texts may be cut between them."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.flatnonzero((data == BLANK) | (data == LINE))
    at = at[at > 0]
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # White space beyond ASCII, or what might be: C2 85, C2 A0, E1 .. .., E2 80 .., E2 81 .., E3 80 80.
    wide = ((two == 0xC2) & np.isin(one, (0x85, 0xA0))) | (three == 0xE1) | ((three == 0xE2) & np.isin(two, (0x80, 0x81))) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    cuts = at[(one > BLANK) & ~(wide & (one >= 0x80))]
    begins = np.zeros(n, bool)
    begins[1:] = parted[data[:-1], data[1:]]
    begins[cuts] = True
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    start = np.flatnonzero(begins)
    return start, np.concatenate([start[1:], [n]]), A.owner(start, bounds)


class Vocabulary:
    """The bytes of every token, and the decimal digits of its id."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.digits = [b"%d" % i for i in range(len(tokens))]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[A.ranges(self.start[ids], self.size[ids])]


@dataclass
class Side:
    """One side's tokens of a run of chunks: ids, the chunk of each, and the ends that the library names."""

    words: Vocabulary
    ids: np.ndarray
    chunk: np.ndarray
    given: np.ndarray

    def ends(self, start: np.ndarray) -> np.ndarray:
        """Where the decoded bytes of each token end."""
        total = np.cumsum(self.words.size[self.ids])
        first = np.searchsorted(self.chunk, np.arange(len(start)))
        before = np.concatenate([[0], total])[first]
        return start[self.chunk] + total - before[self.chunk]

    def differs(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Chunks whose decoded bytes are not their text."""
        n = len(size)
        bad = np.bincount(self.chunk, self.words.size[self.ids], n).astype(np.int64) != size
        even = ~bad[self.chunk]
        decoded, at = self.words.decoded(self.ids[even]), A.ranges(start[~bad], size[~bad])
        bad[np.repeat(np.flatnonzero(~bad), size[~bad])[decoded != data[at]]] = True
        return bad

    def of(self, good: np.ndarray) -> Side:
        keep = good[self.chunk]
        return Side(self.words, self.ids[keep], self.chunk[keep], self.given[keep])


def common_cuts(a_given: np.ndarray, a_true: np.ndarray, b_given: np.ndarray, b_true: np.ndarray) -> np.ndarray:
    """Ends of both sides: the given ends where they are whole characters', decoded bytes in the stretches with a part of one."""
    coarse = np.intersect1d(a_given[a_given == a_true], b_given[b_given == b_true], assume_unique=True)
    a_in, b_in = np.searchsorted(coarse, a_true), np.searchsorted(coarse, b_true)
    parts = np.union1d(a_in[a_given != a_true], b_in[b_given != b_true])
    fine = np.intersect1d(a_true[np.isin(a_in, parts)], b_true[np.isin(b_in, parts)], assume_unique=True)
    return np.union1d(coarse, fine)


class Aligner(pretokens.Distinct):
    """Aligns distinct chunks. A remembered row: ok, tokens of A, of B, groups, then (a, b, links in two halves) of each pair."""

    def __init__(self, file_a: str, model_b: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(file_a)
        self.a.encode_special_tokens = True
        # Chunks hold their own blanks, so the library adds none.
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(model_b)
        model.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        letters = {c: i for i, c in enumerate(byte_letters())}
        tokens = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            tokens[i] = bytes(letters.get(c, 0) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the second vocabulary crosses the cuts between chunks")
        self.words_a = Vocabulary(tokens)
        self.words_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # Between a letter or digit and a mark, unless a piece holds the two; a pre-token of the first side always ends there.
        self.parted = np.zeros((256, 256), bool)
        self.parted[np.ix_([b for b in range(128) if chr(b).isalnum()], [ord(c) for c in MARKS])] = True
        for p in pieces:
            for x, y in zip(p, p[1:], strict=False):
                if ord(x) < 128 and ord(y) < 128:
                    self.parted[ord(x), ord(y)] = False
        super().__init__(self.align)

    def forget(self) -> None:
        super().forget()
        self.digests: list[bytes] = []

    def trim(self) -> None:
        self.forget()  # the rows' digests are numbered like the rows

    def align(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [self.some(chunks[at : at + ENCODED]) for at in range(0, len(chunks), ENCODED)]
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])

    def sides(self, chunks: list[bytes], data: np.ndarray, start: np.ndarray) -> tuple[Side, Side]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        number = np.arange(len(chunks))
        of_a = self.a.encode_batch(texts, add_special_tokens=False)
        ids = [e.ids for e in of_a]
        chunk = np.repeat(number, [len(i) for i in ids])
        lead = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])  # characters' first bytes
        last = np.fromiter((end for e in of_a for _, end in e.offsets), np.int64, len(chunk))
        character = np.searchsorted(lead, start)[chunk] + last
        a = Side(self.words_a, np.fromiter(chain.from_iterable(ids), np.int64, len(chunk)), chunk, lead[np.minimum(character, len(lead) - 1)])
        pieces = [list(p.pieces) for p in self.b.encode(texts, return_type="proto", num_threads=1)]
        chunk = np.repeat(number, [len(p) for p in pieces])
        ids = np.fromiter((p.id for of in pieces for p in of), np.int64, len(chunk))
        return a, Side(self.words_b, ids, chunk, start[chunk] + np.fromiter((p.end for of in pieces for p in of), np.int64, len(chunk)))

    def some(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(chunks)
        data, size = np.frombuffer(b"".join(chunks), np.uint8), np.array([len(c) for c in chunks], np.int64)
        start = np.cumsum(size) - size
        a, b = self.sides(chunks, data, start)
        good = ~(a.differs(data, start, size) | b.differs(data, start, size))
        a, b = a.of(good), b.of(good)
        a_true, b_true = a.ends(start), b.ends(start)
        cuts = common_cuts(a.given, a_true, b.given, b_true)
        a_group, b_group = np.searchsorted(cuts, a_true), np.searchsorted(cuts, b_true)
        of_chunk = np.searchsorted(start, cuts) - 1
        self.digests += self.written(a.ids, a_group, b.ids, b_group, np.searchsorted(of_chunk, np.arange(n + 1)))
        chunk, code, links = self.links(a.ids, a_group, b.ids, b_group, of_chunk)
        pairs = np.bincount(chunk, minlength=n)
        head = np.cumsum(4 + 4 * pairs) - 4 - 4 * pairs
        flat = np.zeros(4 * (n + len(code)), np.int32)
        for k, column in enumerate((good, np.bincount(a.chunk, minlength=n), np.bincount(b.chunk, minlength=n), np.bincount(of_chunk, minlength=n))):
            flat[head + k] = column
        at = np.repeat(head + 4, pairs) + 4 * A.ranges(np.zeros(n, np.int64), pairs)
        for k, column in enumerate((code >> 32, code & 0xFFFFFFFF, links >> 31, links & 0x7FFFFFFF)):
            flat[at + k] = column
        return flat, 4 + 4 * pairs

    def written(self, a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, of_chunk: np.ndarray) -> list[bytes]:
        """The groups of each chunk, as ``a1,a2|b1;a3|b2,b3``."""
        number = np.arange(of_chunk[-1] + 1)
        sides = []
        for words, ids, group in ((self.words_a, a_ids, a_group), (self.words_b, b_ids, b_group)):
            digits = [words.digits[i] for i in ids.tolist()]
            at = np.searchsorted(group, number).tolist()
            sides.append([digits[i] if j == i + 1 else b",".join(digits[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
        groups = [x + b"|" + y for x, y in zip(*sides, strict=True)]
        at = of_chunk.tolist()
        return [b";".join(groups[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]

    def links(self, a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, of_chunk: np.ndarray) -> tuple[np.ndarray, ...]:
        """chunk, pair and number of links, each pair once in a chunk. Large groups go by distinct ids, as repeats in them multiply."""
        n = len(of_chunk)
        a_size, b_size = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        a_first, b_first = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        large = a_size * b_size > LARGE_GROUP
        each = np.flatnonzero(~large[a_group])
        often = b_size[a_group[each]]
        left = np.repeat(each, often)
        right = A.ranges(b_first[a_group[each]], often)
        parts = [(of_chunk[a_group[left]], (a_ids[left] << 32) | b_ids[right], np.ones(len(left), np.int64))]
        for g in np.flatnonzero(large).tolist():
            x, x_often = np.unique(a_ids[a_first[g] : a_first[g] + a_size[g]], return_counts=True)
            y, y_often = np.unique(b_ids[b_first[g] : b_first[g] + b_size[g]], return_counts=True)
            code = ((x << 32)[:, None] | y[None, :]).reshape(-1)
            parts.append((np.full(len(code), of_chunk[g]), code, (x_often[:, None] * y_often[None, :]).reshape(-1)))
        chunk, code, links = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((code, chunk))
        chunk, code, links = chunk[order], code[order], links[order]
        new = np.ones(len(code), bool)
        new[1:] = (chunk[1:] != chunk[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        return chunk[first], code[first], np.add.reduceat(links, first) if len(first) else links


class Memory:
    """The vocabulary files, broadcast; a Python worker's tasks share what they learned from them."""

    def __init__(self, file_a: str, model_b: bytes):
        self.files, self.made = (file_a, model_b), None

    def __getstate__(self) -> dict:
        return {"files": self.files, "made": None}

    def get(self) -> Aligner:
        if self.made is None:
            self.made = Aligner(*self.files)
        return self.made


def with_blank(part: A.Slice) -> A.Slice:
    """A blank before every text that is not empty."""
    size = np.diff(part.bounds)
    given = size > 0
    bounds = np.concatenate([[0], np.cumsum(size + given)])
    data = np.full(bounds[-1], BLANK, np.uint8)
    data[np.arange(len(part.data)) + np.repeat(np.cumsum(given), size)] = part.data
    return A.Slice(part.first, part.last, data, bounds)


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(A.pack(values), codec="zstd", asbytes=True)


def _unsqueezed(packed: bytes, n: int, kind: type) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def shard_of(part: A.Slice, ids: list, aligner: Aligner, number: int) -> dict[str, list]:
    part = with_blank(part)
    begin, end, text = chunk_spans(part.data, part.bounds, aligner.parted)
    n = len(part.bounds) - 1
    row = aligner.look_up(part, begin, end)
    head = aligner.bounds[row]
    flat = aligner.flat
    of_text = np.searchsorted(text, np.arange(n + 1))
    ok = _sums(flat[head] == 0, of_text) == 0 if len(row) else np.ones(n, bool)
    n_a, n_b, n_groups = (_sums(flat[head + k] if len(row) else head, of_text) * ok for k in (1, 2, 3))
    digest = [
        hashlib.sha256(b";".join([aligner.digests[r] for r in row[a:b].tolist()])).hexdigest() if good and b > a else ""
        for a, b, good in zip(of_text[:-1].tolist(), of_text[1:].tolist(), ok.tolist(), strict=True)
    ]
    # Links of each (text, distinct chunk), then of each (text, pair).
    use = ok[text] if len(text) else np.zeros(0, bool)
    key, often = np.unique((text[use].astype(np.int64) << 32) | row[use].astype(np.int64), return_counts=True)
    chunk = key & 0xFFFFFFFF
    pairs_of = (aligner.bounds[chunk + 1] - aligner.bounds[chunk] - 4) // 4
    at = np.repeat(aligner.bounds[chunk] + 4, pairs_of) + 4 * A.ranges(np.zeros(len(pairs_of), np.int64), pairs_of)
    code = (flat[at].astype(np.int64) << 32) | flat[at + 1]
    links = ((flat[at + 2].astype(np.int64) << 31) | flat[at + 3]) * np.repeat(often, pairs_of)
    pairs, which = np.unique(code, return_inverse=True)
    held, first = np.unique((np.repeat(key >> 32, pairs_of) * max(len(pairs), 1)) + which.reshape(-1), return_inverse=True)
    total = np.zeros(len(held), np.int64)
    np.add.at(total, first.reshape(-1), links)
    owner, which = held // max(len(pairs), 1), held % max(len(pairs), 1)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return {
        "shard": [number], "ids": [ids], "n_a": [n_a], "n_b": [n_b], "n_groups": [n_groups], "n_links": [_sums(total, bounds)],
        "digest": [digest], "pairs": [pairs], "docs": [np.bincount(which, minlength=len(pairs))], "held": [np.diff(bounds)],
        "which": [_squeezed(which.astype(np.uint32))], "links": [_squeezed(total)],
    }


def shards(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The counted links of all texts, one row per slice of whole texts, written. Files are paths on the driver."""
    with open(file_a, encoding="utf-8") as a, open(file_b, "rb") as b:
        memory = docs.sparkSession.sparkContext.broadcast(Memory(a.read(), b.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = memory.value.get(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("_id")
            for part in A.text_slices(batch.column("_text"), SHARD_BYTES):
                made = shard_of(part, ids[part.first : part.last].to_pylist(), aligner, number)
                yield pa.RecordBatch.from_pydict(made, schema=SHARDS)
                number += 1

    return tables.written(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, SHARDS_DDL))


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair (id of A in the upper half, of B in the lower), n_docs that hold it, and whether no pair of this id of A has more; written."""
    each = parts.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.*")
    counts = tables.written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n_docs")).withColumn("a", F.shiftright("pair", 32)))
    # One row per entry of the first vocabulary, whatever the corpus.
    best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return tables.written(counts.join(F.broadcast(best), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best")))


def token_map(docs: DataFrame, file_a: str, file_b: str, **columns: str) -> DataFrame:
    """id_a, id_b, n_docs, is_best of every pair of ids linked anywhere."""

    def make() -> DataFrame:
        return pair_counts(shards(docs, file_a, file_b, **columns)).select(
            F.shiftright("pair", 32).alias("id_a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("id_b"), "n_docs", "is_best"
        )

    return tables.result_of(make)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each shard, with what the corpus says of their links."""
    for batch in batches:
        for k in range(batch.num_rows):
            given = {name: batch.column(name)[k] for name in batch.schema.names}
            held = given["held"].values.to_numpy()
            bounds = np.concatenate([[0], np.cumsum(held)])
            which = _unsqueezed(given["which"].as_py(), bounds[-1], np.uint32)
            links = _unsqueezed(given["links"].as_py(), bounds[-1], np.int64)
            corpus = given["corpus"].values
            if corpus is None or not len(corpus):
                n_docs, best = np.zeros(1, np.int64), np.zeros(1, bool)
            else:
                pair, n_docs, best = (x.to_numpy(zero_copy_only=False) for x in corpus.flatten())
                order = np.argsort(pair)
                n_docs, best = n_docs[order], best[order]
            columns = [given[c].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
            columns += [pa.array(_sums(links * best[which], bounds)), pa.array(_sums(links * n_docs[which], bounds)), given["digest"].values]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""

    def make() -> DataFrame:
        parts = shards(docs, file_a, file_b, id_col, text)
        counts = pair_counts(parts)
        wanted = parts.select("shard", F.explode("pairs").alias("pair")).join(counts, "pair")
        corpus = wanted.groupBy("shard").agg(F.collect_list(F.struct("pair", "n_docs", "is_best")).alias("corpus"))
        rows = parts.drop("pairs", "docs").join(corpus, "shard", "left")
        out = "_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return rows.drop("shard").mapInArrow(_judged, out).withColumnRenamed("_id", id_col)

    return tables.result_of(make)
