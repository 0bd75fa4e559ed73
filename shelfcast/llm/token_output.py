"""Token ids as files of canonical, length-limited Huffman codes.

Writing takes three passes. The documents are range-partitioned by id and tokenised, each with the end id appended, into
blocks of whole documents; the ids of a block are stored raw in the shared folder. The ids are counted over all blocks,
in each task first; from the counts (one per vocabulary entry) the driver builds code lengths by package-merge, none over
``MAX_BITS``, and canonical codes follow from lengths alone. Then every block is packed on its own.

A file set is two tables: ``blocks`` (part, block, start, doc_ids, counts, checkpoints, payload) in ascending order of
id, where ``start`` is the number of ids before the block, and ``codes`` (token, bits). A checkpoint is the bit offset of
every ``EVERY``-th id of a block, so a reader can begin there. The decoder begins at all checkpoints of a block at once:
in each step it looks the next ``MAX_BITS`` bits of every lane up in one table, which gives an id and its bits.

NULL and empty texts have only the end id. A NULL id stands before all others. Documents with the same id follow each other in the order of their texts.
An empty table gives two empty tables. Columns besides id and text are not read. A document longer than a block is a
block of its own.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm import pretokens as P
from shelfcast.llm import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 0
MAX_BITS = 20
#: Ids from one checkpoint to the next.
EVERY = 256
#: A block ends with the document that reaches so many ids.
BLOCK_IDS = 1 << 18

_RAW = "part int, block int, start long, doc_ids binary, counts binary, ids binary"
_BLOCKS = "part int, block int, start long, doc_ids binary, counts binary, checkpoints binary, payload binary"


#: Words that are encoded as one text.
JOINED = 500
#: Stands for the blank in the strings of a byte-level vocabulary.
BLANK = "Ġ"


def _encoder(file: str, _: list[str]):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file)

    opens = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    opens[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token[0] == BLANK]] = True

    def alone(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([x for i in ids for x in i], dtype=np.int64), np.array([len(i) for i in ids], dtype=np.int64)

    def joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that are a blank and letters stay apart in a text of nothing else, which the library encodes faster.

        The blank is nowhere else in them, so each begins at an id whose string begins with it.
        """
        ids, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        parts = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for part, e in zip(parts, tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            some = np.array(e.ids, dtype=np.int64)
            first = np.flatnonzero(opens[some])
            size = np.diff(first, append=len(some))
            some, size = (some, size) if len(first) == len(part) and first[0] == 0 else alone(part)
            ids.append(some)
            length.append(size)
        return np.concatenate(ids), np.concatenate(length)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        plain = np.array([t[0] == " " and t[1:].isalpha() for t in texts], dtype=bool)
        length, sides = np.zeros(len(words), np.int64), []
        for which, how in ((plain, joined), (~plain, alone)):
            some, length[which] = how([texts[i] for i in np.flatnonzero(which).tolist()])
            sides.append((which, some))
        start, ids = np.cumsum(length) - length, np.zeros(length.sum(), np.int64)
        for which, some in sides:
            ids[A.ranges(start[which], length[which])] = some
        return ids, length

    return encode


def raw_kind(file: str, end_id: int) -> type[np.unsignedinteger]:
    """The number type of raw ids: 16-bit where all ids of the tokenizer file's content, and the end id, allow it."""
    made = json.loads(file)
    top = max([end_id, *made["model"]["vocab"].values(), *(t["id"] for t in made["added_tokens"])])
    return np.uint16 if top < 1 << 16 else np.uint32


def tokenised(docs: DataFrame, file: str, end_id: int, id_col: str, text: str) -> DataFrame:
    """Blocks of raw ids (of ``raw_kind``) of documents in ascending order of id. file: the tokenizer file's content."""
    memory = docs.sparkSession.sparkContext.broadcast(P.Memory(file))
    kind = raw_kind(file, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left behind
        known, specials = memory.value.get(_encoder)
        part_number, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nonlocal block, start
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = (part_number, block, start, A.pack(doc_ids), A.pack(counts.astype(np.uint32)), A.pack(ids))
            block, start = block + 1, start + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)],
                ["part", "block", "start", "doc_ids", "counts", "ids"],
            )

        size = 0
        for batch in batches:
            doc_ids = batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for part in A.text_slices(batch.column("_text")):
                begin, end, of = P.pretokens(part, specials)
                number = known.look_up(part, begin, end)
                length = np.diff(known.bounds)[number]
                n = part.last - part.first
                count = np.bincount(of, length, minlength=n).astype(np.int64)
                flat = known.flat[A.ranges(known.bounds[number], length)]
                ids = np.full(len(flat) + n, end_id, kind)
                ids[np.arange(len(flat)) + np.repeat(np.arange(n), count)] = flat
                held.append((doc_ids[part.first : part.last], count + 1, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield out()
                    size = 0
        if held:
            yield out()

    # Ranges of id and text hash: rows that share an id, or have none, spread over the tasks like others.
    rows = docs.select(tables.numbered(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_mark"), F.col(text).alias("_text"))
    return rows.repartitionByRange("_id", "_mark").sortWithinPartitions("_id", "_mark").select("_id", "_text").mapInArrow(run, _RAW)


def id_counts(raw: DataFrame, kind: type[np.unsignedinteger]) -> DataFrame:
    """token, n over all blocks: summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                more = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(total[token].astype(np.int64))], ["token", "n"])

    return raw.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code for the counts, none over ``max_bits``: package-merge.

    counts: of each symbol, all above 0. A level's list holds the symbols and the pairs of the list below, by weight; of
    the last list the first 2n - 2 are taken, and a taken pair takes its two parts one level below. A symbol's length is
    the number of lists in which it is taken.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols have no code of at most {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    levels = []
    pairs = np.zeros(0, np.int64)
    for _ in range(max_bits):
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        merged = both[place]
        merged = merged[: len(merged) // 2 * 2]
        pairs = merged[::2] + merged[1::2]
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = length
    return out


def canonical(tokens: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bits, codes) in canonical order: by length, then token; each code is the one before plus 1, widened."""
    order = np.lexsort((tokens, bits))
    tokens, bits = tokens[order], bits[order]
    top = int(bits.max()) if len(bits) else 0
    steps = np.int64(1) << (top - bits)
    codes = (np.cumsum(steps) - steps) >> (top - bits)
    return tokens, bits, codes


def pack_bits(ids: np.ndarray, code_of: np.ndarray, bits_of: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """(payload, bit offsets of every ``every``-th id): the codes of the ids, highest bit first."""
    bits = bits_of[ids].astype(np.int64)
    end = np.cumsum(bits)
    at = end - bits
    total = int(end[-1]) if len(end) else 0
    # A code lies in at most two words of 32 bits; the parts of one word have no bit in common, so their sum joins them.
    value = code_of[ids].astype(np.uint64) << (np.uint64(64) - (at & 31).astype(np.uint64) - bits.astype(np.uint64))
    word = at >> 5
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), minlength=total // 32 + 3)
    words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words))[: len(words)]
    payload = words.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8]
    return payload, at[::every].astype(np.uint64)


class Decoder:
    """One table for the next ``width`` bits: the id they begin with, and its bits."""

    def __init__(self, tokens: np.ndarray, bits: np.ndarray):
        tokens, bits, _ = canonical(tokens, bits)
        self.width = int(bits.max()) if len(bits) else 1
        self.id = np.zeros(1 << self.width, np.uint32)
        self.bits = np.ones(1 << self.width, np.uint8)
        span = np.int64(1) << (self.width - bits)
        n = int(span.sum())
        self.id[:n], self.bits[:n] = np.repeat(tokens, span), np.repeat(bits, span)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, every: int = EVERY) -> np.ndarray:
        """The ``n`` ids of a block; every checkpoint is a lane, and all lanes advance together."""
        data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)])
        # The 32 bits from each byte on; a code of at most 24 bits lies within them wherever it begins.
        wide = data[:-3].astype(np.uint32)
        for k in range(1, 4):
            wide = (wide << np.uint32(8)) | data[k : len(data) - 3 + k]
        lanes = len(checkpoints)
        out = np.zeros((every, lanes), np.uint32)
        at = checkpoints.astype(np.int64)
        last = n - (lanes - 1) * every
        keep, shift = np.uint32((1 << self.width) - 1), 32 - self.width
        for k in range(every):
            if k == last:  # the last lane is shorter
                at = at[:-1]
            if not len(at):
                break
            look = (wide[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & keep
            out[k, : len(at)] = self.id[look]
            at = at + self.bits[look]
        return out.T.reshape(-1)[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> None:
    """Encode all documents into the file set at ``path``."""
    if not 0 < max_bits <= 24:
        raise ValueError("a table lookup reads at most 24 bits")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    kind = raw_kind(file, end_id)
    raw, kept = tables.written_at(tokenised(docs, file, end_id, id_col, text))
    with tables.small_batches(spark):
        counts = id_counts(raw, kind).orderBy("token").toPandas()  # at most one row per vocabulary entry
    tokens = counts["token"].to_numpy(np.int64)
    bits = code_lengths(counts["n"].to_numpy(np.int64), max_bits)
    spark.createDataFrame([(int(t), int(b)) for t, b in zip(tokens, bits, strict=True)], "token long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    token, length, code = canonical(tokens, bits)
    size = int(token.max()) + 1 if len(token) else 1
    code_of, bits_of = np.zeros(size, np.int64), np.zeros(size, np.uint8)
    code_of[token], bits_of[token] = code, length
    # Ids of each range partition: as many numbers as partitions.
    ids = raw.groupBy("part").agg((F.sum(F.octet_length("ids")) / np.dtype(kind).itemsize).cast("long").alias("n")).orderBy("part").collect()
    first = dict(zip((r["part"] for r in ids), np.cumsum([0, *(r["n"] for r in ids)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), kind)
                payload, marks = pack_bits(ids, code_of, bits_of)
                start = batch.column("start")[i].as_py() + first[batch.column("part")[i].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("part").slice(i, 1), batch.column("block").slice(i, 1), pa.array([start], pa.int64()),
                        batch.column("doc_ids").slice(i, 1), batch.column("counts").slice(i, 1),
                        pa.array([A.pack(marks)], pa.binary()), pa.array([payload], pa.binary()),
                    ],
                    ["part", "block", "start", "doc_ids", "counts", "checkpoints", "payload"],
                )

    with tables.small_batches(spark):
        raw.mapInArrow(run, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    tables.delete(spark, kept)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids, little-endian 32-bit, as ``ids``) of every document of a file set."""
    codes = spark.read.parquet(f"{path}/codes").toPandas()
    tokens, bits = codes["token"].to_numpy(np.int64), codes["bits"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokens, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind, i=i: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                count = get("counts", np.uint32).astype(np.int64)
                ends = np.cumsum(count)
                ids = decoder.decode(batch.column("payload")[i].as_buffer(), get("checkpoints", np.uint64), int(ends[-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                pieces = [raw[4 * a : 4 * b] for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(get("doc_ids", np.int64)), pa.array(batch.column("start")[i].as_py() + ends - count), pa.array(count),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns + ([pa.array([bytes(p) for p in pieces], pa.binary())] if with_ids else []),
                    ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids,
                )

    blocks = spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "counts", "checkpoints", "payload")
    rows = blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return rows.withColumn("doc_id", tables.given("doc_id"))
