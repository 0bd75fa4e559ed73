"""Near duplicates by SimHash: fingerprints of word shingles, pigeonhole blocks, Hamming distance.

A document's words (runs of bytes other than ASCII white space, A-Z lower-cased) give shingles of ``words`` words, repeats
included; fewer words are one shingle as a whole. Bit k of the fingerprint is 1 if bit k is set in over half of the
shingles' XXH64 hashes. Two documents are linked if their fingerprints differ in at most ``distance`` bits.

Documents are merged to distinct fingerprints first, so a group of copies costs one row. The 64 bits are split into
``distance`` + 1 blocks; close fingerprints agree in one of them, so fingerprints meet by block. Where more than ``GROUP``
meet, the block is too common, and the pigeonhole is applied again: these fingerprints agree in the block, so the bits that
are left are split into ``distance`` + 1 blocks, and close pairs agree in one of these too. The bits that are left get
fewer with every level, so at last no group can be larger than ``GROUP``. Every group is compared as a whole in one task,
whose work is bounded; nothing is left out, and no pair leaves its task but as a link to the first of its class.

Defined results: NULL, empty and blank texts have fingerprint zero and are linked like any other. Rows that share an id, or
have none (NULL; it counts as the least id), are documents of their own. An empty table gives an empty result. Ids are
integers. Columns besides id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm import tables
from shelfcast.llm.components import components
from shelfcast.llm.skew import look_up

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
#: Fingerprints compared with one another in one task at once; at least 2 ** (distance + 1).
GROUP = 512
#: Hashes whose bits are counted at once.
COUNTED = 1 << 14
ALL_BITS = (1 << 64) - 1


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    import xxhash

    found = text.translate(A.LOWER.tobytes()).split()
    if not found:
        return np.zeros(0, A.U64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype=A.U64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - words + 1
    del found
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), A.U64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """_id (``tables.NO_ID`` for NULL) and the fingerprint ``fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = A.byte_column(batch.column("_text"))
            made = [fingerprint(shingle_hashes(data[a:b].tobytes(), words)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(made, pa.int64())], ["_id", "fp"])

    return docs.select(tables.numbered(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, "_id long, fp long")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def blocks(mask: int, parts: int) -> list[int]:
    """``mask`` with one of ``parts`` runs of the bits that it leaves free added, for every run."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:b_]) for a, b_ in zip(cuts[:-1], cuts[1:], strict=True)]


def _next_blocks(masks: list[int], parts: int) -> Column:
    pairs = [c for m in masks for c in (F.lit(signed(m)), F.array(*[F.lit(signed(x)) for x in blocks(m, parts)]))]
    return F.element_at(F.create_map(*pairs), F.col("mask"))


def close_in_group(values: np.ndarray, distance: int) -> np.ndarray:
    """For every value the least position it is linked with inside the group, over any number of steps."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    label = near.argmax(axis=1)
    while True:
        reached = np.where(near, label[None, :], len(values)).min(axis=1)
        reached = reached[reached]
        if (reached == label).all():
            return label
        label = reached


def _links(groups: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            values = column.values.to_numpy(zero_copy_only=False).astype(np.int64).view(A.U64)
            bounds = column.offsets.to_numpy()
            src, dst = [np.zeros(0, A.U64)], [np.zeros(0, A.U64)]
            pair = np.flatnonzero(np.diff(bounds) == 2)  # most groups
            a, b = values[bounds[pair]], values[bounds[pair] + 1]
            near = np.bitwise_count(a ^ b) <= distance
            src.append(a[near])
            dst.append(b[near])
            for k in np.flatnonzero(np.diff(bounds) > 2):
                group = np.unique(values[bounds[k] : bounds[k + 1]])
                label = close_in_group(group, distance)
                other = label != np.arange(len(group))
                src.append(group[other])
                dst.append(group[label[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], ["src", "dst"])

    return groups.select("fps").mapInArrow(run, "src long, dst long")


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``): from every one of a group's class to the first, over
    pairs whose distance was verified in the group."""
    spark, parts = fps.sparkSession, distance + 1
    if GROUP < 1 << parts:
        raise ValueError("GROUP is too small for this distance")
    masks, level = [0], fps.select("fp", F.lit(0).cast("long").alias("mask"))
    found = spark.createDataFrame([], "src long, dst long")
    while True:
        rows = level.select("fp", F.explode(_next_blocks(masks, parts)).alias("mask"))
        masks = sorted({b for m in masks for b in blocks(m, parts)})
        rows = tables.written(rows.withColumn("block", F.col("fp").bitwiseAND(F.col("mask"))))
        # One that meets no other in its block has no link there.
        counts = tables.written(rows.groupBy("mask", "block").agg(F.count("*").alias("n")).filter("n > 1"))
        total = rows.count()
        sizes = counts.withColumn("meet", F.col("n"))
        met = tables.written(look_up(rows, sizes, ["mask", "block"], "n", total, "inner"))
        groups = met.filter(F.col("meet") <= GROUP).groupBy("mask", "block").agg(F.collect_list("fp").alias("fps"))
        found = found.union(tables.written(_links(groups, distance)))
        level = met.filter(F.col("meet") > GROUP).select("fp", "mask")
        if not level.limit(1).count():
            return found


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    fps = tables.written(prints.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")))
    found = components(links(fps, distance))
    joined = found.withColumnRenamed("node", "fp").join(fps, "fp")
    classes = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("of_class"))
    named = look_up(found, tables.written(classes), ["component"], "of_class", found.count()).select(F.col("node").alias("fp"), "component_id")
    every = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return look_up(prints, tables.written(every), ["fp"], "n", prints.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the least id reachable over links, of every row."""

    def make() -> DataFrame:
        out = _classes(tables.written(fingerprints(docs, id_col, text, words)), distance)
        return out.select(
            tables.given("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            tables.given("component_id").alias("component_id"),
        )

    return tables.result_of(make)
