"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a random but repeatable order, repeated ``max_repeats`` times. A copy's
virtual finish time is the running number of its source's words, itself included, over the source's target. The mix
takes copies in the order of their finish times (ties: source, round, order key, id) until the total budget is used up,
so all sources reach their targets together and a prefix of the mix has the target proportions as well.

Both orders are global, and neither is built in one task: a running sum is the offset of a row's bucket (a small table
of bucket sums) plus the running sum inside the bucket. Buckets are ranges of the order, made as many as the rows need,
so a source with a third of all rows is spread like any other. Only the bucket in which the budget ends is cut.

Targets: sources by code point, NULL last, weigh ``weights`` in turn and share ``budget_share`` of all words. No target
exceeds ``max_repeats`` times its source's words; the excess is shared again by weight. NULL and empty texts have size 0
and are taken 0 words. A source without words has target 0. Rows with the same id and text are separate documents with
separate places; an empty table gives an empty result. Columns besides id, text and source are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm.tables import result_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
#: Alike rows listed from one array at most.
LISTED = 10_000
#: Rows of one bucket of a running order, about, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 5_000, 64


def sized(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """id, source, hash of the text and size in words of every document; the text goes no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for part in A.text_slices(batch.column("_text")):
                inside = A.NOT_SPACE[part.data]
                starts = inside.copy()
                starts[1:] &= ~inside[:-1]
                at = part.bounds[:-1][part.bounds[:-1] < len(part.data)]
                starts[at] = inside[at]
                total = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
                size[part.first : part.last] = total[part.bounds[1:]] - total[part.bounds[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_source", "_mark")), pa.array(size)], ["_id", "_source", "_mark", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("_id"), F.col(source).cast("string").alias("_source"), mark(text).alias("_mark"), F.col(text).alias("_text")]
    return docs.select(*cols).mapInArrow(run, f"_id {kind}, _source string, _mark long, size long")


def mark(text: str) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.col(text))


def order_key(id_col: Column, round_: Column) -> Column:
    """The place of a copy in its source's queue: a hash of id and round, as 12 hexadecimal digits' number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", id_col.cast("string"), round_.cast("string"))), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget_share: float, max_repeats: int) -> DataFrame:
    """_source, source_size, target. One row per source; the level at which sources are full is a closed form.

    Sources whose cap over weight lies below the level get their cap, the others level times weight. In the order of
    cap over weight the level is (budget - caps so far) / (weights not yet full).
    """
    totals = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "budget": F.sum("source_size").over(everything) * float(budget_share),
        "caps_before": F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0)),
        "weights_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)),
    })
    rows = rows.withColumn("full", F.col("cap") * F.col("weights_left") <= (F.col("budget") - F.col("caps_before")) * F.col("weight"))
    # From the first source that is not full on, the quotient only falls: the level is its largest value.
    rows = rows.withColumn("level", F.max(F.when(~F.col("full"), (F.col("budget") - F.col("caps_before")) / F.col("weights_left"))).over(everything))
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return rows.select("_source", "source_size", target.alias("target"))


def running(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """The running sum of ``value`` in each group, itself included: sums of the buckets before, and a window inside one."""
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum(value).over(inside))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_bucket"]]
    joined = rows.alias("a").join(sums.alias("b"), [*same], "left")
    return joined.select("a.*", (F.col("_inside") + F.col("_before")).alias(out)).drop("_bucket", "_inside")


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS,
          id_col: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sizes with targets, one row per document; the copies that the mix takes, with round and finish time)."""
    sizes = written(sized(docs, id_col, text, source))
    targets = source_targets(sizes, weights, budget_share, max_repeats)
    stats = sizes.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    n, budget = stats["n"], float(stats["words"] or 0) * budget_share
    # Buckets are equal ranges of a hash, or of the finish time, so they hold about BUCKET_ROWS rows each.
    parts = max(LEAST_BUCKETS, n // BUCKET_ROWS)
    sizes = sizes.alias("a").join(targets.alias("b"), F.col("a._source").eqNullSafe(F.col("b._source")), "left").select("a.*", "source_size", "target")
    copies = sizes.filter("size > 0").select("*", F.explode(F.array(*[F.lit(r) for r in range(max_repeats)])).alias("round"))
    copies = copies.withColumn("key", order_key(F.col("_id"), F.col("round")))
    # Divided first: the product of key and buckets would not fit 64 bits for many documents. The quotient is exact.
    slot = F.col("round") * F.lit(parts).cast("long") + F.floor(F.col("key") / float(16**12) * parts).cast("long")
    in_source = running(copies, ["_source"], slot, [F.col("round"), F.col("key"), F.col("_id"), F.col("size")], "size", "words_so_far")
    timed = in_source.withColumn("finish", F.col("words_so_far") / F.col("target"))
    lane = F.floor(F.col("finish") * parts * max_repeats)
    order = [F.col(c) for c in ("finish", "_source", "round", "key", "_id", "size")]
    timed = timed.withColumn("_all", F.lit(0))
    mixed = running(timed, ["_all"], lane, order, "size", "mix_words")
    return sizes, mixed.filter(F.col("mix_words") <= budget).drop("_all")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS,
        id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, size, source_size, target and the words the mix takes of every document: a few numbers each, written.

    Ids need not be unique; rows that share id, source and size share what is taken evenly, as their copies are alike.
    """
    return result_of(lambda: _taken(*queue(docs, weights, budget_share, max_repeats, id_col, text, source), id_col))


def _shares(sizes: DataFrame, taken: DataFrame) -> DataFrame:
    """How many copies the mix takes of all rows alike in id, source and text (``copies``), and how many such rows there are."""
    keys = ["_id", "_source", "_mark", "size"]
    per = taken.groupBy(*keys).agg(F.count("*").alias("copies"))
    twins = sizes.groupBy(*keys, "source_size", "target").agg(F.count("*").alias("twins"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    return twins.alias("a").join(per.alias("b"), same, "left").select("a.*", F.coalesce("copies", F.lit(0)).alias("copies"))


def _nth_share(nth: Column) -> Column:
    """Copies of the nth row (from 0) among rows that are alike."""
    return F.floor(F.col("copies") / F.col("twins")).cast("long") + (nth < F.col("copies") % F.col("twins")).cast("long")


def _taken(sizes: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    out = _shares(sizes, taken)
    alone = out.filter("twins = 1").withColumn("share", F.col("copies"))
    # Alike rows come in two kinds only: with one copy more, and without.
    more, rest = F.col("copies") % F.col("twins"), F.floor(F.col("copies") / F.col("twins")).cast("long")
    kinds = F.array(F.struct((rest + 1).alias("share"), more.alias("rows")), F.struct(rest.alias("share"), (F.col("twins") - more).alias("rows")))
    alike = out.filter("twins > 1").select("*", F.inline(kinds)).filter("rows > 0")
    # Long runs are listed in pieces, so that no row holds one array for all of them.
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / LISTED).cast("long")))
    alike = alike.withColumn("_piece", piece).withColumn("_rows", F.least(F.lit(LISTED), F.col("rows") - F.col("_piece") * LISTED).cast("int"))
    alike = alike.withColumn("_one", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))))
    columns = ["_id", "size", "source_size", "target", "share"]
    each = alone.select(*columns).unionByName(alike.select(*columns))
    return each.select(
        F.col("_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("share") * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                    budget_share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``max_repeats`` times), all columns kept.

    Rows are told apart by id, source and text. The join is a shuffled one at every size, as the list of ids grows with the rows.
    """
    copies = result_of(lambda: _shares(*queue(docs, weights, budget_share, max_repeats, id_col, text, source))).filter("copies > 0")
    copies = copies.select(F.struct("_id", "_source", "_mark").alias("_key"), "copies", "twins")
    rows = docs.withColumn("_key", F.struct(F.col(id_col).alias("_id"), F.col(source).cast("string").alias("_source"), mark(text).alias("_mark")))
    rows = rows.join(copies.hint("shuffle_hash"), "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))) - 1
    alone = rows.filter("twins = 1").withColumn("_copies", F.col("copies"))
    alike = rows.filter("twins > 1").withColumn("_copies", _nth_share(nth))
    out = alone.unionByName(alike).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
