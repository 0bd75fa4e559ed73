"""Line dedup by content-defined chunks of lines. DataFrame functions only.

The lines of a document are hashed, and a rolling hash over ``WINDOW`` lines ends a chunk where it is 0 modulo
``DIVISOR``. A boundary depends on nothing but the lines before it, so inserted or deleted lines move the chunks near
them and no others. Lines of whitespace alone count for no length: a *multi-line* chunk holds ``LEAST_LINES`` other lines.

1. A multi-line chunk whose bytes stand elsewhere too goes everywhere but at its first occurrence (least id, then place).
2. What chunks miss, the lines of a repeated passage before its first boundary and after its last, and passages shorter
   than a chunk, is found at the seams: a window runs from one line with content to the next, blank lines between
   included, and goes where its bytes also start earlier. Windows inside a chunk that step 1 removes are not looked at:
   the first occurrence of the chunk holds them too.

So every line in a passage of two or more lines that also stands earlier goes, and no line goes for itself alone.

Chunks meet by their MD5, windows by a 64-bit hash, as narrow rows that are counted in each task before the shuffle.
Only what was seen twice fetches its text, and is then grouped by SHA-256 and text, which compares the bytes and merges
common bodies in each task. Occurrences go by the SHA-256 of a body once it is known to stand for one body only; were there
ever two, both would be kept. Keys that hold many rows are looked up without a shuffle (``skew.look_up``). Both joins with
the texts share one shuffle of them.

NULL texts have no lines, empty texts one empty line; both are kept as empty. Every row is a document of its own, also
where rows share an id or have none: such rows are ordered by a hash of their texts, and NULL ids stand before all others.
Rows of the same id and text go as one, and what can be removed from all but one of them is. An empty table gives an empty
result. Columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import tables
from shelfcast.llm.skew import look_up

WINDOW, DIVISOR, LEAST_LINES = 2, 3, 2
_FACTOR = 31
#: A line with content holds a character that is no whitespace.
CONTENT = r"[^ \t\n\x0B\f\r]"
_WINDOWS = "array<struct<start:int,n:int,h:bigint>>"


def _no_places() -> Column:
    return F.array().cast("array<int>")


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 10), 16, 10).cast("long")


def body_hash(body: Column) -> Column:
    """The key by which bodies meet before their bytes are compared."""
    return F.xxhash64(body)


def different_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_id, _text, _hash of the text, and how many rows are the same; the texts are only compared if there are such rows."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    if rows.groupBy("_id", "_hash").agg(F.count("*").alias("copies")).filter("copies > 1").limit(1).count():
        return rows.groupBy("_id", "_hash", "_text").agg(F.count("*").alias("copies"))
    return rows.withColumn("copies", F.lit(1).cast("long"))


def _of_rows(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``rows`` with what is found for each. Shuffled at every size, as both grow together; only ``found`` is held in memory."""
    found = found.withColumnsRenamed({"_id": "_of", "_hash": "_of_hash"}).hint("shuffle_hash")
    return rows.join(found, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_of_hash")), how).drop("_of", "_of_hash")


def _lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lines", F.coalesce(F.split("_text", "\n", -1), F.array().cast("array<string>"))).drop("_text")


def _body(start: Column, n: Column) -> Column:
    """``n`` lines from ``start`` on. The size beside the lines keeps them a column of their own: used once only, they would
    be inlined, and the text split again for every element."""
    return F.when(F.size("lines") >= start + n, F.array_join(F.slice("lines", start + 1, n), "\n"))


def _up_to(stop: Column, start: Column | int = 0) -> Column:
    """Places from ``start`` to before ``stop``."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.when(stop > start, F.sequence(start, stop - 1)).otherwise(_no_places())


def with_units(rows: DataFrame, window: int, divisor: int, least: int) -> DataFrame:
    """_id, _hash, copies, n_lines, chunks: (start, n, h, windows) in order, h NULL if not multi-line; seams: windows across chunks."""
    at = lambda i, j: F.element_at("hashes", (i - j + 1).cast("int")) * F.lit(_FACTOR**j)

    def ends(i: Column) -> Column:
        rolled = at(i, 0)
        for j in range(1, window):
            rolled = rolled + at(i, j)
        return rolled % divisor == 0

    def seam(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), (b - a + 1).alias("n"), body_hash(_body(a, b - a + 1)).alias("h"))

    def between(full: Column) -> Column:
        inner = F.transform(F.slice(full, 1, F.size(full) - 1), lambda a, t: seam(a, F.get(full, t + 1)))
        return F.when(F.size(full) > 1, inner).otherwise(F.array().cast(_WINDOWS))

    rows = _lines(rows).withColumn("hashes", F.transform("lines", line_hash))
    rows = rows.withColumn("cuts", F.filter(_up_to(F.size("lines"), window - 1), ends))
    rows = rows.withColumn("starts", F.filter(F.concat(F.array(F.lit(0)), F.transform("cuts", lambda i: i + 1)), lambda s: s < F.size("lines")))
    rows = rows.withColumn("stops", F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.when(F.size("starts") > 0, F.array(F.size("lines"))).otherwise(_no_places())))
    rows = rows.withColumn("full", F.transform(F.arrays_zip("starts", "stops"), lambda c: F.filter(_up_to(c["stops"], c["starts"]), lambda i: F.get("lines", i).rlike(CONTENT))))
    rows = rows.withColumn("hs", F.transform(F.arrays_zip("starts", "stops", "full"), lambda c: F.when(F.size(c["full"]) >= least, F.unhex(F.md5(_body(c["starts"], c["stops"] - c["starts"]))))))
    rows = rows.withColumn("inner", F.transform("full", between))
    sides = F.filter("full", lambda p: F.size(p) > 0)
    sides = F.arrays_zip(F.transform(sides, lambda p: F.element_at(p, -1)).alias("a"), F.concat(F.slice(F.transform(sides, lambda p: F.get(p, F.lit(0))), 2, F.greatest(F.size(sides), F.lit(1))), _no_places()).alias("b"))
    rows = rows.withColumn("sides", F.filter(sides, lambda s: s["b"].isNotNull()))
    return rows.select(
        "_id", "_hash", "copies", F.size("lines").alias("n_lines"),
        F.transform(F.arrays_zip("starts", "stops", "hs", "inner"), lambda c: F.struct(c["starts"].alias("start"), (c["stops"] - c["starts"]).alias("n"), c["hs"].alias("h"), c["inner"].alias("windows"))).alias("chunks"),
        F.transform("sides", lambda s: seam(s["a"], s["b"])).alias("seams"),
    )


def repeated_chunks(units: DataFrame) -> DataFrame:
    """_id, _hash, places: (is_chunk, start, n) of multi-line chunks seen twice; later: which of the row's chunks are not the first."""
    chunks = units.select("_id", "_hash", F.posexplode("chunks").alias("k", "c")).select("_id", "_hash", "k", "c.start", "c.n", "c.h").filter("h IS NOT NULL")
    twice = chunks.groupBy("h").agg(F.min(F.struct("_id", "_hash", "k")).alias("first"), F.count("*").alias("seen")).filter("seen > 1")
    found = look_up(chunks, twice, ["h"], "seen", chunks.count(), "inner")
    later = F.when(~F.struct("_id", "_hash", "k").eqNullSafe(F.col("first")), F.col("k"))
    return found.groupBy("_id", "_hash").agg(F.collect_list(F.struct(F.lit(True).alias("is_chunk"), "start", "n")).alias("places"), F.collect_list(later).alias("later"))


def repeated_windows(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """_id, _hash, places: (is_chunk, start, n) of the windows seen twice, those inside later chunks aside."""
    rows = _of_rows(units.select("_id", "_hash", "chunks", "seams"), chunks.select("_id", "_hash", "later"), "left")
    rows = rows.withColumn("open", F.array_except(_up_to(F.size("chunks")), F.coalesce("later", _no_places())))
    windows = F.concat("seams", F.flatten(F.transform("open", lambda k: F.get("chunks", k)["windows"])))
    rows = tables.written(rows.select("_id", "_hash", F.explode(windows).alias("w")).select("_id", "_hash", "w.*"))
    twice = rows.groupBy("h").agg(F.count("*").alias("seen")).filter("seen > 1")
    found = look_up(rows, twice, ["h"], "seen", rows.count(), "inner")
    return found.groupBy("_id", "_hash").agg(F.collect_list(F.struct(F.lit(False).alias("is_chunk"), "start", "n")).alias("places"))


def repeats(rows: DataFrame, units: DataFrame) -> DataFrame:
    """_id, _hash, spans: (start, n) of what stands earlier somewhere, byte for byte, and gone_chunks, per row that has any."""
    chunks = tables.written(repeated_chunks(units))
    places = chunks.select("_id", "_hash", "places").union(repeated_windows(units, chunks))
    places = tables.written(places.groupBy("_id", "_hash").agg(F.flatten(F.collect_list("places")).alias("places")))
    total = places.agg(F.sum(F.size("places"))).first()[0] or 0
    found = _lines(_of_rows(rows.select("_id", "_hash", "_text"), places, "inner"))
    found = found.select("_id", "_hash", F.explode(F.transform("places", lambda p: p.withField("body", _body(p["start"], p["n"])))).alias("p"))
    found = found.select("_id", "_hash", "p.*", F.unhex(F.sha2("p.body", 256)).alias("digest"))
    keys = ["is_chunk", "digest"]
    bodies = found.groupBy(*keys, "body").agg(F.min(F.struct("_id", "_hash", "start")).alias("first"), F.count("*").alias("seen"))
    classes = bodies.groupBy(*keys).agg(F.count("*").alias("bodies"), F.min("first").alias("first"), F.sum("seen").alias("seen"))
    again = look_up(found.drop("body"), classes.filter("bodies = 1 AND seen > 1").drop("bodies"), keys, "seen", total, "inner")
    again = again.filter(~F.struct("_id", "_hash", "start").eqNullSafe(F.col("first")))
    return again.groupBy("_id", "_hash").agg(F.collect_list(F.struct("start", "n")).alias("spans"), F.count_if("is_chunk").alias("gone_chunks"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST_LINES) -> DataFrame:
    """id, n_lines, n_chunks, n_removed_chunks, n_removed_lines and the kept text of every document."""
    rows = different_rows(docs, id_col, text)
    units = tables.written(with_units(rows, window, divisor, least))
    multi = F.filter("chunks", lambda c: c["h"].isNotNull())
    span = lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"))
    every = F.concat(F.transform(multi, span), F.transform("seams", span), F.flatten(F.transform("chunks", lambda c: F.transform(c["windows"], span))))
    known = units.select("_id", "_hash", "copies", F.size("chunks").cast("long").alias("n_chunks"), F.when(F.col("copies") > 1, every).alias("every"), F.size(multi).cast("long").alias("multi"))
    known = _of_rows(known, repeats(rows, units), "left")
    rows = _lines(_of_rows(rows.select("_id", "_hash", "_text"), known, "left"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    spans = F.when(F.col("copy") > 1, F.col("every")).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")))
    rows = rows.withColumn("gone", F.array_distinct(F.flatten(F.transform(spans, lambda s: _up_to(s["start"] + s["n"], s["start"])))))
    rows = rows.withColumn("kept", F.array_except(_up_to(F.size("lines")), F.col("gone")))
    return rows.select(
        F.col("_id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), "n_chunks",
        F.when(F.col("copy") > 1, F.col("multi")).otherwise(F.coalesce("gone_chunks", F.lit(0).cast("long"))).alias("n_removed_chunks"),
        F.size("gone").cast("long").alias("n_removed_lines"),
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n").alias("kept_text"),
    )
