"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts earlier, by deep-shallow sorting.

Only suffixes that can matter are sorted. Each window of ``LENGTH`` bytes has an anchor, the first of its ``GRAM``-byte
strings of least hash; equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a
segment, the unit of work.

1. Segments meet by the anchor's hash. Of equal segments (by hash of their bytes and the anchor's place) all but the first
   are repeated as a whole; equal segments of one task are merged before the shuffle, so a passage that a third of the
   documents share sends one segment a task.
2. Where an anchor has two or more different segments, the first of each is fetched. Their suffixes from the anchor on, and
   their prefixes read backwards, are put in order: multikey quicksort by words of eight bytes down to ``SHALLOW`` bytes,
   then blind tries for the groups that still agree. With the common prefix lengths of neighbours, windows at one distance
   from the anchor are equal if both parts agree far enough, and all but the first of a class are repeated.
3. The repeated windows of a document are merged into spans and cut out.

At the edges of a passage that many documents share, each of them gives another segment with the same anchor. Anchors with
about ``HOT_BODIES`` different segments or more are found in a sample first, and each window of their segments goes as a
segment of its own, dealt by its bytes instead of the anchor: equal windows still meet, and different ones are spread and
need no sorting. An anchor that the sample misses is sorted like the others, with the same result.

Order is by id, then place. NULL and empty texts have no bytes. Matches never cross documents. Every row is a document of
its own, also where rows share an id or have none: such rows are ordered by a hash of their texts. NULL ids stand before
all others. For that the rows are numbered in this order and written once to the shared folder. An empty table gives an
empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm.tables import buckets_for, text_bytes, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, GRAM, SHALLOW = 100, 32, 32
BUCKET_BYTES = 12 << 20
#: Window starts handled at once in a task, and bytes of text whose segments are merged before they are sent.
PIECE, SENT_BYTES = 1 << 18, 4 << 20
#: Different segments of an anchor from which on they go by windows; one of so many segments is in the sample that finds
#: these anchors. The list sent to the tasks has the most frequent ones, so it is bounded whatever the corpus.
HOT_BODIES, HOT_SAMPLE, HOT_LISTED = 2048, 32, 1 << 18
_PLACE = np.uint64((1 << 24) - 1)
_NONE = np.zeros(0, np.uint64)

#: Columns of a packed row: values of a bucket, each an array.
_SEGMENT = {"hash": np.uint64, "body": np.uint64, "doc": np.int64, "low": np.uint32, "off": np.uint8, "count": np.uint8}
_RANGE = {"doc": np.int64, "low": np.uint32, "high": np.uint32}
_FETCHED = {"hash": np.uint64, "doc": np.int64, "low": np.uint32, "off": np.uint8, "count": np.uint8, "data": np.uint8}
_NAMES = ("hash", "body", "doc", "low", "high", "off", "count", "data")
_PACKED = "kind int, bucket long, " + ", ".join(f"{n} binary" for n in _NAMES)
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), *((n, pa.binary()) for n in _NAMES)])
SEGMENTS, RANGES, OPEN = range(3)


def _row(kind: int, bucket: int, **columns: np.ndarray) -> tuple:
    return kind, bucket, *(A.pack(columns[n]) if n in columns else None for n in _NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _columns(table: pa.Table, kinds: dict) -> dict[str, np.ndarray]:
    return {n: np.concatenate([np.frombuffer(v.as_buffer(), k) for v in table.column(n)] or [np.zeros(0, k)]) for n, k in kinds.items()}


def _dealt(kind: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple]:
    """A packed row for each bucket."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    edges = A.runs(bucket[order])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            at = order[a:b]
            yield _row(kind, int(bucket[at[0]]), **{n: v[at] for n, v in columns.items()})


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (A.mix(doc.view(A.U64)) % A.U64(buckets)).astype(np.int64)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of an anchor's hash. Anchors are least hashes, so they are spread anew before they are dealt."""
    return ((A.mix(anchor) >> A.U64(32)) * A.U64(buckets) >> A.U64(32)).astype(np.int64)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values: suffix minima of a block meet prefix minima of the next."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, A.U64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    before = np.minimum.accumulate(square, axis=1).reshape(-1)
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray = _NONE) -> dict[str, np.ndarray]:
    """hash, body, text (number), low (place in the text), off (of the anchor from low), count (of windows) of the segments.

    Segments whose anchor's hash is ``hot`` are split into their windows.
    """
    out: list[dict[str, np.ndarray]] = []
    total = len(data) - length + 1
    for first in range(0, max(total, 0), PIECE):
        piece = data[first : first + PIECE + length - 1]
        prefix = A.prefix_hash(A._BYTE[piece])
        here = np.arange(len(piece) - gram + 1)
        key = A.span_hash(prefix, here, here + gram)
        marked = (key & ~_PLACE) | here.astype(A.U64)
        anchor = (least_in_windows(marked, length - gram + 1) & _PLACE).astype(np.int64)
        start = np.arange(len(anchor))
        text = A.owner(start + first, bounds)
        valid = start + first + length <= bounds[text + 1]
        start, anchor, text = start[valid], anchor[valid], text[valid]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        split = np.isin(key[anchor], hot) if len(hot) else np.zeros(len(start), bool)
        at = np.flatnonzero(new | split)
        count = np.diff(np.append(at, len(start)))
        low, anchor, text, split = start[at], anchor[at], text[at], split[at]
        body = A.span_hash(prefix, low, low + count + length - 1)
        body = A.mix(body + (anchor - low).astype(A.U64) * A.U64(0x9E3779B97F4A7C15))
        # Where a segment is a window, its hash is no other window's: hash and body together still tell the anchor's hash.
        meet = np.where(split, A.mix(key[anchor] ^ A.mix(body)), key[anchor])
        out.append({"hash": meet, "body": body, "text": text, "low": low + first - bounds[text], "off": anchor - low, "count": count})
    if not out:
        return {n: np.zeros(0, np.int64) for n in ("hash", "body", "text", "low", "off", "count")}
    return {n: np.concatenate([o[n] for o in out]) for n in out[0]}


def _repeats(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the segments by hash, body, document and place without doubles; whether each is the first of its body."""
    order = np.lexsort((s["low"], s["doc"], s["body"], s["hash"]))
    same = lambda n: s[n][order][1:] == s[n][order][:-1]
    body = same("hash") & same("body")
    double = np.concatenate([[False], body & same("doc") & same("low")])
    first = np.concatenate([[True], ~body])[: len(order)]
    return order[~double[: len(order)]], first[~double[: len(order)]]


def _ranges(s: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {"doc": s["doc"][at], "low": s["low"][at], "high": (s["low"][at].astype(np.int64) + s["count"][at] - 1).astype(np.uint32)}


def _sample(length: int):
    """The hash and body of one of ``HOT_SAMPLE`` segments, chosen by the body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.text_slices(batch.column("_text"), SENT_BYTES):
                s = segments(part.data, part.bounds, length)
                taken = A.mix(s["body"].astype(A.U64)) % A.U64(HOT_SAMPLE) == 0
                yield pa.RecordBatch.from_arrays([pa.array(s[n][taken].astype(A.U64).view(np.int64)) for n in ("hash", "body")], ["hash", "body"])

    return run


def hot_anchors(rows: DataFrame, length: int = LENGTH) -> np.ndarray:
    """The hashes of anchors with about ``HOT_BODIES`` different segments or more."""
    bodies = rows.select("_text").mapInArrow(_sample(length), "hash long, body long").distinct()
    counted = bodies.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_BODIES // HOT_SAMPLE)
    found = counted.orderBy(F.desc("n"), "hash").limit(HOT_LISTED).collect()
    return np.sort(np.array([r["hash"] for r in found], np.int64).view(A.U64))


def _emit(buckets: int, length: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for part in A.text_slices(batch.column("_text"), SENT_BYTES):
                s = segments(part.data, part.bounds, length, hot=hot)
                s["doc"] = ids[part.first : part.last][s.pop("text")]
                s = {n: s[n].astype(k) for n, k in _SEGMENT.items()}
                order, first = _repeats(s)
                found = _ranges(s, order[~first])
                own = {n: v[order[first]] for n, v in s.items()}
                rows = list(_dealt(RANGES, _home(found["doc"], buckets), found))
                rows += _dealt(SEGMENTS, _bucket(own["hash"], buckets), own)
                if rows:
                    yield from _table(rows).to_batches()

    return run


def _meet(buckets: int):
    """A bucket of segments to repeated ranges, and to the first segments of anchors that have several bodies."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == RANGES:
            return table
        s = _columns(table, _SEGMENT)
        order, first = _repeats(s)
        found = _ranges(s, order[~first])
        head = order[first]
        edges = A.runs(s["hash"][head])
        bodies = np.repeat(np.diff(edges), np.diff(edges)) if len(head) else np.zeros(0, np.int64)
        head = head[bodies > 1]
        rows = list(_dealt(RANGES, _home(found["doc"], buckets), found))
        wanted = {n: s[n][head] for n in ("hash", "doc", "low", "off", "count")}
        rows += _dealt(OPEN, _home(wanted["doc"], buckets), wanted)
        return _table(rows)

    return run


def _wanted(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The segments to fetch, one row per document."""
    s = _columns(table, {n: _FETCHED[n] for n in ("hash", "doc", "low", "off", "count")})
    order = np.argsort(s["doc"], kind="stable")
    edges = A.runs(s["doc"][order])
    rows = [order[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a]
    return pa.table(
        {"_key": pa.array([int(s["doc"][r[0]]) for r in rows], pa.int64()), **{n: pa.array([A.pack(s[n][r]) for r in rows], pa.binary()) for n in ("hash", "low", "off", "count")}}
    )


def _fetch(buckets: int, length: int):
    """Documents with their wanted segments to packed rows with the segments' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("hash").is_valid())
            data, bounds = A.byte_column(batch.column("_text"))
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            parts: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                h, low, off, count = (np.frombuffer(batch.column(n)[i].as_buffer(), _FETCHED[n]) for n in ("hash", "low", "off", "count"))
                parts.append((h, np.full(len(h), keys[i], np.int64), low, off, count, bounds[i] + low.astype(np.int64)))
            if not parts:
                continue
            h, doc, low, off, count, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = _bucket(h, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = A.runs(bucket[order])
            rows = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b > a:
                    at = order[a:b]
                    content = data[A.ranges(start[at], count[at].astype(np.int64) + length - 1)]
                    rows.append(_row(OPEN, int(bucket[at[0]]), hash=h[at], doc=doc[at], low=low[at], off=off[at], count=count[at], data=content))
            if rows:
                yield from _table(rows).to_batches()

    return run


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The order of distinct strings, none a prefix of another: a trie that keeps only the places where strings part.

    A string walks down by the bytes at those places alone, then is compared with one leaf; where they first differ is its
    place in the trie. Reading the trie from left to right gives the order.
    """
    root: list = [None, 0]  # leaf: [None, number]; inner node: [place, {byte: node}]
    for number in range(1, len(strings)):
        s, node = strings[number], root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1]]
        low, high = 0, len(s)
        while low < high:  # the first place where the two differ
            middle = (low + high) // 2
            if s[: middle + 1] == other[: middle + 1]:
                low = middle + 1
            else:
                high = middle
        node, leaf = root, [None, number]
        while node[0] is not None and node[0] < low:
            node = node[1][s[node[0]]]
        if node[0] == low:
            node[1][s[low]] = leaf
        else:
            node[0], node[1] = low, {other[low]: [node[0], node[1]], s[low]: leaf}
    out, stack = [], [root]
    while stack:
        place, below = stack.pop()
        if place is None:
            out.append(below)
        else:
            stack += [below[b] for b in sorted(below, reverse=True)]
    return out


def deep_shallow_order(group: np.ndarray, rows: np.ndarray, shallow: int = 2 * SHALLOW) -> np.ndarray:
    """The order of byte rows (n x width, a multiple of 8) by group, then bytes.

    Shallow: runs that still agree are partitioned by their next eight bytes, all at once, down to ``shallow`` bytes.
    Deep: the distinct rows of each remaining run go through a blind trie.
    """
    words = rows.view(">u8").astype(A.U64)
    order = np.argsort(group, kind="stable")
    run = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])) if len(order) else order
    for level in range(min(shallow // 8, words.shape[1])):
        size = np.bincount(run)
        open_ = np.flatnonzero(size[run] > 1)
        if not len(open_):
            return order
        at, in_run = order[open_], run[open_]
        word = words[at, level]
        by = np.lexsort((word, in_run))
        order[open_] = at[by]
        word, in_run = word[by], in_run[by]
        parts = np.zeros(len(order), np.int64)
        parts[open_[1:]] = (word[1:] != word[:-1]) & (in_run[1:] == in_run[:-1])
        starts = np.concatenate([[0], np.flatnonzero((run[1:] != run[:-1])) + 1])
        steps = parts.copy()
        steps[starts[1:]] = 1
        run = np.cumsum(steps)
    edges = A.runs(run)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            same: dict[bytes, list[int]] = {}
            for i in order[a:b].tolist():
                same.setdefault(rows[i].tobytes(), []).append(i)
            if len(same) > 1:
                distinct = list(same)
                order[a:b] = [i for k in blind_trie_order(distinct) for i in same[distinct[k]]]
    return order


def _depth_classes(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted order and the bytes each row has in common with the one before (-1: another group)."""
    order = deep_shallow_order(group, rows)
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def repeated_windows(s: dict[str, np.ndarray], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Ranges of window starts that are repeated, of segments with their bytes."""
    n = len(s["hash"])
    off, count = s["off"].astype(np.int64), s["count"].astype(np.int64)
    size = count + length - 1
    begin = np.cumsum(size) - size
    width = -(-length // 8) * 8 + 8
    # Byte codes from 1 on, so that what is behind the end of a part sorts first and equals nothing inside.
    right, left = np.zeros((n, width), np.uint16), np.zeros((n, width), np.uint16)
    spread = np.arange(width)
    source = np.minimum(begin[:, None] + off[:, None] + spread, max(len(s["data"]) - 1, 0))
    inside = spread < (size - off)[:, None]
    right[inside] = s["data"][source[inside]].astype(np.uint16) + 1
    source = np.maximum(begin[:, None] + off[:, None] - 1 - spread, 0)
    inside = spread < off[:, None]
    left[inside] = s["data"][source[inside]].astype(np.uint16) + 1
    # Two bytes a code, high byte first: the order of the bytes is the order of the codes.
    halves = [_depth_classes(s["hash"], m.astype(">u2").view(np.uint8).reshape(n, 2 * width)) for m in (right, left)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for distance in range(int(off.max()) + 1 if n else 0):
        live = np.flatnonzero((off >= distance) & (off - distance < count))
        if len(live) < 2:
            continue
        classes = []
        for (order, common), depth in zip(halves, (length - distance, distance), strict=True):
            of = np.empty(n, np.int64)
            of[order] = np.cumsum(common < 2 * depth) if depth else np.cumsum(common < 0)
            classes.append(of[live])
        by = np.lexsort((s["low"][live], s["doc"][live], classes[1], classes[0]))
        again = np.zeros(len(live), bool)
        again[1:] = (classes[0][by][1:] == classes[0][by][:-1]) & (classes[1][by][1:] == classes[1][by][:-1])
        hit = live[by[again]]
        found.append((s["doc"][hit], s["low"][hit].astype(np.int64) + off[hit] - distance))
    doc = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
    place = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return {"doc": doc[at], "low": place[at].astype(np.uint32), "high": place[last].astype(np.uint32)}


def _sorted_out(buckets: int, length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = _columns(table, _FETCHED)
        found = repeated_windows(s, length)
        return _table(list(_dealt(RANGES, _home(found["doc"], buckets), found)))

    return run


def _spans(length: int):
    """The ranges of a home bucket, merged: one row per document with the starts and ends of its spans."""

    def run(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = _columns(table, _RANGE)
        doc, low, end = s["doc"], s["low"].astype(np.int64), s["high"].astype(np.int64) + length
        order = np.lexsort((low, doc))
        doc, low, end = doc[order], low[order], end[order]
        edges = A.runs(doc)
        out: dict[str, list] = {"_key": [], "starts": [], "ends": []}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b == a:
                continue
            reach = np.maximum.accumulate(end[a:b])
            new = np.concatenate([[True], low[a + 1 : b] > reach[:-1]])
            at = np.flatnonzero(new)
            out["_key"].append(int(doc[a]))
            out["starts"].append(A.pack(low[a:b][at]))
            out["ends"].append(A.pack(reach[np.append(at[1:], b - a) - 1]))
        return pa.table({"_key": pa.array(out["_key"], pa.int64()), "starts": pa.array(out["starts"], pa.binary()), "ends": pa.array(out["ends"], pa.binary())})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = A.byte_column(batch.column("_text"))
        raw = memoryview(data)
        out: list[list] = [[], [], []]
        for i in range(batch.num_rows):
            size = int(bounds[i + 1] - bounds[i])
            starts, ends = (np.frombuffer(batch.column(n)[i].as_py() or b"", np.int64).tolist() for n in ("starts", "ends"))
            text = raw[bounds[i] : bounds[i + 1]]
            out[0].append(size)
            out[1].append([{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)])
            out[2].append(b"".join(bytes(text[a:b]) for a, b in zip([0, *ends], [*starts, size], strict=True)))
        yield pa.RecordBatch.from_arrays([
            batch.column("_id"), pa.array(out[0], pa.int64()),
            pa.array(out[1], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[2], pa.binary()),
        ], ["_id", "n_bytes", "spans", "kept"])


def numbered_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_key (the number of the row in the order of the documents), _id and _text, written.

    Sorted ranges number their rows in this order. Rows that have the same id and text are spread by where they come from,
    so that many of them do not meet in one range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_from": F.monotonically_increasing_id()})
    order = ("_id", "_hash", "_from")
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("_key"), "_id", "_text"))


def dedup_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, spans (byte ranges removed) and kept (the remaining bytes, binary) of every document.

    ``length`` up to 200 and above ``GRAM``.
    """
    if not GRAM < length <= 200:
        raise ValueError(f"a window of {length} bytes does not fit anchors of {GRAM} bytes")
    buckets = buckets_for(text_bytes(docs, text), BUCKET_BYTES)
    rows = numbered_rows(docs, id_col, text)
    sent = rows.select(F.col("_key").alias("_id"), "_text").mapInArrow(_emit(buckets, length, hot_anchors(rows, length)), _PACKED)
    met = written(sent.groupBy("kind", "bucket").applyInArrow(_meet(buckets), _PACKED))
    wanted = met.filter(F.col("kind") == OPEN).groupBy("bucket").applyInArrow(_wanted, "_key long, hash binary, low binary, off binary, count binary")
    # Both joins with the texts keep all documents, so that they share one shuffle of the texts.
    fetched = rows.join(wanted, "_key", "left").mapInArrow(_fetch(buckets, length), _PACKED)
    more = fetched.groupBy("bucket").applyInArrow(_sorted_out(buckets, length), _PACKED)
    ranges = met.filter(F.col("kind") == RANGES).union(more).select("bucket", "doc", "low", "high")
    spans = ranges.groupBy("bucket").applyInArrow(_spans(length), "_key long, starts binary, ends binary")
    out = rows.join(spans, "_key", "left").mapInArrow(_cut, "_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("_id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """n_removed, n_spans and kept_sha256 in place of the spans and the bytes."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("*", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")).drop("spans", "kept")
