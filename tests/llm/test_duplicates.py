import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm import line_chunks, signature_join, suffix_dedup
from shelfcast.llm.components import components
from shelfcast.llm.queries import QUERIES
from llm.llm_cases import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                common[j] += 1
            where[x].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[a] = b
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def classes(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in range(100, 140)} == {100}
    assert (got[200], got[300], got[301], len(got)) == (200, 300, 300, 41 + 40 + 1 + 2)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def near_copies(n, seed):
    """Chains and clusters of near copies, beside common passages and unlike texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(60)] for _ in range(4)]
    rows, chain = [], list(base[0])
    for i in range(n):
        kind = rnd.random()
        if kind < 0.4:
            t = list(base[1])
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(60)] = word()
        elif kind < 0.6:
            chain[rnd.randrange(60)] = word()
            t = list(chain)
        elif kind < 0.8:
            t = [word() for _ in range(40)] + passage
        else:
            t = list(base[rnd.randrange(2, 4)])[: rnd.randint(3, 60)]
        rows.append((1000 - i, " ".join(t)))
    return rows


@pytest.mark.parametrize("chunk", [1024, 8])
def test_classes_of_near_copies(spark, monkeypatch, chunk):
    """The small chunk sends every group through all rounds."""
    monkeypatch.setattr(signature_join, "CHUNK", chunk)
    monkeypatch.setattr(signature_join, "LEAF", 4)
    rows = near_copies(160, 5)
    assert classes(signature_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_classes(rows)


def test_classes_of_odd_texts(spark, odd):
    assert classes(signature_join.similar_classes(odd)) == brute_classes(ODD)
    assert signature_join.similar_classes(odd.limit(0)).count() == 0


def test_traversal_finds_what_all_pairs_find():
    rnd = np.random.default_rng(1)
    base = [rnd.integers(0, 2**63, 80, dtype=np.uint64) for _ in range(6)]
    values = []
    for i in range(90):
        v = base[i % 6].copy()
        v[rnd.integers(0, 80, i % 25)] = rnd.integers(0, 2**63, i % 25, dtype=np.uint64)
        values.append(np.unique(v))
    label = np.arange(90)
    tree = signature_join.Tree(label, np.array([len(v) for v in values]), values, label)
    found = signature_join.Classes(label)
    signature_join.dual_traversal(tree, tree, found)
    plain = signature_join.Classes(label)
    for i in range(90):
        for j in range(i):
            n = len(np.intersect1d(values[i], values[j]))
            if 4 * n >= 3 * (len(values[i]) + len(values[j]) - n):
                plain.join(i, j)
    assert [found.find(i) for i in range(90)] == [plain.find(i) for i in range(90)]


def test_join_query(spark, data_dir, texts):
    assert classes(QUERIES["op2_ngram_jaccard_join"](spark, data_dir)) == brute_classes(texts)


def brute_bytes(rows, length=100):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def digests(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeated_bytes_of_made_texts(spark):
    rnd = random.Random(2)
    word = lambda n=4: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, other = word(180), word(400)
    rows = [(i, word(rnd.randint(0, 150)) + rnd.choice([passage, other, passage[40:] + other[:90], ""]) + word(rnd.randint(0, 150))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "ab" * 100), (102, "z" * 700), (103, other + other), (104, "é" * 120)]
    rnd.shuffle(rows)
    found = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert digests(suffix_dedup.digest(found)) == brute_bytes(rows)


def test_repeated_bytes_of_odd_texts(spark, odd):
    assert digests(suffix_dedup.digest(suffix_dedup.dedup_bytes(odd))) == brute_bytes(ODD)
    assert suffix_dedup.dedup_bytes(odd.limit(0)).count() == 0
    twice = odd.filter("doc_id = 6").union(odd.filter("doc_id = 6"))
    assert [r["n_bytes"] for r in suffix_dedup.dedup_bytes(twice).collect()] == [3000, 3000]
    with pytest.raises(ValueError, match="does not fit"):
        suffix_dedup.dedup_bytes(odd, length=20)


def test_repeated_bytes_of_rows_without_an_id_of_their_own(spark):
    """Every row is a document; rows that share an id, or have none, are in the order of their texts' hashes."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, twin = word(230), word(500)
    rows = [(rnd.choice([None, 1, 2, 3, i]), word(rnd.randint(0, 150)) + rnd.choice([passage, passage[60:], ""]) + word(rnd.randint(0, 150))) for i in range(40)]
    rows += [(None, twin), (None, twin), (5, twin), (6, word(300)), (7, None), (None, None)] + [(6, word(300) + passage)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = docs.orderBy("doc_id", F.xxhash64("text")).collect()
    want = brute_bytes([(i, r["text"]) for i, r in enumerate(order)])
    got = suffix_dedup.digest(suffix_dedup.dedup_bytes(docs)).collect()
    row = lambda i, *x: (i is not None, i or 0, *x)
    assert sorted(row(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(row(r["doc_id"], *want[i]) for i, r in enumerate(order))


def test_hot_anchors_are_split_by_windows(spark, monkeypatch):
    """Many documents with one passage: at its edges each gives another segment, which must not meet in one bucket."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(220)
    rows = [(i, word(rnd.randint(100, 160)) + passage + word(rnd.randint(100, 160))) for i in range(150)] + [(200, "z" * 400), (201, "z" * 300 + "y" * 90)]
    monkeypatch.setattr(suffix_dedup, "HOT_BODIES", 40)
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = suffix_dedup.hot_anchors(docs.select(F.col("text").alias("_text")))
    part = next(A.text_slices(pa.array([t for _, t in rows])))
    plain, split = (suffix_dedup.segments(part.data, part.bounds, hot=h) for h in (hot[:0], hot))
    most = lambda s: max(len(set(s["body"][s["hash"] == h].tolist())) for h in np.unique(s["hash"]))
    assert most(plain) >= 140 and most(split) < 80
    assert plain["count"].sum() == split["count"].sum()
    assert digests(suffix_dedup.digest(suffix_dedup.dedup_bytes(docs))) == brute_bytes(rows)


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_sorting(n):
    rnd = random.Random(n)
    words = sorted({bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(n)})
    mixed = list(words)
    rnd.shuffle(mixed)
    assert [mixed[i] for i in suffix_dedup.blind_trie_order(mixed)] == words
    heads = [b"a" * 40, b"a" * 39 + b"b", b"xy" * 20]
    rows = np.frombuffer(b"".join(rnd.choice(heads) + bytes(rnd.choice(b"ab") for _ in range(8)) for _ in range(n)), np.uint8).reshape(n, 48)
    group = np.array([rnd.randrange(3) for _ in range(n)])
    keys = [(group[i], rows[i].tobytes()) for i in suffix_dedup.deep_shallow_order(group, rows, 32)]
    assert keys == sorted(keys)


def test_bytes_query(spark, data_dir, texts):
    assert digests(QUERIES["op4_suffix_dedup"](spark, data_dir)) == brute_bytes(texts)


def test_line_chunks(spark, odd):
    block = [f"line {i} of the block" for i in range(12)]
    rows = [(3, "\n".join(["one", *block, "two"])), (1, "\n".join([*block])), (2, "\n".join(["zero", "half", "one", *block])), (4, "alone\nagain")]
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_removed_lines"], got[1]["kept_text"]) == (0, rows[1][1])
    assert got[4]["kept_text"] == "alone\nagain"
    assert (got[2]["kept_text"], got[3]["kept_text"]) == ("zero\nhalf\none", "two")  # "one" stands before the block there too
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(odd).collect()}
    assert (got[1]["n_lines"], got[1]["kept_text"], got[2]["n_lines"], got[2]["kept_text"]) == (0, "", 1, "")
    assert got[8]["kept_text"] == ODD[7][1]
    assert got[9]["n_removed_lines"] in (0, 2, 3, 4)
    assert line_chunks.dedup_lines(odd.limit(0)).count() == 0


def brute_chunks(texts):
    """(removed lines, kept text) of every text, in their order: repeated chunks and windows between lines with content."""
    seen, out = {"chunk": set(), "window": set()}, []
    for text in texts:
        lines = text.split("\n") if text is not None else []
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:10], 16) for x in lines]
        starts = [0] + [i + 1 for i in range(1, len(lines)) if (hashes[i] + 31 * hashes[i - 1]) % 3 == 0 and i + 1 < len(lines)]
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        spans = [("window", a, b + 1) for a, b in zip(full, full[1:], strict=False)]
        spans += [("chunk", a, b) for a, b in zip(starts, starts[1:] + [len(lines)], strict=True) if sum(a <= i < b for i in full) > 1]
        gone = set()
        for kind, a, b in spans:
            body = tuple(lines[a:b])
            if body in seen[kind]:
                gone |= set(range(a, b))
            seen[kind].add(body)
        out.append((len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def check_lines(docs):
    """``docs`` against brute force; the number of removed lines."""
    order = docs.orderBy("doc_id", F.xxhash64("text")).collect()
    want = brute_chunks([r["text"] for r in order])
    row = lambda i, *x: (i is not None, i or 0, *x)
    got = line_chunks.dedup_lines(docs).collect()
    assert sorted(row(r["doc_id"], r["n_removed_lines"], r["kept_text"]) for r in got) == sorted(row(r["doc_id"], *w) for r, w in zip(order, want, strict=True))
    return sum(w[0] for w in want)


def test_short_passages_go_and_single_lines_stay(spark):
    rnd = random.Random(3)
    passages = [[f"line {i} of passage {p}" for i in range(2 + p % 5)] for p in range(60)]
    for p in passages[::4]:
        p.insert(1, "  ")  # a blank line is no line of a passage, and goes with it
    rows, planted = [], 0
    for i in range(300):
        p = passages[i % 60]
        planted += len(p) if i >= 60 else 0
        own = [f"own {i} {k}" for k in range(rnd.randrange(1, 9))]
        rows.append((i, "\n".join([*own, "a common heading", "", *p, "a common line", f"end {i}", "alone", f"last {i}"])))
    # each passage stands five times, between the same lines, which go with it
    out = line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed_lines"] for r in out) >= planted
    got = {r["doc_id"]: r["kept_text"] for r in out}
    kept = [x for t in got.values() for x in t.split("\n")]
    assert sum(x.startswith("line ") for x in kept) == sum(x.startswith("line ") for p in passages for x in p)
    assert all(f"own {i} 0" in t and t.endswith(f"end {i}\nalone\nlast {i}") for i, t in got.items())


def test_lines_of_windows_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(line_chunks, "body_hash", F.length)
    rows = [(i, "\n".join(f"line {(i * 7 + k * k) % 23:02}" for k in range(9))) for i in range(30)]
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string")) > 60


def test_lines_of_very_common_chunks_and_long_texts(spark, odd):
    """A third of the rows hold one passage, hot keys are looked up apart, and one text has 40,000 lines."""
    common = "\n".join(f"common {i}" for i in range(9))
    long = "\n".join(f"line {i} of {i % 7}" for i in range(40_000))
    rows = [(i, f"own {i}\n{common if i % 3 == 0 else f'more {i}'}\nlast {i}") for i in range(600)] + [(700, long), (701, f"x\n{long}"), (None, long), (None, None), (702, "")]
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string")) == 199 * 9 + 80_000
    x = "\n".join(["same"] * 5)  # windows that overlap themselves
    assert check_lines(spark.createDataFrame([(1, x), (2, "same\nsame")], "doc_id long, text string")) == 6
    assert check_lines(odd.select("doc_id", "text")) == 3


def test_line_chunks_of_rows_without_an_id_of_their_own(spark):
    rnd = random.Random(6)
    blocks = [[f"line {i} of block {b}" for i in range(8)] for b in range(5)]
    rows = [(rnd.choice([None, 1, 2, 3]), "\n".join([f"own {i}", *blocks[rnd.randrange(5)], f"own {i} too", f"end {i}"])) for i in range(40)]
    for docs in (rows, rows + rows[:3] * 2 + [(None, None), (None, None), (1, "")]):  # without and with equal rows
        docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert check_lines(docs) > 50
