import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcast.llm import simhash
from shelfcast.llm.queries import QUERIES
from llm.llm_cases import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = WORDS.findall((text or "").translate(LOWER))
    shingles = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else ([w] if w else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    by = {}
    for (d, _), p in zip(rows, prints, strict=True):
        by.setdefault(p, []).append(d)
    distinct = list(by)
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 2:
                parent[find(p)] = find(q)
    least = {}
    for p, ids in by.items():
        least[find(p)] = min(least.get(find(p), ids[0]), *ids)
    return {d: (f"{p:016x}", least[find(p)]) for (d, _), p in zip(rows, prints, strict=True)}


def got(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def test_query_matches_brute_force(spark, data_dir, texts):
    assert got(QUERIES["op13_simhash_near_dedup"](spark, data_dir)) == brute(texts)


def test_odd_texts_and_a_long_one(spark, odd):
    assert got(simhash.near_duplicates(odd)) == brute(ODD)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    rnd = random.Random(3)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 3_000_000), (4, "x " * 100_000)]
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_rows_without_or_with_the_same_id(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, ""), (7, "a b c d"), (7, "q r s t u"), (8, "q r s t u"), (9, None)], "doc_id long, text string")
    out = simhash.near_duplicates(rows).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == sorted([("None", "None"), ("None", "None"), ("7", "None"), ("7", "7"), ("8", "7"), ("9", "None")])


@pytest.mark.parametrize("group", [512, 16])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, group, distance):
    """Crowded blocks: a cloud of fingerprints around few centres; small groups go through all levels."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rnd = random.Random(11)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    values = set(centres)
    while len(values) < 400:
        v = rnd.choice(centres)
        for _ in range(rnd.randint(0, 5)):
            v ^= 1 << rnd.randrange(64)
        values.add(v)
    values = sorted(values)
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long").withColumn("n", F.lit(1))
    found = simhash.links(fps, distance).collect()

    def classes(pairs):
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return {v: find(v) for v in values}

    plain = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= distance]
    assert classes([(r["src"] & simhash.ALL_BITS, r["dst"] & simhash.ALL_BITS) for r in found]) == classes(plain)


def test_blocks_cover_all_bits():
    for parts in (2, 3, 4):
        masks = blocks = simhash.blocks(0, parts)
        assert sum(m.bit_count() for m in blocks) == 64
        for _ in range(3):
            masks = [b for m in masks for b in simhash.blocks(m, parts)]
            assert all(m.bit_count() > 20 for m in masks)
