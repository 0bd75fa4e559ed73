import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import conversation_trie as trie
from shelfcast.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences_of(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(ids) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(ids), len(p), min(members[p[:-1]]) if p else -1, len(ids), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in ids if len(seqs[c]) == len(p)).encode()).hexdigest())
        for p, ids in members.items()
    )


def nodes(df):
    return sorted(
        (r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
        for r in df.collect()
    )


def random_conversations(n, seed):
    """Many equal conversations, conversations that are the start of others, and a very long one."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        turns = rnd.choice([0, 1, 2, 3, 4, 6]) + 1 if c != 17 else 300
        kind = rnd.random()
        for t in range(turns):
            text = "same" if kind < 0.4 else rnd.choice(["a", "bb", "ccc", "été 🙂", None, ""])
            rows.append((c * 7 % 1000, t if t else None, rnd.choice(["user", None]) if kind > 0.7 else "user", text))
    return rows


@pytest.mark.parametrize("few", [False, True])
def test_trie_over_ranges(spark, monkeypatch, few):
    """Small ranges cut through groups of equal conversations and through every shared start."""
    if few:
        monkeypatch.setattr(trie, "RANGE_ROWS", 4)
    rows = random_conversations(300, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    own = trie.turn_sequences(df)
    assert nodes(trie.prefix_trie(own)) == brute(sequences_of(rows))
    assert nodes(trie.prefix_trie(trie.shared_starts(own))) == brute(rebuilt(sequences_of(rows)))


def test_forest_of_one_range_equals_forests_of_many():
    rnd = random.Random(2)
    seqs = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(5))) for _ in range(40))
    keys = [b"".join(bytes([x]) * trie.WIDTH for x in s) for s in seqs]
    import numpy as np

    grown = trie.Forest(0, keys, list(range(40)), [np.ones(len(s), int) for s in seqs], None, None).grow()
    assert not any(grown["is_open"])
    starts = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert sorted(grown["depth"]) == sorted(map(len, starts))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", "x" * 3_000_000), (100, 5, "", ""), (101, 5, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ("part", "key", "conv", "chars", "kind", "depth", "prefix", "turns", "base")})
    own = trie.turn_sequences(df)
    assert nodes(trie.prefix_trie(trie.shared_starts(own))) == brute(rebuilt(sequences_of(rows)))
    assert trie.prefix_trie(trie.turn_sequences(df.limit(0))).count() == 0


def test_all_conversations_equal(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE_ROWS", 10)
    rows = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(3)]
    got = nodes(trie.prefix_trie(trie.turn_sequences(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(sequences_of(rows)) and len(got) == 4


def test_query_matches_brute_force_and_sql(spark, data_dir):
    import duckdb
    import pyarrow.parquet as pq

    rows = [tuple(r.values()) for r in pq.read_table(f"{data_dir}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = nodes(QUERIES["op11_conversation_trie"](spark, data_dir))
    assert got == brute(rebuilt(sequences_of(rows)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data_dir}/conversations.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sql = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op11_conversation_trie']})").fetchall()
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in sql) == got
