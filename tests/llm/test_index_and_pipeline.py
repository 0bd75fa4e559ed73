import hashlib
import os
import re
import subprocess
import sys

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from llm.llm_cases import ODD
from shelfcast.llm import byte_cnn, phrase_index, signature_join, suffix_dedup, token_output
from shelfcast.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from shelfcast.llm.tables import fresh, read

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute_hits(rows, items, window=10):
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    lengths = {len(p) for p in phrases}
    out = {}
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[p]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def digests(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in phrase_index.hits(df).collect()}


@pytest.mark.parametrize("window", [3, 10])
def test_phrases_in_made_texts(spark, monkeypatch, window):
    rnd = np.random.default_rng(window)
    text = lambda n: " ".join(rnd.choice(["a", "b", "Ab", "c", "é-e", "dd"], n, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]))
    rows = [(i, text(int(rnd.integers(0, 60)))) for i in range(120)] + [(500 + i, t) for i, t in ODD]
    items = [(i, text(int(rnd.integers(0, 14)))) for i in range(12)] + [(50, None), (51, "..."), (3, "word"), (52, rows[3][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_hits(rows, items, window)
    monkeypatch.setattr(phrase_index, "SHARD_BYTES", 500)
    assert digests(phrase_index.matches(docs, bench, window)) == expected
    monkeypatch.setattr(phrase_index, "MAX_BENCHMARK_BYTES", 100)  # several rounds
    assert digests(phrase_index.matches(docs, bench, window)) == expected
    assert digests(phrase_index.matches(docs, bench.limit(0), window)) == brute_hits(rows, [], window)
    assert phrase_index.matches(docs.limit(0), bench).count() == 0


def test_rounds_do_not_change_results(spark, monkeypatch):
    """Rows that repeat an id, or have none, keep their own words, merged spans and distinct items in several rounds."""
    rnd = np.random.default_rng(4)
    text = lambda n: " ".join(rnd.choice(["a", "b", "c"], n))
    rows = [([None, 1, 2, i][i % 4], text(int(rnd.integers(0, 60)))) for i in range(60)] + [(None, None), (1, "a b c a b c")] * 2
    items = [(str(i % 9), text(int(rnd.integers(1, 9)))) for i in range(30)] + [(None, "a b c a")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(phrase_index, "SHARD_BYTES", 300)
    got = []
    for limit in (1 << 20, 40):
        monkeypatch.setattr(phrase_index, "MAX_BENCHMARK_BYTES", limit)
        got.append(sorted(repr(r) for r in phrase_index.matches(docs, bench, 4).collect()))
    assert len(got[0]) == len(rows) and got[0] == got[1]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x one two odd three four y"), (2, "one two three four"), (3, "four three two one"), (4, "one two"), (5, "one two . three")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "one two three four")], "item_id string, text string")
    exact = {r["doc_id"]: r["items"] for r in phrase_index.matches(docs, bench, 4).collect()}
    near = {r["doc_id"]: r["items"] for r in phrase_index.matches(docs, bench, 4, slack=1).collect()}
    assert exact == {1: [], 2: ["q"], 3: [], 4: [], 5: []}
    assert near == {1: ["q"], 2: ["q"], 3: [], 4: [], 5: []}


def test_odd_columns_do_not_matter(spark, odd):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "word")], "item_id long, text string")
    assert digests(phrase_index.matches(odd, bench)) == brute_hits(ODD, [(1, "a b c d e f"), (2, "word")])


def test_decontamination_query(spark, data_dir, texts):
    items = [(r["item_id"], r["text"]) for r in read(spark, data_dir, "benchmark").collect()]
    assert digests(phrase_index.matches(read(spark, data_dir, "documents"), read(spark, data_dir, "benchmark"))) == brute_hits(texts, items)


def test_queries_with_sql(spark, data_dir):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = con.execute(sql).df()
        got = QUERIES[name](spark, data_dir).toPandas()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        frames = [f[cols].convert_dtypes().sort_values(cols).reset_index(drop=True).astype(str) for f in (want, got)]
        assert frames[0].equals(frames[1]), name


def test_pipeline(spark, data_dir, texts):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mix", "token_files"]
    docs = read(spark, data_dir, "documents")
    kept, columns = [], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, data_dir)
        if k < 4:
            assert docs.columns == columns
            docs = corpus_pipeline.written(docs)
            kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    assert set(kept[0]) > set(kept[1]) > set(kept[2]) >= set(kept[3])
    by_id = dict(texts)
    items = [(r["item_id"], r["text"]) for r in read(spark, data_dir, "benchmark").collect()]
    hit = brute_hits([(i, by_id[i]) for i in kept[1]], items)
    assert sorted(kept[2]) == sorted(i for i in kept[1] if not hit[i][4])
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(kept[3])


def test_pipeline_of_odd_and_no_documents(spark, odd, data_dir):
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, data_dir)
            assert k == 4 or out.columns == docs.columns
            out.collect()


def test_entry_stands_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in os.listdir(root):
        if name not in ("shelfcast", "corpus_pipeline.py", "tests", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "shelfcast")
    for name in os.listdir(f"{root}/shelfcast"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/shelfcast/{name}", tmp_path / "shelfcast" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)


def test_null_ids(spark, data_dir):
    """A NULL id is carried through, before all others; a large id keeps all its digits."""
    big, text = 2**62 + 1, "one two three four five six seven eight nine ten"
    rows = [(None, text), (big, text), (None, None), (7, " ".join(f"w{i % 90}x{i}" for i in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1).cast("long")})
    bench = spark.createDataFrame([("q", text)], "item_id string, text string")
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in phrase_index.hits(phrase_index.matches(docs, bench)).collect()) == [(0, False), (0, True), (7, False), (big, True)]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in signature_join.similar_classes(docs).collect())
    assert [(i, n, c) for i, n, c in got if i] == [(7, 76, 7), (big, 6, None)]
    path = fresh(spark)
    token_output.write_ids(docs, path, tokenizer_path("byte_bpe_50k.json"))
    assert [r["doc_id"] for r in token_output.read_ids(spark, path).orderBy("start").collect()] == [None, None, 7, big]
    assert {r["doc_id"] for r in suffix_dedup.dedup_bytes(docs).collect()} == {None, 7, big}
    assert {r["held_out"] for r in byte_cnn.score(docs, byte_cnn._start(1)).filter("doc_id IS NULL").collect()} == {False}
    for stage in (corpus_pipeline.ngram_jaccard_join, corpus_pipeline.benchmark_decontamination, corpus_pipeline.source_mix):
        docs = stage(spark, docs, data_dir)
    assert {r["doc_id"] for r in docs.collect()} <= {None, 7}
