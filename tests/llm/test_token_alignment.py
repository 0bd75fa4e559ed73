import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm import token_alignment
from shelfcast.llm.queries import QUERIES, tokenizer_path
from shelfcast.llm.token_counts import byte_letters
from llm.llm_cases import ODD

FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"
MIXED = [
    "Grüße 🙂🙂 naïve 中文字 مرحبا", "tab\tand\r\nreturn\n\n\nlines  two  blanks ", " 　 wide　  space \n x", "\n\n", " ", "a▁b c", "x" * 500, "🙂" * 60 + "é",
    "<s> </s> <unk> <0x0A> <|endoftext|> end", "1234567890 3.14", "é ‍👩‍👩‍👧 ok", "\x00\x01 nul", "ﬁ ① ℌ", "\u0085  \n  y", "word" * 40 + "\n" * 9 + " tail\n ",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(FILES[0]))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(FILES[1]))


def brute(rows, libraries):
    a, b = libraries
    letters = {c: i for i, c in enumerate(byte_letters())}
    per, held = [], Counter()
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            per.append(None)
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            total, here = 0, []
            for p in parts:
                total += len(p)
                here.append(total)
            ends.append(here)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            i2, j2 = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups.append((ids_a[i:i2], ids_b[j:j2]))
            i, j = i2, j2
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        per.append((len(ids_a), len(ids_b), groups, links))
        held.update(links.keys())
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (d, _), got in zip(rows, per, strict=True):
        if got is None:
            out.append((str(d), 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = got
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(n for k, n in links.items() if held[k] == most[k[0]])
        out.append((str(d), n_a, n_b, len(groups), sum(links.values()), best, sum(n * held[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in df.collect())


def aligned(df):
    return token_alignment.align(df, *map(tokenizer_path, FILES))


def test_query_matches_brute_force(spark, data_dir, texts, libraries):
    assert rows_of(QUERIES["op12_token_alignment"](spark, data_dir)) == brute(texts, libraries)


def test_odd_texts(spark, odd, libraries):
    assert rows_of(aligned(odd)) == brute(ODD, libraries)
    assert aligned(odd.limit(0)).count() == 0
    rows = list(enumerate(MIXED)) + [(None, "same text"), (None, "same text"), (3, "same text"), (3, None)]
    assert rows_of(aligned(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, libraries)


def test_random_mixtures_in_small_shards(spark, monkeypatch, libraries):
    monkeypatch.setattr(token_alignment, "SHARD_BYTES", 300)
    rnd = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "\r\n", "　", " ", " ", "é", "🙂", "中", "a", "The", "ing", "'s", "don't", "12", "...", "\x1c", "\x0b", "\u0085", " ", "ß ", "ا", "e.g.", ").", "x;", "9:", "\"q\"", "%", "://", "a.b"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))) for i in range(250)]
    assert rows_of(aligned(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, libraries)


def test_long_texts(spark, libraries):
    rnd = random.Random(9)
    rows = [(1, "".join(rnd.choice(["word ", "Größe ", "🙂", "\n", "longer, "]) for _ in range(400_000))), (2, "ab" * 100_000)]
    assert rows_of(aligned(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, libraries)


def test_token_map(spark, libraries):
    rows = [(1, "one two"), (2, "one two two"), (3, "one")]
    found = {(r["id_a"], r["id_b"]): (r["n_docs"], r["is_best"]) for r in token_alignment.token_map(spark.createDataFrame(rows, "doc_id long, text string"), *map(tokenizer_path, FILES)).collect()}
    assert sorted(found.values()) == [(2, True), (3, True)]


def test_decoded_bytes_cut_inside_characters():
    # Two characters of two bytes; both sides end after the first byte of the second one.
    cuts = token_alignment.common_cuts(np.array([4, 4]), np.array([3, 4]), np.array([0, 2, 2, 4]), np.array([1, 2, 3, 4]))
    assert cuts.tolist() == [3, 4]


def test_chunks_join_to_the_text():
    column = pa.array([" " + t for t in MIXED] + [""])
    data, bounds = A.byte_column(column)
    begin, end, text = token_alignment.chunk_spans(data, bounds, np.zeros((256, 256), bool))
    assert (end[:-1] == begin[1:]).all() and begin[0] == 0 and end[-1] == len(data)
    assert set(bounds[:-1][bounds[:-1] < bounds[1:]]) <= set(begin)
