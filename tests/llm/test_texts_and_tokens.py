import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfcast.llm import arrays as A
from shelfcast.llm import pretokens, token_counts, token_output
from shelfcast.llm.queries import QUERIES, tokenizer_path
from shelfcast.llm.tables import fresh
from llm.llm_cases import ODD

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_spans_stop_at_texts():
    for limit in (1, 5, 1 << 20):
        words = []
        for part in A.text_slices(pa.array(["ab", None, "", "cd ef", " g\x0bh "]), limit):
            start, end, of = A.word_spans(part.data, part.bounds, A.NOT_SPACE)
            words += [(int(i) + part.first, part.data[a:b].tobytes()) for a, b, i in zip(start, end, of, strict=True)]
        assert words == [(0, b"ab"), (3, b"cd"), (3, b"ef"), (4, b"g"), (4, b"h")]


def test_random_texts_count_as_in_the_library(library):
    rnd = random.Random(3)
    letters = [*"aAbs tdmrevl'' \n\t    é中1½²3!?.-_<|>́\x1c\x85", "<|endoftext|>", "'ll", "'s", " '", "'re", "aaaa"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 2000, " " * 70, "'s's're'llx", "<|endoftext|", "ab" * 500]
    with open(PATH, encoding="utf-8") as f:
        file = f.read()
    merges, specials = token_counts.Merges(file), pretokens.special_strings(file)
    known = pretokens.Distinct(lambda words: (merges.count_bytes(words, specials), np.ones(len(words), np.int64)))
    got = []
    for part in A.text_slices(pa.array(texts), 5000):
        begin, end, of = pretokens.pretokens(part, specials)
        number = known.look_up(part, begin, end)
        got += np.bincount(of, known.flat[number], minlength=part.last - part.first).astype(int).tolist()
    assert got == [len(i) for i in encoded(library, texts)]


def test_words_that_come_again_are_encoded_once(monkeypatch):
    """Past the limit rare words are forgotten, those of several slices stay; what is handed out is always the word's own row."""
    monkeypatch.setattr(pretokens, "REMEMBERED", 60)
    encoded_words = []

    def encode(words):
        encoded_words.extend(words)
        length = np.array([1 + len(w) % 3 for w in words])
        return np.repeat([zlib.crc32(w) % 1000 for w in words], length), length

    known = pretokens.Distinct(encode)
    common = [f" common{'x' * i}" for i in range(20)]
    for k in range(30):
        words = common + [f" rare{k}w{'y' * i}" for i in range(15)] + common[:3]
        part = next(A.text_slices(pa.array(["".join(words)])))
        ends = np.cumsum([len(w) for w in words])
        number = known.look_up(part, ends - [len(w) for w in words], ends)
        for w, i in zip(words, number.tolist(), strict=True):
            assert known.flat[known.bounds[i] : known.bounds[i + 1]].tolist() == [zlib.crc32(w.encode()) % 1000] * (1 + len(w) % 3)
        assert len(known.bounds) <= 60 + 36
    assert len(encoded_words) == 20 + 30 * 15


def test_all_words_of_many_slices_leave_room_for_others(monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 60)
    known = pretokens.Distinct(lambda words: (np.array([int(w) for w in words]), np.ones(len(words), np.int64)))
    for k in range(20):
        words = [f"{i % 900 + 100}" for i in range(25 * (k // 3), 25 * (k // 3) + 50)]
        part = next(A.text_slices(pa.array(["".join(words)])))
        number = known.look_up(part, np.arange(50) * 3, np.arange(50) * 3 + 3)
        assert known.flat[known.bounds[number]].tolist() == [int(w) for w in words]
        assert len(known.bounds) <= 60 + 51


def test_word_ids_are_those_of_the_library(library):
    """Mixtures of words that are encoded in one text and others, letters unknown to either side's tables included."""
    rnd = random.Random(5)
    letters = [*"abzéß中ñ\u00aa\u1c89\ua7cb\u0345ΐ", "\U00010d4a", "\U0001e030", "한"]
    words = [" " + "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(3000)] + [" ", " 7", "'s", " x7", "abc", "<|endoftext|>"]
    rnd.shuffle(words)
    with open(PATH, encoding="utf-8") as f:
        encode = token_output._encoder(f.read(), [])
    for some in (words, words[:1], [" 7"], [" abc"]):
        ids, length = encode([w.encode() for w in some])
        want = [library.encode(w, add_special_tokens=False).ids for w in some]
        assert length.tolist() == [len(x) for x in want] and ids.tolist() == [x for w in want for x in w]


def test_token_counts(spark, odd, library):
    got = {r["doc_id"]: r for r in token_counts.token_counts(odd, PATH, limit=5).collect()}
    for (i, text), ids in zip(ODD, encoded(library, [t for _, t in ODD]), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 5)
    assert token_counts.token_counts(odd.limit(0), PATH).count() == 0


@pytest.mark.parametrize(("n", "most"), [(1, 20), (2, 20), (5, 3), (300, 9), (5000, 13), (5000, 20)])
def test_codes_round_trip(n, most):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, (1e6 / np.arange(1, n + 1) ** 1.3)).astype(np.int64)
    rng.shuffle(counts)
    bits = token_output.code_lengths(counts, most)
    assert bits.max() <= most
    assert n == 1 or np.isclose((0.5**bits).sum(), 1)
    tokens = np.arange(n) * 3
    token, length, code = token_output.canonical(tokens, bits)
    code_of, bits_of = np.zeros(3 * n, np.int64), np.zeros(3 * n, np.uint8)
    code_of[token], bits_of[token] = code, length
    decoder = token_output.Decoder(tokens, bits)
    for m in (1, 255, 256, 257, 3000):
        ids = (rng.choice(n, m, p=counts / counts.sum()) * 3).astype(np.uint32)
        payload, marks = token_output.pack_bits(ids, code_of, bits_of)
        assert len(payload) == (int(bits_of[ids].sum()) + 7) // 8
        assert (decoder.decode(payload, marks, m) == ids).all()


def test_unlimited_code_lengths_are_those_of_huffman():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 200)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((token_output.code_lengths(counts, 24) * counts).sum()) == cost
    with pytest.raises(ValueError, match="no code"):
        token_output.code_lengths(counts, 7)


def test_files_give_the_ids_back(spark, odd, library):
    path = fresh(spark)
    token_output.write_ids(odd.union(odd.filter("doc_id = 8")), path, PATH)
    rows = sorted(ODD + [ODD[7]], key=lambda r: r[0])
    got = token_output.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    start = 0
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for r, ids in zip(got, encoded(library, [t for _, t in rows]), strict=True):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (start, len(ids) + 1, raw, zlib.crc32(raw))
        start += len(ids) + 1
    path = fresh(spark)
    token_output.write_ids(odd.limit(0), path, PATH)
    assert token_output.read_ids(spark, path).count() == 0


def test_end_ids_beyond_16_bits(spark, library):
    """Raw ids take 32 bits where one does not fit into 16."""
    rows = [(1, "some words"), (2, None), (3, "more")]
    with open(PATH, encoding="utf-8") as f:
        file = f.read()
    for end_id, kind in ((0, np.uint16), (65_535, np.uint16), (65_536, np.uint32)):
        assert token_output.raw_kind(file, end_id) is kind
        path = fresh(spark)
        token_output.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, end_id=end_id)
        got = token_output.read_ids(spark, path, with_ids=True).orderBy("start").collect()
        want = [[*ids, end_id] for ids in encoded(library, [t for _, t in rows])]
        assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
        assert [r["start"] for r in got] == [0, *np.cumsum([len(w) for w in want])[:-1].tolist()]


def test_queries_against_the_library(spark, data_dir, texts, library):
    rows = sorted(texts)
    ids = encoded(library, [t for _, t in rows])
    got = {r["doc_id"]: r for r in QUERIES["op1_token_output"](spark, data_dir).collect()}
    counted = {r["doc_id"]: r for r in QUERIES["op5_token_counts"](spark, data_dir).collect()}
    start = 0
    for (i, _), x in zip(rows, ids, strict=True):
        raw = np.array([*x, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(raw), zlib.crc32(raw.tobytes()))
        assert (counted[i]["n_tokens"], counted[i]["over_limit"]) == (len(x), len(x) > 1024)
        start += len(raw)
