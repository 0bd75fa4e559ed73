"""Pre-tokens of the byte-level vocabulary, found with array operations, and each distinct one handed out once.

A pre-token is a contraction, or a run of letters, of numbers or of other marks with one blank before it, or white
space; the file's special strings stand alone. Distinct pre-tokens are few against their occurrences, so encoders work on
the distinct ones of a slice and keep what they found for the next slices.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from shelfcast.llm import arrays as A

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Distinct pre-tokens that an encoder remembers; then it keeps those that came again, half as many at most.
REMEMBERED = 600_000
#: Code points of white space (fixed values).
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
        table[list(WHITE)] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def special_strings(file: str) -> list[str]:
    """The special strings of a tokenizer file's content."""
    return [t["content"] for t in json.loads(file)["added_tokens"]]


def pretokens(part: A.Slice, specials: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of a slice, and the text of each. Nothing is left out between them."""
    none = np.zeros(0, np.int64)
    if not len(part.data):
        return none, none, none
    raw = part.data.tobytes()
    lead = np.flatnonzero((part.data & 0xC0) != 0x80)
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    kind = classes()[code]
    first = np.zeros(n + 1, dtype=bool)  # a piece starts here: a text, or what a special string cuts off
    first[n] = True
    first[np.searchsorted(lead, part.bounds[:-1])] = True
    fixed = []
    for text in specials:
        mark = text.encode()
        at = raw.find(mark)
        while at >= 0:
            k = int(A.owner(np.array([at]), part.bounds)[0])
            if at + len(mark) <= part.bounds[k + 1]:
                a, b = np.searchsorted(lead, [at, at + len(mark)])
                first[a] = first[b] = True
                fixed.append((int(a), int(b)))
                at = raw.find(mark, at + len(mark))
            else:
                at = raw.find(mark, at + 1)
    begins, ends = first[:n], first[1:]
    space = kind == SPACE
    before_space = np.concatenate([[False], space[:-1]])
    after_space = np.concatenate([space[1:], [True]])
    changed = np.concatenate([[True], kind[1:] != kind[:-1]])
    blank_before = np.concatenate([[False], code[:-1] == 32])
    # White space: the run's start, and its last one if a word follows. Words: where the class changes, unless a blank is taken along.
    start = np.where(space, ~before_space | (~after_space & ~ends), changed & ~blank_before) | begins
    _contractions(code, start, first)
    for a, b in fixed:
        start[a + 1 : b] = False
    at = np.flatnonzero(start)
    byte = np.concatenate([lead, [len(part.data)]])
    begin = byte[at]
    return begin, np.concatenate([begin[1:], [len(part.data)]]), A.owner(begin, part.bounds)


def _contractions(code: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """Cut the short endings after an apostrophe that starts a pre-token: s t m d re ve ll."""
    at = np.flatnonzero(start & (code == 39))
    if not len(at):
        return
    padded = np.concatenate([code, [0, 0]])
    one, two = padded[at + 1], padded[at + 2]
    same = ~first[np.minimum(at + 1, len(code))]
    same_two = same & ~first[np.minimum(at + 2, len(code))]
    pair = lambda s: (one == ord(s[0])) & (two == ord(s[1])) & same_two
    short = np.isin(one, [ord(c) for c in "stmd"]) & same
    long = pair("re") | pair("ve") | pair("ll")
    for which, size in ((short, 2), (long & ~short, 3)):
        hit = at[which]
        start[hit + 1] = False
        after = hit + size
        after = after[after < len(code)]
        letters = classes()[code[after]] == LETTER
        start[after[letters]] = True


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([a[0], b[0]])
    order = np.argsort(key, kind="stable")
    return key[order], np.concatenate([a[1], b[1]])[order]


def _found(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    """The row number of every key, -1 where the table lacks it."""
    keys, rows = table
    if not len(keys):
        return np.full(len(key), -1, np.int32)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, rows[at], -1)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, a place of each, and which of them every key is. Only the distinct ones are sorted."""
    coded = pa.array(key).dictionary_encode()
    which, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    example = np.empty(len(found), np.int64)
    example[which] = np.arange(len(key))
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], example[order], rank[which]


class Distinct:
    """Remembers a row of numbers for every distinct pre-token it has seen, by its hash."""

    def __init__(self, encode):
        self.encode = encode  # list of bytes -> (flat values, length of each)
        self.forget()

    def forget(self) -> None:
        # Sorted hashes with row numbers: a large table, and a small one for what came last.
        self.old = self.late = (np.zeros(0, A.U64), np.zeros(0, np.int32))
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.slices = np.zeros(0, np.int32)  # that asked for each row since the last trim

    def trim(self) -> None:
        """Keep the rows that more than one slice asked for since the last trim, the most asked for if they are many."""
        most = REMEMBERED // 2
        least = max(1, int(np.partition(self.slices, -most - 1)[-most - 1])) if len(self.slices) > most else 1
        kept = np.flatnonzero(self.slices > least)
        key, row = _merged(self.old, self.late)
        number = np.full(len(self.slices), -1, np.int32)
        number[kept] = np.arange(len(kept))
        stays = number[row] >= 0
        length = np.diff(self.bounds)[kept]
        flat = self.flat[A.ranges(self.bounds[kept], length)]
        self.forget()
        self.old = key[stays], number[row[stays]]
        self.flat, self.bounds = flat, np.concatenate([[0], np.cumsum(length)])
        self.slices = np.zeros(len(kept), np.int32)

    def look_up(self, part: A.Slice, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row number of every pre-token; new ones are encoded first."""
        if len(self.bounds) > REMEMBERED:
            self.trim()
        key, example, which = _distinct(A.byte_hashes(part.data, begin, end))
        number = _found(self.old, key)
        open_ = np.flatnonzero(number < 0)
        number[open_] = _found(self.late, key[open_])
        new = np.flatnonzero(number < 0)
        if len(new):
            raw = part.data.tobytes()
            flat, length = self.encode([raw[a:b] for a, b in zip(begin[example[new]].tolist(), end[example[new]].tolist(), strict=True)])
            number[new] = np.arange(len(new)) + len(self.bounds) - 1
            self.late = _merged(self.late, (key[new], number[new]))
            if len(self.late[0]) > max(100_000, len(self.old[0]) // 4):
                self.old, self.late = _merged(self.old, self.late), (self.late[0][:0], self.late[1][:0])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(length)])
            self.slices = np.concatenate([self.slices, np.zeros(len(new), np.int32)])
        self.slices[number] += 1
        return number[which]


class Memory:
    """What the tasks of a Python worker share when it is broadcast: the tokenizer file, and what was learned from it.

    Only the file travels. A worker that runs several tasks encodes a pre-token once for all of them; the results
    do not depend on it.
    """

    def __init__(self, file: str):
        self.file, self.made = file, None

    def __getstate__(self) -> dict:
        return {"file": self.file, "made": None}

    def get(self, make) -> tuple[Distinct, list[str]]:
        if self.made is None:
            specials = special_strings(self.file)
            self.made = Distinct(make(self.file, specials)), specials
        return self.made
