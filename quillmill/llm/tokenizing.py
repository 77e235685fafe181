"""Problem 7: token ids of all texts by a public byte-level BPE tokenizer.

The merges are compiled into a deterministic automaton. Each merge (a, b) is a gadget that forbids b directly after a
and lets ab take their place; laid one after the other, the gadgets say which token may follow which. Read by bytes,
the automaton's state is what the next bytes can still change: the longest suffix that begins a token, and the last
token of the tokenization of each prefix that ends in it. States and arcs are made when first reached and kept in a
table, so that encoding is a table lookup per byte, for all words of a batch in step; walking back from each word's end
over the arcs' labels gives its tokens. The table is flushed when it is full, which changes no result.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table

TOKENIZERS = os.environ.get("QUILLMILL_TOKENIZERS", "/opt/tokenizers")
# Code points of one step's arrays, and states of the table before it is flushed.
CHUNK, MOST_STATES = 1_000_000, 1 << 16
# What the pre-tokenizer's \s matches, and its contractions.
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")
LETTER, NUMBER, OTHER, BLANK, END = 1, 2, 3, 4, 5


@functools.cache
def char_classes() -> np.ndarray:
    c = np.full(0x110001, OTHER, np.uint8)
    for o in range(0x110000):
        k = unicodedata.category(chr(o))[0]
        if k == "L":
            c[o] = LETTER
        elif k == "N":
            c[o] = NUMBER
    c[BLANKS] = BLANK
    c[0x110000] = END
    return c


def word_starts(points: np.ndarray) -> np.ndarray:
    """Where the words of the pre-tokenizer begin, for code points with 0x110000 behind each text.

    Words are runs of letters, of numbers or of other signs, each with one blank U+0020 in front if there is one, and
    runs of blanks, whose last one stands alone if anything follows; 's, 't, 're, 've, 'm, 'll and 'd are words where an
    apostrophe begins one.
    """
    kind = char_classes()[points]
    start = np.empty(kind.size, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    blank = kind == BLANK
    last = np.zeros_like(start)  # the last of a run of blanks with something behind it
    last[:-1] = blank[:-1] & ~blank[1:] & (kind[1:] != END)
    start |= last
    joined = np.zeros_like(start)  # begins right after a blank that it takes in
    joined[1:] = last[:-1] & (points[:-1] == 32)
    start &= ~joined
    start |= kind == END
    at = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
    if at.size:
        padded = np.append(points, [0x110000, 0x110000])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in SHORT])
        long = np.zeros_like(short)
        for a, b in LONG:
            long |= (one == ord(a)) & (two == ord(b))
        for where, n in ((at[short], 2), (at[long], 3)):
            start[where + 1] = False
            then = where + n
            start[then] |= kind[then] == LETTER
    return start


class MergeAutomaton:
    def __init__(self, path: str) -> None:
        """From a file of the `tokenizers` library: ids follow the order of the merges, bytes first."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = model["vocab"]
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            i = vocab[a + b]
            self.halves[i] = vocab[a], vocab[b]
            self.merged[vocab[a], vocab[b]] = i
        self.id_of = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i in self.halves or len(t) == 1}
        self.length = np.zeros(max(vocab.values()) + 1, np.int32)
        self.begins = {b""}
        for t, i in self.id_of.items():
            self.length[i] = len(t)
            self.begins.update(t[:n] for n in range(1, len(t) + 1))
        self.may_follow = functools.lru_cache(1 << 20)(self._may_follow)
        self.flush()

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether `b` may stand right after `a`: the gadgets are undone from the last merge to the first, and at none
        may a merge across the border have come earlier than those that made the two."""
        limit, merged, halves = 1 << 31, self.merged, self.halves
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            whole_a, whole_b = a not in halves, b not in halves
            if whole_a and whole_b:
                return True
            if (a > b or whole_b) and not whole_a:
                limit, a = a, halves[a][1]
            else:
                limit, b = b + 1, halves[b][0]

    def flush(self) -> None:
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self.number = {self.states[0]: 0}
        self.table = np.full(1024 * 256, -1, np.int32)
        self.token = np.full(1024, -1, np.int32)

    def _arc(self, state: int, byte: int) -> int:
        """The state after `byte`, made if it is new."""
        suffix, lasts = self.states[state]
        whole = suffix + bytes((byte,))
        drop = 0
        while whole[drop:] not in self.begins:
            drop += 1
        for n in range(len(whole) - drop, 0, -1):
            t = self.id_of.get(whole[-n:])
            before = lasts[len(whole) - n]
            if t is not None and (before < 0 or self.may_follow(before, t)):
                break
        else:
            raise ValueError("no token ends here")
        key = whole[drop:], (*lasts[drop:], t)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= self.token.size:
                self.table = np.concatenate([self.table, np.full(self.table.size, -1, np.int32)])
                self.token = np.concatenate([self.token, np.full(self.token.size, -1, np.int32)])
            self.token[to] = t
        self.table[state * 256 + byte] = to
        return to

    def encode_words(self, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words data[at : at + n], one after the other, and how many bytes end before each."""
        if len(self.states) > MOST_STATES:
            self.flush()
        order = np.argsort(-n, kind="stable")
        at, n = at[order], n[order]
        last = np.zeros(data.size, np.int32)
        state = np.zeros(at.size, np.int32)
        active = at.size - np.searchsorted(n[::-1], np.arange(1, (n[0] if n.size else 0) + 1))
        for j, k in enumerate(active):
            place = at[:k] + j
            arc = state[:k] * 256 + data[place]
            to = self.table[arc]
            if (missing := to < 0).any():
                for a in np.unique(arc[missing]).tolist():
                    self._arc(a >> 8, a & 255)
                to = self.table[arc]
            state[:k] = to
            last[place] = self.token[to]
        ends = np.zeros(data.size, bool)
        place = at + n - 1
        while place.size:  # back along the labels
            ends[place] = True
            step = self.length[last[place]]
            place, at, n = place - step, at, n
            stay = place >= at
            place, at = place[stay], at[stay]
        return last[ends], np.concatenate([[0], np.cumsum(ends)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a null or an empty text has none."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        group: list[int] = []
        size = 0
        for i, s in enumerate(texts):
            if s:
                if group and size + len(s) > CHUNK:
                    self._group(texts, group, out)
                    group, size = [], 0
                group.append(i)
                size += len(s)
        if group:
            self._group(texts, group, out)
        return out

    def _group(self, texts: list[str], group: list[int], out: list[np.ndarray]) -> None:
        lens = np.array([len(texts[i]) for i in group])
        whole = "".join(texts[i] for i in group)
        points = np.empty(len(whole) + lens.size, np.uint32)
        stop = np.cumsum(lens + 1) - 1
        inside = np.ones(points.size, bool)
        inside[stop] = False
        points[inside] = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        points[stop] = 0x110000
        width = (points < 0x110000) * (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
        byte_at = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(whole.encode("utf-8"), np.uint8)
        first = byte_at[np.flatnonzero(word_starts(points))]  # ends of texts count as starts, of no bytes
        n = np.diff(np.append(first, data.size))
        ids, upto = self.encode_words(data, first[n > 0], n[n > 0])
        cuts = upto[byte_at[np.concatenate([[0], stop])]]
        for k, i in enumerate(group):
            out[i] = ids[cuts[k] : cuts[k + 1]]

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`: the arcs' labels, put together."""
        if not hasattr(self, "label"):
            self.label = {i: t for t, i in self.id_of.items()}
        return b"".join(self.label[i] for i in ids).decode("utf-8")


@functools.cache
def automaton(path: str) -> MergeAutomaton:
    return MergeAutomaton(path)


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of `text` without special tokens, whose strings are ordinary text here; null and empty texts
    have the empty list. Rows are independent; other columns are not read. The vocabulary file is read by each Python
    worker once, from `folder`."""
    path = os.path.join(folder, f"{tokenizer}.json")

    def run(batches):
        a = automaton(path)
        for b in batches:
            ids = a.encode(b.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([x.size for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["k", "ids"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, ids array<int>").withColumnRenamed("k", key)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spread(table(spark, sf_dir, "documents", ["doc_id", "text"])), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
