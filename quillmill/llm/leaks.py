"""Problem 8: passages of held-out items inside training documents.

The items make an inverted index of character grams, weighted as BM25 does. Every passage of every document is a query:
blocks of items whose largest weights cannot reach their lowest threshold are skipped (block-max WAND, for all passages
of a batch at once), items of the other blocks are scored, and all above threshold are retrieved, without a top-k. The
overlap of each retrieved item is then verified along its diagonal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from .lookalikes import PointFolder

GRAM, BLOCK, K1, B = 6, 16, 1.2, 0.75
# A passage is retrieved if it scores this share of what the item itself scores; low, as verification follows.
THRESHOLD = 0.1
# Verification: the share of the item to be found as one passage, how far places may drift, and the longest stretch between
# equal grams (a changed character makes one of up to GRAM).
SHARE, DRIFT, GAP = 0.5, 6, 3 * GRAM
# Equal grams a passage of half the item leaves near its diagonal, as a share of the item's length, even with every eighth
# of its characters changed.
LEAST = 0.12
CHUNK = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def blank_points() -> np.ndarray:
    drop = np.zeros(0x110000, bool)
    drop[[*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    return drop


def gram_hashes(points: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `n` code points from each place on (the last n - 1 places have none)."""
    h = np.zeros(max(0, points.size - n + 1), np.uint64)
    for i in range(n):
        h = h * BASE + points[i : i + h.size].astype(np.uint64)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class ItemIndex:
    """Postings (gram -> items, places), BM25 weights and the block maxima. It grows with the items alone, which are a
    fixed, small set; it is built on the driver and sent to the workers."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        points, ends = PointFolder()(texts, blank_points())
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        keep = ends - starts >= GRAM
        self.ids = np.array(ids, np.int64)[keep] if len(ids) else np.zeros(0, np.int64)
        self.texts = [points[a:b] for a, b in zip(starts[keep], ends[keep])] if len(ends) else []
        self.length = np.array([len(t) for t in self.texts], np.int64)
        grams = [gram_hashes(t) for t in self.texts]
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.lexsort((self.place, self.item, self.gram))
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.terms, self.first, self.count = np.unique(self.gram, return_index=True, return_counts=True)
        term = np.repeat(np.arange(self.terms.size), self.count)
        pair, where, tf = np.unique(term * (len(grams) + 1) + self.item, return_index=True, return_counts=True)
        df = np.bincount(pair // (len(grams) + 1), minlength=self.terms.size)
        idf = np.log1p((len(grams) - df + 0.5) / (df + 0.5))
        norm = 1 - B + B * self.length / max(1.0, self.length.mean() if len(grams) else 1.0)
        t, d = pair // (len(grams) + 1), pair % (len(grams) + 1)
        weight = idf[t] * tf * (K1 + 1) / (tf + K1 * norm[d]) if len(grams) else np.zeros(0)
        # Each (term, item) once, with its weight; the rest of its places have weight 0.
        self.weight = np.zeros(self.gram.size)
        self.weight[where] = weight
        self.least = THRESHOLD * np.bincount(d, weights=weight, minlength=len(grams)) if len(grams) else np.zeros(0)
        # Blocks: items next to each other; per term and block the largest weight, per block the lowest threshold.
        self.blocks = (len(grams) + BLOCK - 1) // BLOCK
        key, inverse = np.unique(t * max(1, self.blocks) + d // BLOCK, return_inverse=True)
        top = np.zeros(key.size)
        np.maximum.at(top, inverse, weight)
        self.b_block, self.b_weight = key % max(1, self.blocks), top
        self.b_count = np.bincount(key // max(1, self.blocks), minlength=self.terms.size)
        self.b_first = np.concatenate([[0], np.cumsum(self.b_count)[:-1]]).astype(np.int64) if self.terms.size else np.zeros(0, np.int64)
        self.b_least = np.array([self.least[i * BLOCK : (i + 1) * BLOCK].min() for i in range(self.blocks)])
        self.window = int(self.length.max()) if len(grams) else 1
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.terms >> np.uint64(44)).astype(np.int64)] = True


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and index of first[i] .. first[i] + count[i] for all i."""
    rows = np.repeat(np.arange(first.size), count)
    return rows, np.arange(rows.size) - np.repeat(np.cumsum(count) - count, count) + first[rows]


def _extended(doc: np.ndarray, item: np.ndarray, p: int, q: int, step: int) -> int:
    """How many more characters of the passage follow in one direction, over single changed ones."""
    n = 0
    while 0 <= p < doc.size and 0 <= q < item.size:
        if doc[p] != item[q]:
            a, b = p + 2 * step, q + 2 * step
            if not (0 <= a < doc.size and 0 <= b < item.size and doc[p + step] == item[q + step] and doc[a] == item[b]):
                break
        n, p, q = n + 1, p + step, q + step
    return n


def longest_passage(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray) -> int:
    """How much of `item` stands in `doc` as one passage, given the places p, q of equal grams: along each diagonal
    that has enough of them for a passage with a few changed characters."""
    order = np.argsort(p - q, kind="stable")
    p, q = p[order], q[order]
    diagonal = p - q
    upto = np.searchsorted(diagonal, diagonal + DRIFT, "right")
    rich = np.flatnonzero(upto - np.arange(p.size) >= LEAST * item.size)
    best, beyond = 0, None
    for lo in rich.tolist():
        if beyond is not None and diagonal[lo] <= beyond:
            continue
        beyond = diagonal[lo] + DRIFT // 2
        at = np.argsort(q[lo : upto[lo]], kind="stable") + lo
        qs, ps = q[at], p[at]
        cuts = np.flatnonzero(np.diff(qs) > GAP)
        for a, b in zip(np.concatenate([[0], cuts + 1]).tolist(), np.concatenate([cuts, [qs.size - 1]]).tolist()):
            span = int(qs[b] - qs[a]) + GRAM
            if span + 2 * GAP > max(best, SHARE * item.size):
                left = _extended(doc, item, int(ps[a]) - 1, int(qs[a]) - 1, -1)
                right = _extended(doc, item, int(ps[b]) + GRAM, int(qs[b]) + GRAM, 1)
                best = max(best, span + left + right)
    return best


def search(index: ItemIndex, folder: PointFolder, drop: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
    """(number of the text, number of the item) of all verified overlaps."""
    points, ends = folder(texts, drop)
    h = gram_hashes(points)
    if not h.size or not index.terms.size:
        return []
    at = np.flatnonzero(index.bits[(h >> np.uint64(44)).astype(np.int64)])
    term = np.searchsorted(index.terms, h[at])
    hit = index.terms[np.minimum(term, index.terms.size - 1)] == h[at]
    at, term = at[hit], term[hit]
    doc = np.searchsorted(ends, at, "right")
    inside = at + GRAM <= ends[doc]
    at, term, doc = at[inside], term[inside], doc[inside]
    # Passages: windows of twice the longest item, each half over the next; places count in both windows they are in.
    w = index.window
    starts = np.concatenate([[0], ends[:-1]])
    per_doc = (ends - starts) // w + 1
    base = np.concatenate([[0], np.cumsum(per_doc)])
    half = base[doc] + (at - starts[doc]) // w
    # Each term counts once a half window.
    _, once = np.unique(half * index.terms.size + term, return_index=True)
    rows, b = _expand(index.b_first[term[once]], index.b_count[term[once]])
    blocks = max(1, index.blocks)
    cell, inv = np.unique(half[once][rows] * blocks + index.b_block[b], return_inverse=True)
    bound = np.bincount(inv, weights=index.b_weight[b])
    following = np.searchsorted(cell, cell + blocks)
    same = (following < cell.size) & (cell[np.minimum(following, cell.size - 1)] == cell + blocks)
    window = bound + np.where(same, bound[np.minimum(following, cell.size - 1)], 0)
    live = window >= index.b_least[cell % blocks]
    alive = np.unique(np.concatenate([cell[live], (cell + blocks)[live]]))
    # Items of live blocks.
    rows, k = _expand(index.first[term], index.count[term])
    item = index.item[k]
    own = half[rows] * blocks + item // BLOCK
    place = np.minimum(np.searchsorted(alive, own), max(0, alive.size - 1))
    stays = (alive[place] == own) if alive.size else np.zeros(own.size, bool)
    rows, k, item = rows[stays], k[stays], item[stays]
    if not rows.size:
        return []
    n = index.ids.size
    pair, first = np.unique((half[rows] * index.terms.size + term[rows]) * n + item, return_index=True)
    weight = np.zeros(index.terms.size)
    cell, inv = np.unique(half[rows][first] * n + item[first], return_inverse=True)
    score = np.bincount(inv, weights=_weights(index, term[rows][first], item[first]))
    following = np.minimum(np.searchsorted(cell, cell + n), cell.size - 1)
    window = score + np.where(cell[following] == cell + n, score[following], 0)
    live = window >= index.least[cell % n]
    owner = np.searchsorted(base, cell[live] // n, "right") - 1
    wanted = np.unique(owner * n + cell[live] % n)
    key = doc[rows] * n + item
    place = np.minimum(np.searchsorted(wanted, key), max(0, wanted.size - 1))
    stays = (wanted[place] == key) if wanted.size else np.zeros(key.size, bool)
    rows, k, key = rows[stays], k[stays], key[stays]
    order = np.argsort(key, kind="stable")
    rows, k, key = rows[order], k[order], key[order]
    # A passage of half the item leaves equal grams in a row on its diagonal: pairs without enough of them can't be.
    out = []
    cuts = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [key.size]])) if key.size else ():
        i, d = int(key[a] % n), int(key[a] // n)
        length = int(index.length[i])
        if b - a < LEAST * length:
            continue
        p, q = at[rows[a:b]] - starts[d], index.place[k[a:b]]
        if longest_passage(points[starts[d] : ends[d]], index.texts[i], p, q) >= SHARE * length:
            out.append((d, i))
    return out


def _weights(index: ItemIndex, term: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The weight of each (term, item), which stands at the pair's first posting."""
    span = index.ids.size + 1
    if not hasattr(index, "pair_key"):
        t = np.repeat(np.arange(index.terms.size), index.count)
        index.pair_key = t * span + index.item  # sorted, as postings are
    return index.weight[np.searchsorted(index.pair_key, term * span + item)]


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key) of the documents that contain at least half of an item's text as one passage, apart from white
    space, look-alike characters and a few changed characters. Null and empty texts contain and are nothing; items
    shorter than a gram aren't found. Items with equal texts are each reported. The items must fit a driver (they are
    collected); documents aren't shuffled, and each is searched whole."""
    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("long"), item_text).orderBy(item_key).collect()
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows]))

    def run(batches):
        folder, drop, ix = PointFolder(), blank_points(), index.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found, a, size = [], 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size and size + len(texts[i]) > CHUNK:
                    found += [(ids[a + d], int(ix.ids[k])) for d, k in search(ix, folder, drop, texts[a:i])]
                    a, size = i, 0
                if i < len(texts):
                    size += len(texts[i])
            x, y = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["k", "i"])

    whole = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null and t <> ''")
    return whole.mapInArrow(run, "k long, i long").select(F.col("k").alias(key), F.col("i").alias(item_key))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spread(table(spark, sf_dir, "documents", ["doc_id", "text"])), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items and in how many documents each stands."""
    items = table(spark, sf_dir, "eval_items", ["item_id", "split"])
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs")).join(items, "item_id")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
ORACLES: dict[str, str] = {}
