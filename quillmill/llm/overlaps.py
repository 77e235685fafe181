"""Problem 4: records of evaluation splits that stand, exactly or almost, in the training split.

A hash join on pieces and edit distance, in place of a suffix array: no suffixes are sorted and no spans merged into coverage.
Exact for the allowed edits, by pigeonhole. A training text of n code points can be n // 9 edits from its longest partner, so
of n // 9 + 1 disjoint pieces one at least stands unchanged in any partner. All pieces of the training texts are looked up
among the evaluation texts' grams of the pieces' length, at every place to which the edits beside a piece can move it. Pieces
of the first half count places from the start and those of the second half from the end, as edits move these least. Both are
partitioned by their hash; a partition that a common piece overfills is split up, round after round, until each fits a task.
Pairs of texts whose pieces, places, lengths, neighbouring pieces and character counts on both sides of the piece allow it are
verified by edit distance. Texts are compared in the form of problem 1 and stand once in all, however many rows have them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, over_batches, spread, table, written
from .leaks import _expand, gram_hashes
from .lookalikes import PointFolder

# Code points looked up of each piece, by the least length of the training text: no more than the text's pieces have room for.
PIECES = ((9, 4), (12, 6), (28, 7), (64, 8))
# A share of the longer text may differ.
EDITS = 10
# Ids of candidate texts that are broadcast at most; beyond that they are joined by a shuffle.
MOST_BROADCAST = 500_000
# Pieces and grams (of 29 bytes) that one task may hold before it splits its partition up; partitions are made for a quarter
# of it, but not more of them than a shuffle can keep track of. SALT: in how many parts of each side a later split cuts.
MOST_ENTRIES, MOST_PARTITIONS, SALT = 1_000_000, 100_000, 4
KINDS = 21
# Pairs from which all rows are compared with all of a range, and how many of them at a time (they fit a core's cache).
LARGE, BLOCK = 1024, 65_536
FIELDS = ("original", "corrupted")
# sketch: character counts of the text; outer: of what lies between the gram and the end its place counts from; left: the
# NEAR code points in front of the gram, in 3 bits each, the nearest lowest.
ENTRY = np.dtype([("gram", "<u4"), ("place", "<u4"), ("length", "<u4"), ("side", "u1"), ("left", "<u4"), ("id", "<u8"), ("sketch", "<u8"), ("outer", "<u8")])
NEAR = 9
# Bits of `side` over those of the fields: which of PIECES, and that the place counts from the end.
KIND, FROM_END = 16, 64
# Bits of the fields on each side.
TRAIN, EVAL = 0b0101, 0b1010


def _folded(texts: list[str], folder: PointFolder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, starts, ends) of the forms of `texts`."""
    points, ends = folder(texts)
    ends = np.asarray(ends, np.int64)
    return points, np.concatenate([[0], ends[:-1]]).astype(np.int64) if ends.size else ends, ends


def _points(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts that have their form already."""
    ends = np.cumsum([len(x) for x in forms]).astype(np.int64)
    return np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], ends[:-1]]).astype(np.int64) if ends.size else ends, ends


def _gram_kinds(points: np.ndarray, owner: np.ndarray):
    """(kind, code points, hashes, whether a gram lies within one text) of each of PIECES that the points have room for."""
    for kind, (_, q) in enumerate(PIECES):
        if points.size >= q:
            h = gram_hashes(points, q)
            yield kind, q, h, owner[: h.size] == owner[q - 1 :]


def _tagged(h: np.ndarray, kind: int, from_end: bool) -> np.ndarray:
    return h ^ np.uint64(0x9E3779B97F4A7C15 * (2 * kind + from_end) & 0xFFFFFFFFFFFFFFFF)


def training_pieces(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, bits for `side`) of all pieces of the wanted texts."""
    n = ends - starts
    number = n // (EDITS - 1) + 1
    first = (number + 1) // 2
    upto = [*[least for least, _ in PIECES[1:]], np.iinfo(np.int64).max]
    out = []
    for kind, q, h, _ in _gram_kinds(points, np.zeros(points.size, np.int8)):
        own = np.flatnonzero(wanted & (n >= PIECES[kind][0]) & (n < upto[kind]))
        for from_end, count in ((False, first), (True, number - first)):
            text, i = _expand(np.zeros(own.size, np.int64), count[own])
            text = own[text]
            at = ends[text] - q * (i + 1) if from_end else starts[text] + q * i
            out.append((text, q * i, _tagged(h[at], kind, from_end), np.full(text.size, kind * KIND + from_end * FROM_END, np.uint8)))
    return _concatenated(out)


def evaluation_grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, bits for `side`) of all grams of the wanted texts that a piece of a partner can be: piece i of q
    code points stands at q * i and is moved by i places at most."""
    m = ends - starts
    owner = np.repeat(np.arange(starts.size), m)
    low, high = m - m // EDITS, m + m // (EDITS - 1)  # lengths of partners
    upto = [*[least for least, _ in PIECES[1:]], np.iinfo(np.int64).max]
    out = []
    for kind, q, h, inside in _gram_kinds(points, owner):
        longest = np.minimum(high, upto[kind] - 1)
        some = wanted & (m >= EDITS - 1) & (longest >= np.maximum(low, PIECES[kind][0]))
        number = np.where(some, longest // (EDITS - 1) + 1, 0)
        first = (number + 1) // 2
        at = np.flatnonzero(inside & some[owner[: h.size]])
        text = owner[at]
        for from_end, count in ((False, first), (True, number // 2)):
            place = ends[text] - q - at if from_end else at - starts[text]
            least = (place + q) // (q + 1)  # the first piece that can be moved here
            ok = (least <= place // (q - 1)) & (least < count[text])
            out.append((text[ok], place[ok], _tagged(h[at[ok]], kind, from_end), np.full(int(ok.sum()), kind * KIND + from_end * FROM_END, np.uint8)))
    return _concatenated(out)


def _concatenated(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*parts))


def character_counts(points: np.ndarray, *ranges: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """How many characters of each of KINDS kinds the points first[i] .. last[i] - 1 of each of `ranges` have, modulo 8: one
    edit changes two of them by one at most. Kinds go by code point, so that most letters of an alphabet have a kind of their own."""
    kinds = (points % KINDS).astype(np.uint8)
    out = [np.zeros(first.size, np.uint64) for first, _ in ranges]
    upto = np.zeros(points.size + 1, np.uint8)  # modulo 256
    for k in range(KINDS):
        np.cumsum(kinds == k, dtype=np.uint8, out=upto[1:])
        for n, (first, last) in zip(out, ranges):
            n |= ((upto[last] - upto[first]) & np.uint8(7)).astype(np.uint64) << np.uint64(3 * k)
    return out


def counts_less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts a - b, kind by kind and modulo 8."""
    top = np.uint64(sum(4 << 3 * i for i in range(KINDS)))
    return ((a | top) - (b & ~top)) ^ ((a ^ ~b) & top)


def counts_in_gray(a: np.ndarray) -> np.ndarray:
    """Counts in Gray code: as many bits differ as steps lie between two counts, or fewer."""
    return a ^ ((a >> np.uint64(1)) & np.uint64(sum(3 << 3 * i for i in range(KINDS))))


def gray_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`count_distance` or less, at once for all kinds."""
    return np.bitwise_count(counts_in_gray(a) ^ counts_in_gray(b))


def points_in_front(points: np.ndarray) -> np.ndarray:
    """`left` of each place. In front of a text stands what happens to: a piece that is looked at has a whole one in front."""
    few = (points.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(29)
    out = np.zeros(points.size, np.uint32)
    for d in range(1, min(NEAR, points.size) + 1):
        out[d:] |= few[: points.size - d] << np.uint32(3 * (d - 1))
    return out


def count_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least sum of differences of the counts, given them modulo 8."""
    out = np.zeros(a.size, np.int64)
    for i in range(0, 3 * KINDS, 3):
        d = ((a >> np.uint64(i)) - (b >> np.uint64(i))) & np.uint64(7)
        out += np.minimum(d, np.uint64(8) - d).astype(np.int64)
    return out


def gram_blocks(texts: DataFrame, partitions: int) -> DataFrame:
    """(part, block): the pieces and grams of each batch of (id, side, form), packed by the partition that joins them."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sides = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy().astype(np.uint8)
            points, starts, ends = _points(batch.column(2).to_pylist())
            t, v = (f(points, starts, ends, sides & bits != 0) for f, bits in ((training_pieces, TRAIN), (evaluation_grams, EVAL)))
            text, place, h, more = _concatenated([t, v])
            e = np.empty(text.size, ENTRY)
            e["gram"] = (h & np.uint64(0xFFFFFF)).astype(np.uint32)  # enough to tell a partition's grams apart
            back, q = more & FROM_END != 0, np.array([q for _, q in PIECES])[more // KIND & 3]
            at = np.where(back, ends[text] - q - place, starts[text] + place)
            sketch, outer = character_counts(points, (starts, ends), (np.where(back, ends[text] - place, starts[text]), np.where(back, ends[text], at)))
            e["place"], e["length"], e["id"], e["sketch"], e["outer"] = place, (ends - starts)[text], ids[text], sketch[text], outer
            wide = 2 * (q // 2) + np.repeat([0, 1], [t[0].size, v[0].size])  # what is looked at of a piece and of a gram
            e["left"] = points_in_front(points)[at] & ((1 << 3 * wide) - 1).astype(np.uint32)
            e["side"] = sides[text] & np.repeat(np.array([TRAIN, EVAL], np.uint8), [t[0].size, v[0].size]) | more
            yield _by_part(e, (h >> np.uint64(32)).astype(np.int64) % partitions)

    return texts.select("id", "side", "form").mapInArrow(run, "part int, block binary")


def _by_part(e: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((e["gram"], part))
    e, part = e[order], part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), part.size] if part.size else []
    blocks = [(int(part[a]), _packed(e[a:b])) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["part", "block"])


def _packed(e: np.ndarray) -> bytes:
    """Their number, and byte by byte: all first bytes, all second ones and so on, most of which take few values. Entropy
    coded, as the shuffle's own codec finds repeats only."""
    return e.size.to_bytes(4, "little") + pa.compress(e.view(np.uint8).reshape(-1, ENTRY.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(block: bytes) -> np.ndarray:
    size = int.from_bytes(block[:4], "little") * ENTRY.itemsize
    planes = pa.decompress(block[4:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(ENTRY.itemsize, -1).T).view(ENTRY)[:, 0]


def neighbour_alike(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether one edit at most can have made the q code points in front of gram a of those in front of piece b: of their
    halves the one next to the piece is the same, or the other one is, moved by one place at most."""
    h = (3 * (q // 2)).astype(np.uint32)  # bits of a half
    mask = (np.uint32(1) << h) - np.uint32(1)
    ok = (a ^ b) & mask == 0
    for d in (-3, 0, 3):
        ok |= ((a >> (h + np.int32(d)).astype(np.uint32)) ^ (b >> h)) & mask == 0
    return ok


def _near_ranges(counts: list[tuple[np.ndarray, np.ndarray]], most: list[np.ndarray], row: np.ndarray, first: np.ndarray, last: np.ndarray, cell: np.ndarray, chunk: int):
    """(row, t) in chunks: for each i, of the training pieces t in first[i] .. last[i] - 1, those of which each of the counts,
    in Gray code, differ in most[i] bits at most. Rows of one cell have nearly the same range and bounds: where there are many
    pairs, all are compared with all by the largest bounds, without an index for each pair."""
    if not row.size:
        return
    order = np.argsort(cell)
    row, first, last, cell, most = row[order], first[order], last[order], cell[order], [x[order] for x in most]
    cut = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), cell.size)
    rows, low, high = np.diff(cut), np.minimum.reduceat(first, cut[:-1]), np.maximum.reduceat(last, cut[:-1])
    bounds = [np.minimum(np.maximum.reduceat(x, cut[:-1]), 64).tolist() for x in most]
    many = (rows > 1) & (rows * (high - low) >= LARGE)
    for g in np.flatnonzero(many).tolist():
        some, lo, hi = row[cut[g] : cut[g + 1]], int(low[g]), int(high[g])
        step = max(1, BLOCK // (hi - lo))
        for k in range(0, some.size, step):
            for at in range(lo, hi, BLOCK):
                ok = True
                for (a, b), bound in zip(counts, bounds):
                    ok &= np.bitwise_count(a[some[k : k + step], None] ^ b[None, at : min(hi, at + BLOCK)]) <= bound[g]
                pair = np.flatnonzero(ok)
                if pair.size:
                    r, t = np.divmod(pair, ok.shape[1])
                    yield some[k + r], at + t
    single = ~np.repeat(many, rows)
    row, first, count, most = row[single], first[single], (last - first)[single], [x[single] for x in most]
    cuts = np.flatnonzero(np.diff(np.cumsum(count) // chunk)) + 1 if count.size else []
    for lo, hi in zip([0, *cuts], [*cuts, row.size]):
        i, t = _expand(first[lo:hi], count[lo:hi])
        for (a, b), bound in zip(counts, most):
            ok = np.bitwise_count(a[row[lo:hi]][i] ^ b[t]) <= bound[lo:hi][i]
            i, t = i[ok], t[ok]
        yield row[lo:hi][i], t


def _gathered(pairs, least: int):
    """The same pairs, at least so many at a time."""
    held, n = [], 0
    for r, t in pairs:
        held.append((r, t))
        n += r.size
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def alike_pairs(e: np.ndarray, chunk: int = 1_000_000) -> np.ndarray:
    """Pairs of text ids (evaluation, training) of a partition of which a gram is a piece, at places and in texts that few
    enough edits could make of each other. Exact for what it is given: no group is capped.

    Of the pieces of a text that are the same in its partner, the one is looked for that is the first to have no more edits
    up to its end than pieces in front. It has just as many in front as pieces, and the piece next to it in front has one at
    most (else an earlier piece would be the first). So the counts of what stands in front differ by twice its number of
    pieces at most, those of what stands behind by twice the edits that are left."""
    train, evals = e[(e["side"] & TRAIN) != 0], e[(e["side"] & EVAL) != 0]
    if not train.size or not evals.size:
        return np.zeros((0, 2), np.uint64)
    # Grams of one kind, and of one end that places count from.
    a_gram, b_gram = (x["gram"].astype(np.uint64) << np.uint64(8) | x["side"] & np.uint8(3 * KIND + FROM_END) for x in (evals, train))
    grams, group = np.unique(b_gram, return_inverse=True)
    at = np.minimum(np.searchsorted(grams, a_gram), grams.size - 1)
    ok = grams[at] == a_gram
    evals, at = evals[ok], at[ok]
    # Training pieces in order of gram, place and length; a row for each piece that can be moved to a gram's place.
    order = np.lexsort((train["length"], train["place"], group))
    train, group = train[order], group[order]
    slot = (group.astype(np.uint64) << np.uint64(32)) | train["place"].astype(np.uint64)
    slots, begin = np.unique(slot, return_index=True)
    q = np.array([q for _, q in PIECES])[(evals["side"] // KIND) & 3]
    place, m = evals["place"].astype(np.int64), evals["length"].astype(np.int64)
    base = at.astype(np.uint64) << np.uint64(32)
    first = np.searchsorted(slots, base | (q * ((place + q) // (q + 1))).astype(np.uint64))
    last = np.searchsorted(slots, base | (q * (place // (q - 1))).astype(np.uint64), "right")
    row, cell = _expand(first, np.maximum(last - first, 0))
    # Within a slot the lengths are in order.
    dense = np.repeat(np.arange(slots.size, dtype=np.uint64), np.diff(np.append(begin, train.size))) << np.uint64(32) | train["length"].astype(np.uint64)
    low, high = m - m // EDITS, m + m // (EDITS - 1)
    base = cell.astype(np.uint64) << np.uint64(32)
    first = np.searchsorted(dense, base | low[row].astype(np.uint64))
    last = np.searchsorted(dense, base | high[row].astype(np.uint64), "right")
    a_side, a_left, a_id, b_side, b_left, b_id = (np.ascontiguousarray(x[c]) for x in (evals, train) for c in ("side", "left", "id"))
    a_outer, a_counts, b_outer, b_counts = (np.ascontiguousarray(x[c]) for x in (evals, train) for c in ("outer", "sketch"))
    counts = [(a_outer, b_outer), (counts_less(a_counts, a_outer), counts_less(b_counts, b_outer)), (a_counts, b_counts)]
    b_place, b_length, b_back = train["place"].astype(np.int64), train["length"].astype(np.int64), b_side & FROM_END != 0
    index = b_place // np.array([q for _, q in PIECES])[(b_side // KIND) & 3]  # pieces before this one, or behind it
    b_front = np.where(b_back, b_length // (EDITS - 1) - index, index)
    # What any piece of a slot allows: the counts on the side that places count from, and those on the other.
    i, back = index[begin][cell], b_back[begin][cell]
    outer = 2 * i - np.abs(place[row] - b_place[begin][cell])
    inner = 2 * (high[row] // np.where(back, EDITS - 1, EDITS) - i)
    some = (last > first) & (outer >= 0) & (inner >= 0)
    row, first, last, cell, outer, inner = row[some], first[some], last[some], cell[some], outer[some], inner[some]
    # Rows of one cell, one bound and nearly one length are compared together.
    step = (np.log(np.maximum(m, 1)) / np.log(1.04)).astype(np.int64)
    bounds, nth = np.unique(outer, return_inverse=True)
    alike = (cell * bounds.size + nth) * 1024 + step[row]
    found = []
    gray = [(counts_in_gray(a), counts_in_gray(b)) for a, b in counts[:2]]
    for r, t in _gathered(_near_ranges(gray, [outer, inner], row, first, last, alike, chunk), chunk // 4):
        ok = (b_front[t] == 0) | neighbour_alike(a_left[r], b_left[t], q[r])
        r, t = r[ok], t[ok]
        ok = (((a_side[r] >> 1) & b_side[t] & TRAIN) != 0) & (a_id[r] != b_id[t])  # one field on both sides
        r, t = r[ok], t[ok]
        front, back = b_front[t], b_back[t]
        most = np.maximum(m[r], b_length[t]) // EDITS
        over = m[r] - b_length[t]
        moved = place[r] - b_place[t]
        shift = np.where(back, over - moved, moved)
        ok = (np.abs(shift) <= front) & (np.abs(over - shift) <= most - front)
        ahead, behind = 2 * front - np.abs(shift), 2 * (most - front) - np.abs(over - shift)
        r, t = r[ok], t[ok]
        limits = [x[ok] for x in (np.where(back, behind, ahead), np.where(back, ahead, behind), 2 * most - np.abs(over))]
        for test in (gray_distance, count_distance):
            for k, (x, y) in enumerate(counts):
                ok = test(x[r], y[t]) <= limits[k]
                r, t, limits = r[ok], t[ok], [x[ok] for x in limits]
        if r.size:
            found.append(np.unique(np.stack([a_id[r], b_id[t]], 1), axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)


def split_up(e: np.ndarray, origin: int, partitions: int, turn: int) -> pa.RecordBatch:
    """The entries of an overfull partition, packed for `partitions` smaller ones. The first time they part by gram and by
    the text's length, in steps of a quarter, and evaluation grams go to all steps that may hold a match. Later, each side
    parts in SALT by ids and places and goes to all parts of the other, so that a single gram's group is cut up however large."""
    n, train = e["length"].astype(np.int64), (e["side"] & TRAIN) != 0
    if turn == 0:
        step = lambda n: np.floor(np.log(np.maximum(n, 1)) / np.log(1.25)).astype(np.int64)
        low, high = step(np.where(train, n, n - n // EDITS - 1)), step(np.where(train, n, n + n // (EDITS - 1) + 1))
        row, cell = _expand(low, high - low + 1)
    else:
        own = e["id"] * np.uint64(0x9E3779B97F4A7C15) + e["place"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn)
        own = ((own ^ own >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % SALT
        row = np.repeat(np.arange(e.size), SALT)
        other = np.tile(np.arange(SALT), e.size)
        cell = np.where(train[row], own[row] * SALT + other, other * SALT + own[row])
    e = e[row]
    key = e["gram"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cell.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(origin) * np.uint64(0x165667B19E3779F9)
    return _by_part(e, ((key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % partitions)


def _searched(blocks: DataFrame, partitions: int, most: int, turn: int) -> DataFrame:
    """(id_e, id_t, part, block): the pairs of each partition, or, of a partition of more than `most` entries, its blocks
    split up, as they come in: no more than that is ever held."""

    def rows(pairs: np.ndarray, parts: pa.RecordBatch | None):
        n, m = len(pairs), parts.num_rows if parts else 0
        ids = [pa.array([*pairs[:, i].view(np.int64).tolist(), *[None] * m], pa.int64()) for i in (0, 1)]
        more = [pa.concat_arrays([pa.nulls(n, t), parts.column(k)]) if parts else pa.nulls(n, t) for k, t in enumerate((pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*ids, *more], names=["id_e", "id_t", "part", "block"])

    none = np.zeros((0, 2), np.uint64)

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                e = _unpacked(b)
                size[p] = size.get(p, 0) + e.size
                if size[p] > most:
                    for x in [*held.pop(p, []), e]:
                        yield rows(none, split_up(x, p, partitions, turn))
                else:
                    held.setdefault(p, []).append(e)
        for parts in held.values():
            yield rows(alike_pairs(np.concatenate(parts)), None)

    return blocks.mapInArrow(run, "id_e long, id_t long, part int, block binary")


def candidates(texts: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(id_e, id_t): pairs of different texts that share a piece where few enough edits leave it. There are as many
    partitions as the texts have pieces and grams for, at the least those of the session's shuffles."""
    n = F.length("form")
    entries = texts.agg(F.sum(F.when(F.col("side").bitwiseAND(TRAIN) != 0, F.floor(n / (EDITS - 1)) + 1).otherwise(0) + F.when(F.col("side").bitwiseAND(EVAL) != 0, n).otherwise(0))).first()[0] or 0
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = min(MOST_PARTITIONS, max(least, 4 * entries // most))
    blocks, found, turn = gram_blocks(texts, partitions), [], 0
    while True:
        more = min(MOST_PARTITIONS, partitions * 2)
        done = written(_searched(blocks.repartitionById(partitions, "part"), more, most, turn))  # as numbered: none gets two by chance
        found.append(done.where("part is null").select("id_e", "id_t"))
        blocks, partitions, turn = done.where("part is not null").select("part", "block"), more, turn + 1
        if blocks.isEmpty():
            return reduce(DataFrame.unionAll, found).distinct()


def near_pairs(texts: DataFrame, **limits: int) -> DataFrame:
    """(h1_e, h2_e, h1_t, h2_t): pairs of different texts within the allowed edits, verified on the whole forms."""
    pairs = written(candidates(texts, **limits))
    ids = pairs.select(F.explode(F.array("id_e", "id_t")).alias("id")).distinct()
    some = written(texts.join(broadcast_if_small(ids, MOST_BROADCAST), "id").select("id", "h1", "h2", "form"))
    of = lambda x: some.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "h1", "h2", "form")])
    most = F.floor(F.greatest(F.length("form_e"), F.length("form_t")) / EDITS).cast("int")
    joined = pairs.join(of("e"), "id_e").join(of("t"), "id_t").withColumn("most", most)
    return joined.where(F.expr("levenshtein(form_e, form_t, most) >= 0")).select("h1_e", "h2_e", "h1_t", "h2_t")  # in a band


def text_table(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (row_id, eval, field, text): the rows with a 128-bit hash of their form, and the distinct forms as (id, h1, h2,
    side, form), side having a bit for each field and split that has the form. One pass makes both: the first row of a form
    in a batch brings the form along."""
    schema = pa.schema([("row_id", pa.int64()), ("eval", pa.int32()), ("field", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("side", pa.int32()), ("form", pa.string())])

    def work(batch, folder):
        split, field = (batch.column(i).to_numpy() for i in (1, 2))
        texts, number = np.unique(np.array(batch.column(3).to_pylist(), object), return_inverse=True)
        points, starts, ends = _folded(texts.tolist(), folder)
        data = points.astype("<u4").tobytes()
        forms = [data[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]
        first: dict[str, int] = {}
        number = np.array([first.setdefault(x, len(first)) for x in forms], np.int64)[number]
        one, two = (np.array(x, np.uint64).view(np.int64) for x in zip(*(divmod(xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")), 1 << 64) for x in first)))
        sides = np.zeros(len(first), np.int32)
        np.bitwise_or.at(sides, number, np.left_shift(1, field * 2 + split).astype(np.int32))
        _, at = np.unique(number, return_index=True)
        brings = np.zeros(number.size, bool)
        brings[at] = True
        names = list(first)
        form = [names[k] if b else None for k, b in zip(number.tolist(), brings.tolist())]
        return [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int32()), one[number], two[number], pa.array(sides[number], pa.int32(), mask=~brings), form]

    rows = written(over_batches(flat, work, schema, "row_id long, eval int, field int, h1 long, h2 long, side int, form string", PointFolder))
    once = rows.where("form is not null").groupBy("h1", "h2").agg(F.bit_or("side").alias("side"), F.first("form").alias("form"))
    return rows.select("row_id", "eval", "field", "h1", "h2"), written(once.withColumn("id", F.monotonically_increasing_id()))


def cross_split_pairs(records: DataFrame, **limits: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the rows of training and evaluation splits whose texts of one field are equal or almost
    equal. `records` has (row_id, split, original, corrupted); a null text or split is no case, empty texts equal each
    other. Rows with equal texts are brought together by hash joins, whose work is that of the result."""
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("dev", "test"), 1)
    flat = records.where("split is not null").select(
        "row_id", side.alias("eval"), F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).alias("text")) for i, f in enumerate(FIELDS)])).alias("x")
    ).where("x.text is not null and eval is not null").select("row_id", "eval", "x.field", "x.text")
    rows, texts = text_table(flat)
    # Forms that both sides of a field have are their own partners; only rows of forms with a partner are joined.
    shared = F.col("side").bitwiseAND(TRAIN) * 2
    own = texts.where(shared.bitwiseAND(F.col("side")) != 0).select(*[F.col(c).alias(f"{c}_{x}") for x in "et" for c in ("h1", "h2")])
    forms = written(own.unionByName(near_pairs(texts, **limits)))
    e = rows.where("eval = 1").select(F.col("row_id").alias("a"), "field", F.col("h1").alias("h1_e"), F.col("h2").alias("h2_e"))
    t = rows.where("eval = 0").select(F.col("row_id").alias("b"), "field", F.col("h1").alias("h1_t"), F.col("h2").alias("h2_t"))
    wanted = lambda side, x: side.join(broadcast_if_small(forms.select(f"h1_{x}", f"h2_{x}").distinct(), MOST_BROADCAST), [f"h1_{x}", f"h2_{x}"], "left_semi")
    both = forms.join(wanted(e, "e"), ["h1_e", "h2_e"]).join(wanted(t, "t"), ["h1_t", "h2_t", "field"])
    return both.select("a", "b").distinct().select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_pairs(spread(table(spark, sf_dir, "corruptions", ["row_id", "split", "original", "corrupted"])))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, source, n_pairs, n_rows): overlaps of the evaluation rows, per split and source."""
    pairs = p4_found(spark, sf_dir)
    rows = table(spark, sf_dir, "corruptions", ["row_id", "split", "source"]).where("split in ('dev', 'test')")
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("row_id"))
    return ends.join(rows, "row_id").groupBy("split", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("row_id").alias("n_rows"))


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
ORACLES: dict[str, str] = {}
