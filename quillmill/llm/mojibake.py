"""Problem 6: text read with a wrong encoding: which values, and what they were.

Every code-page swap (written in one encoding, read in another) is taken as a substitution cipher: garbled units stand
for letters. Bigrams of the whole corpus are the language model. Expectation-maximization learns how much each source
uses each swap, from how much likelier the deciphered text is, and with it which unit means which letter; the learned
table is applied to the values, and where a unit lost bytes the model's best letter that fits the rest takes its place.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpointed, over_batches, spread, table

LOST = "�"
BUCKETS = 1 << 19
# Swaps: how the bytes were read, and what they were written in.
SWAPS = [("latin", "utf-8"), ("gb18030", "utf-8"), ("cp932", "utf-8"), ("big5hkscs", "utf-8"), ("latin", "gb18030"), ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("latin", "euc_kr"), ("latin", "euc_jp")]
SINGLE = {"latin", "cp1251", "koi8-r"}  # pages of one byte a character
# Prior odds of a swap before any is learned, rounds of EM, and the range of the likelihood gain's histogram.
PRIOR, ROUNDS, RANGE = 0.01, 8, 40
# Weight of single letters in the bigram model.
BACK = 4.0
# Gain of a short value all of whose characters are one letter.
SURE = 12.0
# The swap that loses most bytes: a lost character that no swap explains is put down to it.
HEAVY = 3
LETTERS = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2})+")
PAIRS = re.compile(rb"(?:[\xa1-\xa9\xb0-\xf7][\xa1-\xfe])+")
BROKEN = re.compile(rb"[\xe2-\xef][\x80-\xbf]")


@functools.cache
def page(name: str) -> list[bytes | None]:
    """Code point (of the basic plane) -> its bytes in a code page, or None. ASCII stands for itself."""
    out: list[bytes | None] = [None] * 0x10000
    for o in range(0x10000):
        c = chr(o)
        try:
            if name != "latin":
                out[o] = c.encode(name)
            elif o < 0x100:
                out[o] = c.encode("latin-1")
            else:
                out[o] = c.encode("cp1252")
        except UnicodeEncodeError:
            pass
    for o in range(0x80, 0x10000):
        if out[o] is not None and (len(out[o]) > 2 or out[o][0] < 0x80):
            out[o] = None
    return out


@functools.cache
def page_arrays(name: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second byte per code point; 0 where there is none."""
    p = page(name)
    return np.array([b[0] if b and b[0] >= 0x80 else 0 for b in p], np.uint8), np.array([b[1] if b and len(b) > 1 else 0 for b in p], np.uint8)


class Model:
    """Smoothed log-likelihood of bigrams, from hashed counts; its size doesn't depend on the corpus."""

    def __init__(self, single: np.ndarray, double: np.ndarray) -> None:
        self.single, self.double = single.astype(np.float64), double.astype(np.float64)
        self.total = max(1.0, self.single.sum())
        self.kinds = max(1, int((single > 0).sum()))
        by_start: dict[bytes, list[tuple[int, str]]] = {}
        for o in np.flatnonzero(single):
            if 0x2000 <= o and not 0xD800 <= o < 0xE000 and o != 0xFFFD:
                b = chr(o).encode("utf-8")
                for n in range(1, len(b)):
                    by_start.setdefault(b[:n], []).append((int(single[o]), chr(o)))
        self.by_start = {k: [c for _, c in sorted(v, reverse=True)[:64]] for k, v in by_start.items()}

    @staticmethod
    def bucket(a, b):
        return (a * 0x9E3779B1 + b * 0x85EBCA6B) % BUCKETS

    def text(self, s: str, left: str = "", right: str = "") -> float:
        """Log-likelihood of `s` between its neighbours: bigrams, backed by single letters; a lost letter costs a fixed
        amount. The first letter of a text counts alone."""
        p = np.frombuffer((left + s + right).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not p.size:
            return 0.0
        alone = (self.single[p] + 0.01) / (self.total + 0.01 * self.kinds)
        alone[p == 0xFFFD] = 3e-4
        a, b = p[:-1], p[1:]
        known = np.where((a == 0xFFFD) | (b == 0xFFFD), 0.0, self.double[self.bucket(a, b)])
        after = (known + BACK * alone[1:]) / (np.where(a == 0xFFFD, 0.0, np.maximum(self.single[a], known)) + BACK)
        return float(np.log(after).sum() + (0.0 if left else np.log(alone[0])))

    @staticmethod
    def counts(batches):
        single, double = np.zeros(0x110000, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = [s for s in batch.column(0).to_pylist() if s]
            p = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if p.size:
                single += np.bincount(p, minlength=0x110000)
                double += np.bincount(Model.bucket(p[:-1], p[1:]), minlength=BUCKETS)
        for k, v in ((0, single), (1, double)):
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, k, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["k", "i", "n"])

    @classmethod
    def learn(cls, texts: DataFrame) -> Model:
        """From all texts of a one-column table. The driver gets one row a code point and bucket at most."""
        rows = texts.mapInArrow(cls.counts, "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toArrow()
        k, i, n = (rows.column(c).to_numpy() for c in ("k", "i", "n"))
        single, double = np.zeros(0x110000, np.int64), np.zeros(BUCKETS, np.int64)
        single[i[k == 0]] = n[k == 0]
        double[i[k == 1]] = n[k == 1]
        return cls(single, double)


def _spans(text: str, read: str, written: str) -> list[tuple[int, int, str]]:
    """(start, end, letters) of the stretches of `text` whose bytes, as `read`, are letters as `written`."""
    p = page(read)
    out: list[tuple[int, int, str]] = []
    pattern = LETTERS if written == "utf-8" else PAIRS
    i, n = 0, len(text)
    while i < n:
        if ord(text[i]) < 0x80 or ord(text[i]) > 0xFFFF or p[ord(text[i])] is None or text[i] == LOST:
            i += 1
            continue
        j, at, data = i, [], b""
        while j < n and 0x80 <= ord(text[j]) <= 0xFFFF and text[j] != LOST and p[ord(text[j])]:
            at.append(len(data))
            data += p[ord(text[j])]
            j += 1
        starts = {o: k for k, o in enumerate(at)}
        k = 0
        while k < len(at):
            m = pattern.match(data, at[k])
            if not m:
                k += 1
                continue
            try:
                letters = m[0].decode(written)
            except UnicodeDecodeError:
                k += 1
                continue
            stop = m.end()
            tail = stop
            while tail < len(data) and tail not in starts:
                tail += 1
            end = starts.get(tail, len(at))
            out.append((i + k, i + end, letters))
            k = max(end, k + 1)
        i = j
    return out


def decipher(text: str, read: str, written: str, model: Model) -> tuple[float, str, list[tuple[str, str]]]:
    """(gain, deciphered, units): how much likelier the text is after undoing the swap wherever that helps."""
    gain, out, at, units = 0.0, [], 0, []
    p = page(read)
    if 1 < len(text) <= 10:
        once = text
        for _ in range(2):  # several characters that are one letter exactly, perhaps misread twice
            whole = _spans(once, read, written)
            if len(whole) != 1 or whole[0][:2] != (0, len(once)):
                break
            once = whole[0][2]
            if len(once) == 1 and "\u3040" <= once < "\ua000":
                return SURE, once, [(text, once)]
    for a, b, letters in _spans(text, read, written):
        left, right = (out[-1][-1:] if out and out[-1] and a == at else text[a - 1 : a]), text[b : b + 1]
        more = model.text(letters, left, right) - model.text(text[a:b], text[a - 1 : a], right)
        alone = (b - a == 1 or len(letters) == 1 and written == "utf-8" and read not in SINGLE) and not re.match(r"[ -~]", text[a - 1 : a] + text[b : b + 1])
        if LOST in letters and b - a > 1:
            more += 15.0 * letters.count(LOST)  # bytes of U+FFFD itself, misread: no letters of any language
        if more > 1 and not alone:
            gain += more
            out += [text[at:a], letters]
            at = b
            if len(letters) == 1:
                units.append((text[a:b], letters))
    if written == "utf-8":
        # Units that lost bytes: the letters that fit what is left, by the model.
        rest = "".join(out) + text[at:]
        broken = [m.start() for m in re.finditer(LOST, rest) if m.start() and ord(rest[m.start() - 1]) <= 0xFFFF and (d := p[ord(rest[m.start() - 1])]) and BROKEN.fullmatch(d)]
        if broken and (gain > 0 or len(broken) > 1 or len(rest) <= 3):
            gain += 6.0 * len(broken)
            for i in reversed(broken):
                fits = model.by_start.get(p[ord(rest[i - 1])], [])
                left, right = rest[max(0, i - 2) : i - 1], rest[i + 1 : i + 2]
                best = max(fits, key=lambda c: model.text(c, left, right), default=LOST)
                units.append((rest[i - 1 : i + 1], best))
                rest = rest[: i - 1] + best + rest[i + 1 :]
        return gain, rest, units
    return gain, "".join(out) + text[at:], units


def best_reading(text: str, model: Model, swaps: list[int] | None = None) -> tuple[int, float, str, list[tuple[str, str]]]:
    """The swap that explains most, undone again where a text was misread twice."""
    best = (-1, 0.0, text, [])
    for k in range(len(SWAPS)) if swaps is None else swaps:
        gain, restored, units = decipher(text, *SWAPS[k], model)
        if gain > 0 and restored != text:
            again, twice, more = decipher(restored, *SWAPS[k], model)
            if again > 0:
                gain, restored, units = gain + again, twice, units + more
            if gain > max(best[1], 2.0):
                best = (k, gain, restored, units)
    if best[0] < 0 and LOST in text:  # bytes that had no character in the page they were read in, and nothing else is left
        return (HEAVY, SURE, text, [])
    return best


def suspects(texts: list[str]) -> list[list[int]]:
    """The swaps that each text needs to be tried for: those of which a garbled letter may stand in it. One look at all
    code points of a batch; nothing that a swap could explain is passed over."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    p = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    p = np.where(p < 0x10000, p, 0).astype(np.int64)
    lost = np.append(p[1:] == 0xFFFD, False)
    short = np.diff(ends, prepend=0) - 1 <= 4
    marks = []
    for k, (read, written) in enumerate(SWAPS):
        one, two = page_arrays(read)
        a, b = one[p], two[p]
        nxt, nxt2 = np.append(a[1:], 0), np.append(b[1:], 0)
        tail = lambda x: (x >= 0x80) & (x < 0xC0)
        if read in SINGLE and written == "utf-8":
            hit = (a >= 0xC2) & (a < 0xF5) & (tail(nxt) | lost)
        elif read == "latin":
            hit = (a >= 0xA1) & (a < 0xF8) & (nxt >= 0xA1) & (p < 0x100) & (np.append(p[1:], 0) < 0x100)
        else:
            third = np.append(nxt[1:], 0)
            three = (a >= 0xE0) & (a < 0xF0) & tail(b) & ((tail(nxt) & ((nxt2 >= 0xC2) & (nxt2 < 0xF0) | (nxt2 == 0))) | lost)  # two letters, or one and a lost byte
            two_bytes = (a >= 0xC2) & (a < 0xE0) & (tail(b) | (b == 0) & tail(nxt))
            plain = (p > 0x20) & (p < 0x80)
            near = np.append(plain[1:], False) | np.concatenate([[False], plain[:-1]])
            row = two_bytes & np.append(two_bytes[1:], False)
            if read == "cp932":  # half-width kana are single bytes
                three |= (a >= 0xE0) & (a < 0xF0) & tail(b) & (nxt2 == 0) & tail(nxt)
                hit = three | two_bytes & (b == 0) & tail(nxt)
            else:
                hit = three | two_bytes & (near & (b > 0)) | row & np.append(row[1:], False)
        marks.append(np.concatenate([[0], np.cumsum(hit)]))
    start = np.concatenate([[0], ends[:-1]]) if len(texts) else ends
    marks[HEAVY] = marks[HEAVY] + np.concatenate([[0], np.cumsum(p == 0xFFFD)])
    many = np.stack([m[ends] - m[start] for m in marks]) if len(texts) else np.zeros((len(SWAPS), 0), int)
    return [[k for k in range(len(SWAPS)) if many[k, i] or short[i] and not texts[i].isascii()] for i in range(len(texts))]


def readings(values: DataFrame, model: Model) -> DataFrame:
    """(field, row_id, source, text, swap, gain, restored, units) of the values that some swap explains better than
    none. `values` has (field, row_id, source, text); null and empty texts have no reading."""
    shared = values.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("field", pa.string()), ("row_id", pa.int64()), ("source", pa.string()), ("text", pa.string()), ("swap", pa.int32()), ("gain", pa.float64()), ("restored", pa.string()), ("units", pa.list_(pa.struct([("garbled", pa.string()), ("letter", pa.string())])))])

    def work(batch):
        texts, out = batch.column(3).to_pylist(), []
        for i, (s, swaps) in enumerate(zip(texts, suspects(texts))):
            if swaps:
                k, gain, restored, units = best_reading(s, shared.value, swaps)
                if k >= 0:
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), s, k, gain, restored, [{"garbled": g, "letter": x} for g, x in units]))
        return list(zip(*out)) if out else [[]] * 8

    rows = values.select("field", F.col("row_id").cast("long").alias("row_id"), "source", "text").where("text is not null and text <> ''")
    return over_batches(rows, work, schema, "field string, row_id long, source string, text string, swap int, gain double, restored string, units array<struct<garbled:string,letter:string>>")


def learn_use(found: DataFrame, values: DataFrame) -> dict[tuple[str, int], float]:
    """How much each source uses each swap, by expectation-maximization over histograms of the gain: rows of the driver
    are bounded by sources x swaps x RANGE."""
    n_of = {r.source: r.n for r in values.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n")).collect()}
    bins = found.groupBy(F.coalesce("source", F.lit("")).alias("source"), "swap", F.least(F.floor("gain"), F.lit(RANGE)).cast("int").alias("g")).count().collect()
    use = {(r.source, r.swap): PRIOR for r in bins}
    for _ in range(ROUNDS):
        expected: dict[tuple[str, int], float] = {k: 0.0 for k in use}
        for r in bins:
            w = use[r.source, r.swap]
            expected[r.source, r.swap] += r["count"] / (1 + (1 - w) / w * np.exp(-(r.g + 0.5)))
        use = {k: min(0.5, max(PRIOR / 2, e / (n_of.get(k[0], 1) + 1))) for k, e in expected.items()}  # never ruled out
    return use


def garbled(values: DataFrame, model: Model) -> DataFrame:
    """The readings that are likelier than not, given their source's use of the swap; (field, row_id) may repeat if a
    row has several values of one field."""
    found = checkpointed(readings(values, model))
    use = learn_use(found, values)
    spark = values.sparkSession
    odds = spark.createDataFrame([(s, k, float(np.log(w / (1 - w)))) for (s, k), w in use.items()] or [("", -1, 0.0)], "source_ string, swap_ int, odds double")
    join = (F.coalesce("source", F.lit("")) == F.col("source_")) & (F.col("swap") == F.col("swap_"))
    return found.join(odds, join).where("gain + odds > 0").drop("source_", "swap_", "odds")


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = spread(table(spark, sf_dir, "corruptions", ["row_id", "source", "original"]))
    e = spread(table(spark, sf_dir, "confusion_entries", ["entry_id", "source", "char", "confusions"]))
    of = lambda df, field, key, text: df.select(F.lit(field).alias("field"), F.col(key).alias("row_id"), "source", text.alias("text"))
    values = of(c, "original", "row_id", F.col("original")).unionAll(of(e, "char", "entry_id", F.col("char"))).unionAll(of(e, "confusions", "entry_id", F.explode("confusions")))
    return values, c.select(F.col("original").alias("t"))


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected values with the true text as far as it can be had; what is lost for good stays U+FFFD."""
    values, texts = _values(spark, sf_dir)
    return garbled(values, Model.learn(texts)).select("field", "row_id", "source", "text", "restored", F.element_at(F.array(*[F.lit(f"{w} read as {r}") for r, w in SWAPS]), F.col("swap") + 1).alias("swap"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, texts = _values(spark, sf_dir)
    return garbled(values, Model.learn(texts)).select("field", "row_id").distinct()


def p6_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(swap, garbled, letter, n): the substitution table as learned."""
    values, texts = _values(spark, sf_dir)
    return garbled(values, Model.learn(texts)).select("swap", F.explode("units").alias("u")).groupBy("swap", F.col("u.garbled").alias("garbled"), F.col("u.letter").alias("letter")).agg(F.count("*").alias("n"))


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored, "p6_mapping": p6_mapping}
ORACLES: dict[str, str] = {}
