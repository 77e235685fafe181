"""Problem 1: one form for texts that look the same.

Look-alike classes are the transitive closure (union-find) of pairs of *strings*: code points, the empty string for
invisible characters, and base + combining mark sequences. Every class gets a representative, its most frequent
single code point in the corpus; a multi-pattern automaton then rewrites texts greedily, longest match first.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpointed, over_batches, spread, table

# Letters and signs that fonts draw alike, first the usual one, then its doubles.
ALIKE = """
A ΑА
B ΒВ
C СϹ
E ΕЕ
F Ϝ
G Ԍ
H ΗН
I ΙІӀ
J ЈͿ
K ΚКK
M ΜМ
N Ν
O ΟО
P ΡР
Q Ԛ
S Ѕ
T ΤТ
V Ѵ
W Ԝ
X ΧХ
Y ΥҮ
Z Ζ
a аɑ
c сϲ
d ԁ
e е
h һ
i і
j јϳ
l ӏ
n ո
o оοօ
p рρ
q ԛ
s ѕ
u ս
v ѵ
w ԝ
x хχ
y уү
Г Γ
П Π
Ф Φ
Л Λ
µ μ
Å Å
Ω Ω
- ‐‑‒−
– ‒
, ‚
; ;
: ∶꞉
! ǃ
/ ⁄∕
| ǀ∣
· ・‧∙⋅·
* ∗
へ ヘ
べ ベ
ぺ ペ
。 ｡
"""
# Code points that show nothing and take no room.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF]
# Decompositions whose two sides look alike; the others (super, sub, circle, square, fraction and so on) do not.
SAME_LOOK = {"", "<wide>", "<narrow>", "<noBreak>"}
# Voicing marks, half-width and alone.
VOICING = "ﾞﾟ゛゜"
# Hangul letters that stand alone, and those that combine to syllables; one of the latter alone looks like one of the former.
SINGLE_JAMO, JAMO = range(0x3131, 0x318F), range(0x1100, 0x1200)


class Unions:
    """Union-find over strings, with path halving."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _decomposition(c: str) -> tuple[str, str]:
    """The kind of a code point's decomposition ("" if canonical) and what it decomposes to ("" if it doesn't)."""
    parts = unicodedata.decomposition(c).split()
    kind = parts.pop(0) if parts and parts[0][0] == "<" else ""
    return kind, "".join(chr(int(x, 16)) for x in parts)


@functools.cache
def lookalike_classes() -> dict[str, tuple[str, ...]]:
    """Root -> members, of every class with two members or more. The table is fixed by Unicode, whatever the data."""
    u = Unions()
    for line in ALIKE.split("\n"):
        head, _, rest = line.partition(" ")
        for c in rest:
            u.join(head, c)
    for o in INVISIBLE:
        u.join("", chr(o))
    sequences = []
    for o in range(0x80, 0x30000):
        c = chr(o)
        if 0xAC00 <= o < 0xD7A4 or 0xD800 <= o < 0xE000 or 0x4E00 <= o < 0xA000:  # Hangul syllables are composed by rule; ideographs don't decompose
            continue
        if unicodedata.category(c) == "Zs":
            u.join(" ", c)
            continue
        kind, to = _decomposition(c)
        if not to:
            continue
        radical = 0x2E80 <= o < 0x2FE0 or o == 0x0E33 or o == 0x0EB3
        if kind in SAME_LOOK or radical or o in SINGLE_JAMO:
            if len(to) == 1:
                u.join(c, to)
            elif kind == "" or radical:
                sequences.append((c, unicodedata.normalize("NFD", c) if kind == "" else to))
    for c, to in zip(VOICING, "\u3099\u309a" * 2):
        u.join(c, to)
    # A sequence is alike to every sequence of like letters: its letters are replaced by their roots first.
    for c, to in sequences:
        u.join(c, "".join(u.find(x) for x in to))
        u.join(c, "".join(u.find(x) for x in _decomposition(c)[1]))
    classes = defaultdict(list)
    for x in list(u.up):
        classes[u.find(x)].append(x)
    return {root: tuple(sorted(m, key=lambda x: (len(x) != 1, x))) for root, m in classes.items() if len(m) > 1}


def representatives(counts: Mapping[str, int] | None = None) -> dict[str, str]:
    """Member -> representative: the most frequent single code point of the class, at a tie or without counts the lowest that
    compatibility normalization keeps, and nothing for the invisible."""
    out = {}
    for root, members in lookalike_classes().items():
        # Canonical composition must leave the representative as it is, and a letter that combines would do so anew.
        single = [m for m in members if len(m) == 1]
        single = [m for m in single if unicodedata.normalize("NFC", m) == m and ord(m) not in JAMO] or single
        best = "" if "" in members else min(single, key=lambda m: (-(counts or {}).get(m, 0), unicodedata.normalize("NFKC", m) != m, m)) if single else min(members)
        out |= {m: best for m in members if m and m != best}
    return out


class Rewriter:
    """Greedy rewriting by a multi-pattern automaton, in two sweeps: letters first, then sequences of them."""

    def __init__(self, rep: Mapping[str, str]) -> None:
        # As letters become representatives in the first sweep, the patterns of the second are made of them.
        singles = {m: r for m, r in rep.items() if len(m) == 1}
        pairs: dict[str, str] = {}
        for m, r in rep.items():
            if len(m) > 1:
                pairs["".join(singles.get(x, x) for x in m)] = singles.get(r, r)
        for r in set(rep.values()):  # a representative that is itself a sequence member's target stays
            pairs.pop(r, None)
        self.first, self.second = self._automaton(singles), self._automaton(pairs)
        # ASCII texts stay as they are, unless a double of an ASCII sign is the more frequent one.
        self.keeps_ascii = not any(m.isascii() for m in [*singles, *pairs])

    @staticmethod
    def _automaton(patterns: Mapping[str, str]):
        a = ahocorasick.Automaton()
        for m, r in patterns.items():
            a.add_word(m, (len(m), r))
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def _sweep(a, text: str) -> str:
        out, at = None, 0
        for end, (n, r) in a.iter_long(text):
            if out is None:
                out = []
            out.append(text[at : end + 1 - n])
            out.append(r)
            at = end + 1
        if out is None:
            return text
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.keeps_ascii and text.isascii():
            return text
        # Marks come into canonical order and syllables are composed, before letters change and wherever that makes new ones.
        text = self._sweep(self.first, _composed(text))
        if (new := _composed(text)) != text:
            text = self._sweep(self.first, new)
        while (new := self._sweep(self.second, text)) != text:  # marks on one letter are taken in one after the other
            shorter, text = len(new) < len(text), new
            if not shorter:
                break
        return text


def _composed(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


@functools.cache
def combining_points() -> np.ndarray:
    """Whether a code point may combine with those before it: marks with an order, and vowels and finals of Hangul."""
    out = np.zeros(0x110000, bool)
    out[[o for o in range(0x300, 0x30000) if unicodedata.combining(chr(o))]] = True
    out[0x1161:0x1176] = out[0x11A8:0x11C3] = True
    return out


@functools.cache
def default_rewriter() -> Rewriter:
    """Without counts; the form is as consistent, only its look may be rarer."""
    return Rewriter(representatives())


class PointFolder:
    """The form of many texts at once: the rewriter's first sweep as one table lookup per code point. Texts with marks
    that a sequence may take in go through the automaton."""

    def __init__(self, rewrite: Rewriter | None = None) -> None:
        self.rewrite = rewrite or default_rewriter()
        self.table = np.arange(0x110000, dtype=np.uint32)
        for m, (_, r) in self.rewrite.first.items():
            self.table[ord(m)] = ord(r) if r else 0x110000
        self.marks = combining_points().copy()
        for m in self.rewrite.second.keys():
            self.marks[[ord(c) for c in m if unicodedata.category(c)[0] == "M" or c in VOICING]] = True

    def __call__(self, texts: list[str], drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(points, ends): the forms' code points one after the other, and where each text's end; points for which
        `drop` (by code point) is true are left out. Texts must not be null."""
        def points_of(ts):
            return np.frombuffer("".join(ts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) for t in ts])

        points, ends = points_of(texts)
        folded = self.table[points]
        marked = np.concatenate([[0], np.cumsum(self.marks[points] | self.marks[np.minimum(folded, 0x10FFFF)])])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        again = np.flatnonzero(marked[ends] > marked[starts]) if len(texts) else []
        if len(again):
            texts = list(texts)
            for i in again:
                texts[i] = self.rewrite(texts[i])
            points, ends = points_of(texts)
            folded = self.table[points]
        keep = folded < 0x110000
        if drop is not None:
            keep &= ~drop[np.minimum(folded, 0x10FFFF)]
        return folded[keep], np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int64) if len(texts) else ends


def member_counts(texts: DataFrame, col: str = "text") -> dict[str, int]:
    """How often each member of a class occurs in all of `col`.

    Each task counts its code points in one array and sends the members' counts only; what reaches the driver is
    bounded by the number of members of the fixed classes (some thousands), whatever the data.
    """
    ours = np.array(sorted({ord(m) for ms in lookalike_classes().values() for m in ms if len(m) == 1}), np.int64)

    def count(batches):
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            points = np.frombuffer("".join(s for s in b.column(0).to_pylist() if s).encode("utf-32-le", "surrogatepass"), np.uint32)
            total += np.bincount(points, minlength=total.size)
        hit = ours[total[ours] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["point", "n"])

    rows = texts.select(F.col(col).alias("_t")).mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).collect()
    return {chr(r.point): r.n for r in rows}


def canonical_text(df: DataFrame, col: str, out: str, counts: Mapping[str, int] | None = None) -> DataFrame:
    """`df` with `out`: `col` in the form of problem 1. Null stays null, empty stays empty; other columns, also one
    named like `out` (which is replaced), are kept."""
    rep = representatives(counts)

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = Rewriter(rep)
        for s in batches:
            yield s.map(lambda x: x if x is None else rewrite(x))

    return df.withColumn(out, form(F.col(col)))


FIELDS = (("sentences", "text", "seg_id"), ("corruptions", "original", "row_id"), ("corruptions", "corrupted", "row_id"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, text) of all values in question."""
    c = spread(table(spark, sf_dir, "corruptions", ["row_id", "original", "corrupted"]))
    s = spread(table(spark, sf_dir, "sentences", ["seg_id", "text"]))
    return s.select(F.lit(0).alias("kind"), F.col("seg_id").alias("id"), "text").unionAll(
        c.select(F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("row_id").alias("id"), F.col("original").alias("text")), F.struct(F.lit(2).alias("kind"), F.col("row_id").alias("id"), F.col("corrupted").alias("text")))).alias("x")).select("x.*")
    )


def _forms(values: DataFrame, rep: dict[str, str]) -> DataFrame:
    """(kind, id, raw, h1, h2): a hash of the value and two of its form; texts themselves aren't shuffled."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("raw", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def work(batch, folder):
        texts = batch.column(2).to_pylist()
        points, ends = folder(texts)
        forms, raw, one, two, at = points.astype("<u4").tobytes(), [], [], [], 0
        for s, end in zip(texts, (4 * ends).tolist()):
            raw.append(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63))
            d, at = xxhash.xxh3_128_intdigest(forms[at:end]), end
            one.append((d >> 64) - (1 << 63))
            two.append((d & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
        return [batch.column(0).cast(pa.int32()), batch.column(1).cast(pa.int64()), raw, one, two]

    return over_batches(values.where("text is not null"), work, schema, "kind int, id long, raw long, h1 long, h2 long", lambda: PointFolder(Rewriter(rep)))


def equal_looking_pairs(values: DataFrame, rep: dict[str, str]) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b, of rows of one kind whose texts differ but have one form.

    Null texts are no case; empty texts equal each other exactly or texts of invisible characters only. Work follows
    the result: spellings, not rows, are compared, and a form with one spelling, however many copies it has, is
    dropped by a map-side aggregation before any join.
    """
    rows = checkpointed(_forms(values, rep))
    key = ["kind", "h1", "h2"]
    several = rows.groupBy(*key).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*key)
    spelled = checkpointed(rows.join(several, key))  # only rows of forms with several spellings
    spell = spelled.select(*key, "raw").distinct()
    twins = spell.join(spell.withColumnRenamed("raw", "raw_b"), key).where("raw <> raw_b")
    left = spelled.withColumnRenamed("id", "id_a").join(twins, [*key, "raw"])
    right = spelled.select(*key, F.col("raw").alias("raw_b"), F.col("id").alias("id_b"))
    return left.join(right, [*key, "raw_b"]).where("id_a < id_b").select("kind", "id_a", "id_b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    rep = representatives(member_counts(values))
    kind = F.col("kind")
    return equal_looking_pairs(values, rep).select(
        F.when(kind == 0, "sentences").otherwise("corruptions").alias("tab"),
        F.when(kind == 0, "text").when(kind == 1, "original").otherwise("corrupted").alias("field"),
        "id_a",
        "id_b",
    )


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that occur in the data, with each member's count and the representative chosen."""
    counts = member_counts(_values(spark, sf_dir))
    rep = representatives(counts)
    rows = [(m, counts[m], rep.get(m, m)) for ms in lookalike_classes().values() for m in ms if counts.get(m)]
    return spark.createDataFrame(rows, "member string, n long, representative string")


def form_sql(text: str) -> str:
    """The form in SQL: code points by translate(), sequences by canonical composition, and once more what that made."""
    rep = {m: r for m, r in representatives().items() if len(m) == 1}
    pairs = sorted(rep.items(), key=lambda x: (x[1] == "", x))  # those without a counterpart come last and vanish
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    old, new = quoted("".join(m for m, _ in pairs)), quoted("".join(r for _, r in pairs))
    sequences = [(m, r) for m, r in representatives().items() if len(m) > 1 and unicodedata.normalize("NFC", m) == m and unicodedata.normalize("NFC", r) == r and unicodedata.normalize("NFD", r) != m]
    for m, r in sequences:
        if m in ("\u0e4d\u0e32", "\u0ecd\u0eb2"):
            text = f"replace({text}, {quoted(m)}, {quoted(r)})"
    return f"translate(nfc_normalize(translate({text}, {old}, {new})), {old}, {new})"


ORACLES = {
    "p1_found": f"""
WITH v AS (SELECT 'sentences' AS tab, 'text' AS field, seg_id AS id, text FROM sentences UNION ALL
           SELECT 'corruptions', 'original', row_id, original FROM corruptions UNION ALL SELECT 'corruptions', 'corrupted', row_id, corrupted FROM corruptions),
f AS (SELECT tab, field, id, text, {form_sql('text')} AS form FROM v WHERE text IS NOT NULL)
SELECT a.tab, a.field, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.tab = b.tab AND a.field = b.field AND a.form = b.form AND a.text <> b.text AND a.id < b.id"""
}
QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
