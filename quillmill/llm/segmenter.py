"""Problem 3: sentence units of texts in many languages and scripts, in SQL expressions only.

Dots that end nothing (decimals, addresses, initials, abbreviations, ordinals) are masked by private-use placeholders
of the same length; one pattern then takes unit after unit, with quotations, brackets and titles taken whole; as masking
kept all lengths, places in the masked text are places in the text, from which the units are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import let
from ..runtime import spread, table
from .lookalikes import lookalike_classes

MASK = ""
B = r"[\p{Z}\s]"  # white space
N = r"[\p{Z}\s\p{Cf}]"  # white space and invisible characters
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"

# Abbreviations after which a sentence goes on, by language.
ABBREVIATIONS = (
    "Dr Mr Mrs Ms Prof Rev Gen Capt Sgt Lt Col Gov Sen Rep Hon St No Nos Fig Figs Sec Secs Ch Vol Eq Art Approx approx ca cf vs viz resp fig sec no vol pp p ed eds dept est "
    "Nr Abs Bd Hr Fr Hrn Str bzw vgl evtl ggf inkl zzgl Kap Tel geb gest "
    "art chap env av apr Mme Mlle MM Me éd fasc "
    "стр рис гл ул им см ред изд табл проф акад кв пр обл р-н"
).split()
# Abbreviations of several parts after which a sentence goes on.
PARTED = [("e", "g"), ("i", "e"), ("z", "B"), ("d", "h"), ("u", "a"), ("o", "ä"), ("s", "o"), ("p", "ex"), ("c", "-à-d"), ("т", "е"), ("т", "к"), ("т", "н")]
# Those that may also close one; their inner dots only are masked.
PARTED_OPEN = [("a", "m"), ("p", "m"), ("т", "д"), ("т", "п"), ("u", "s"), ("U", "S"), ("n", "Chr")]
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
BEFORE_ORDINAL = "[Aa]m|[Vv]om|[Zz]um|[Bb]eim|[Ii]m|[Dd]em|[Dd]en|[Dd]er|[Dd]ie|[Dd]as|[Dd]es|[Bb]is"


WIDE = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF0E]))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
_ALIKE = {m: [x for x in ms if len(x) == 1] for ms in lookalike_classes().values() for m in ms if len(m) == 1}


def _spelled(word: str) -> str:
    """`word` in any look-alike letters, with invisible characters between them."""
    return r"\p{Cf}{0,2}".join("[" + "".join(_ALIKE.get(c, [c])) + "]" if c.isalpha() else rf"\{c}" if c in ".-" else c for c in word)


def _any(words: list[str] | set[str]) -> str:
    return "|".join(_spelled(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


# Pattern -> replacement, in this order. Each replacement has the length of what it replaces.
MASKS = [
    (r"[.．](?<=[\p{Nd}].)(?=[\p{Nd}])", MASK),  # decimals, versions, sections
    (r"[.?!](?<=[A-Za-z0-9/=&_-].)(?=[a-z0-9/&=_])", MASK),  # addresses
    (rf"^({B}*[\p{{Nd}}]{{1,3}})\.(?={B})", rf"$1{MASK}"),  # a running number in front
    # The dot first, what must stand before it after: only dots are looked at.
    (rf"\.(?<=(?<![\p{{L}}\p{{Nd}}])(?:{_any([a for a, _ in PARTED])})\.)(?={N}*(?:{_any([b for _, b in PARTED])})\.)", MASK),
    (rf"\.(?<=(?<!\p{{L}})(?:{'|'.join(rf'{_spelled(a)}{MASK}{N}{{0,3}}{_spelled(b)}' for a, b in PARTED)})\.)", MASK),
    (rf"\.(?<=(?<!\p{{L}})(?:{_any([a for a, _ in PARTED_OPEN])})\.)(?={N}*(?:{_any([b for _, b in PARTED_OPEN])})\.)", MASK),
    (rf"\.(?<=(?<![\p{{L}}'’])\p{{Lu}}\.)(?={N}*\p{{Lu}})", MASK),  # initials
    (rf"\.(?<=(?<!\p{{L}})(?:{_any(ABBREVIATIONS)})\.)", MASK),
    (rf"\.(?<=(?<![\p{{L}}\p{{Nd}}])\p{{Nd}}{{1,2}}\.)(?={N}+(?:{MONTHS}))", MASK),  # ordinals
    (rf"\.(?<=(?<!\p{{L}})(?:{BEFORE_ORDINAL}){N}{{1,3}}\p{{Nd}}{{1,3}}\.)(?={N})", MASK),
]

# Openers behind the last mark that could close them are left open. Placeholders stand for these, so that a quotation is
# always closed and is taken whole, however long, in one pass: an opener, the marks that close it, its placeholder.
OPEN = [("„", "“”", "\ue101"), ("“", "”", "\ue102"), ("「", "」", "\ue103"), ("『", "』", "\ue104"), ("«", "»", "\ue105"), ("‹", "›", "\ue106"), ("｢", "｣", "\ue107")]
PAIRS = [("„", "“\ue102”"), ("“", "”"), ("「", "」"), ("『", "』"), ("«", "»"), ("‹", "›"), ('"', '"'), ("＂", "＂"), ("｢", "｣")]
BRACKETS = [("（", "）"), (r"\(", r"\)"), ("《", "》"), ("〈", "〉"), ("【", "】"), (r"\[", r"\]")]
_quote = "|".join(rf"{a}[^{b}]*+[{b}]" for a, b in PAIRS)
_bracket = "|".join(rf"{a}[^{a}{b}]*+{b}" for a, b in BRACKETS)
_ended_quote = "|".join(rf"{a}(?>[^{b}]*)(?<=[。｡．！？!?….।]{N}{{0,3}})[{b}]" for a, b in PAIRS)
_go_on = rf"(?!{N}*(?:[，,、；;：:—–-]|\p{{Ll}}|[とって]))"
# A quotation that ends with a mark ends its unit if a colon introduced it, or if a new sentence plainly begins behind it.
_quote_end = rf"(?:(?<=[：:]{N}{{0,3}})(?:{_ended_quote}){_go_on}|(?:{_ended_quote})(?={N}+\p{{Lu}}|{N}*[“「『„«\ue101-\ue105]))"
_close = r"(?:\p{Cf}*+[”」』»›）\)\]】》\"'’])*+"
_next = rf"(?={N}*\z|{N}*{B}{N}*(?!\p{{Ll}})[^\s]|{N}*[{CJK}“「『„«\ue101-\ue105])"
_marks = (
    rf"(?:[。｡．！？।॥](?:\p{{Cf}}*+[。｡．！？!?…।॥.])*+|…(?:\p{{Cf}}*+[…。！？!?.])*+(?!{N}*\p{{Ll}})"  # marks of scripts that have no letter case
    rf"|(?<=[{CJK}%％）”」])[.!?]++|[.!?]++[.!?…]*+(?={_close}{_next[3:-1]})"  # marks that a blank and a new sentence follow
    rf"|(?<=\p{{Ll}}{{2}})[.!?](?=\p{{Lu}}\p{{Ll}})){_close}"
)
_blank = rf"(?:(?<=[฀-๿]{N}{{0,2}}){B}++{N}*+(?=[฀-๿])|(?<=[{CJK}%％]){B}++{N}*+(?=[{CJK}\p{{Nd}}]))"
# What may begin a mark, a quotation, a bracket or a parting blank; all else is passed over at once.
_plain = r"[^。｡．！？।॥…!?.„“「『«‹\"＂｢（(《〈【\[\p{Z}\s]++"
UNIT = rf"(?s)(?:{_plain}|(?!{_quote_end}|{_marks}|{_blank})(?:{_quote}|{_bracket}|.))*+(?:{_quote_end}|{_marks}|{_blank}|\z)"


def _left_open(text: Column, opener: str, closers: str, to: str) -> Column:
    """`text` with `to` for the openers behind its last closer."""

    def replaced(t: Column) -> Column:
        behind = t
        for c in closers:
            behind = F.substring_index(behind, c, -1)
        return F.when(F.contains(t, F.lit(opener)), let(behind, lambda x: F.concat(F.left(t, F.length(t) - F.length(x)), F.translate(x, opener, to)))).otherwise(t)

    return let(text, replaced)


def masked(text: Column) -> Column:
    text = F.translate(text, WIDE, NARROW)
    for opener, closers, to in OPEN:
        text = _left_open(text, opener, closers, to)
    for pattern, to in MASKS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return text


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence_id, unit_start, unit_end, unit_text): the units of each text in order, `sentence_id` from 0,
    places in code points, ends exclusive. Null, empty and blank texts have no unit; a text without marks is one.
    `key` must be unique, else the rows' units run into each other. Other columns are not read."""
    u = F.col("u")
    head = F.length(u) - F.length(F.regexp_replace(u, rf"^{B}+", ""))
    rows = (
        df.select(F.col(key).alias("k"), F.col(text).alias("t"))
        .where("t is not null and t <> ''")
        .select("k", F.posexplode(F.regexp_extract_all(masked(F.col("t")), F.lit(UNIT), F.lit(0))).alias("i", "u"))
        .where(F.length(u) > 0)
        .select("k", "i", F.length(u).alias("n"), head.alias("head"), F.length(F.regexp_replace(u, rf"{B}+$", "")).alias("upto"))
    )
    before = F.sum("n").over(Window.partitionBy("k").orderBy("i")) - F.col("n")
    places = rows.select("k", "i", (before + F.col("head")).cast("int").alias("unit_start"), (before + F.col("upto")).cast("int").alias("unit_end")).where("unit_end > unit_start")
    return places.select(F.col("k").alias(key), (F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1).alias("sentence_id"), "unit_start", "unit_end")


def with_text(units: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """The units with their text, restored from the original."""
    return units.join(df.select(key, text), key).withColumn("unit_text", F.expr(f"substring({text}, unit_start + 1, unit_end - unit_start)")).drop(text)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(spread(table(spark, sf_dir, "sentences", ["seg_id", "text"])), "seg_id", "text").select("seg_id", "unit_start", "unit_end")


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "sentences", ["seg_id", "text"]))
    return with_text(sentence_units(rows, "seg_id", "text"), rows, "seg_id", "text")


QUERIES = {"p3_found": p3_found, "p3_units": p3_units}
ORACLES: dict[str, str] = {}
