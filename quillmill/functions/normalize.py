"""Text normalisation: compatibility forms, invisible characters, width and white space, in this order."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Full-width forms with a half-width one: U+3000, and U+FF01 on for digits, letters and these marks.
WIDE = "　" + "".join(chr(o) for o in range(0xFF01, 0xFF5B) if chr(o) not in "［＼］＾＿｀")
# Marks that stay as they are.
KEPT = "。，、；：？！\"'【】《》（）—…"
# White space in the sense of str.strip.
BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
INVISIBLE = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\p{Cf}\p{Co}]"


def width_table(keep: bool = True) -> tuple[str, str]:
    wide = "".join(c for c in WIDE if not keep or c not in KEPT)
    return wide, "".join(" " if c == "　" else chr(ord(c) - 0xFEE0) for c in wide)


# What NFKC or the removal of category C may change: all but ASCII letters and marks, ideographs, kana and Cyrillic as they are.
MAY_CHANGE = r"[^\t\n\r\x20-\x7e\u00b7\u00df-\u00ff\u0410-\u044f\u2013\u2014\u2018-\u201d\u3001-\u3002\u3008-\u3011\u3041-\u3096\u30a1-\u30fc\u4e00-\u9fff]"


def compatibility_form(text: Column) -> Column:
    """NFKC, and without characters of category C other than blank, tab and line ends. No built-in has either; Python sees
    only the texts that have a character which may change."""
    some = F.when(text.rlike(MAY_CHANGE), text)
    return F.when(text.rlike(MAY_CHANGE), _compatibility_form(some)).otherwise(text)


@F.pandas_udf(StringType())
def _compatibility_form(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFKC", x) if c in " \t\n\r" or unicodedata.category(c)[0] != "C"))


def half_width(text: Column, keep: bool = True) -> Column:
    return F.translate(text, *width_table(keep))


def without_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t]+", " ")


def tidy_lines(text: Column) -> Column:
    """Runs of blanks and tabs become one blank, line ends become LF, each line is stripped."""
    lines = F.split(F.regexp_replace(collapse_blanks(text), "\r\n?", "\n"), "\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, rf"\A{BLANK}+|{BLANK}+\z", "")), "\n")


def normalize(text: Column, unicode: bool = True, width: bool = True, blanks: bool = True, keep: bool = True) -> Column:
    """The whole pipeline. The compatibility form comes first, so that with it the kept marks are those without one."""
    if unicode:
        text = compatibility_form(text)
    if width:
        text = half_width(text, keep)
    return tidy_lines(text) if blanks else text


def normalize_pair(source: Column, target: Column, **options: bool) -> tuple[Column, Column]:
    return normalize(source, **options), normalize(target, **options)
