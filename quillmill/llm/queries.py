"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import leaks, lookalikes, mojibake, overlaps, pieces, quality, segmenter, tokenizing, truncation

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (lookalikes, pieces, segmenter, overlaps, truncation, mojibake, tokenizing, leaks, quality):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
