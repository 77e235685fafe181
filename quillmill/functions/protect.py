"""Spans of a text that must not be changed: detection, merging and the positions left to edit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import let

D = r"\p{Nd}"
HAN = "[一-龥]"
# The families' patterns.
PATTERNS = {
    "doc_number": [
        rf"{HAN}+[发办函议通批指令][\[〔\(（]{D}{{4}}[\]〕\)）]第?[{D}一二三四五六七八九十百]+号",
        rf"{HAN}+字[\[〔\(（]{D}{{4}}[\]〕\)）]第?[{D}一二三四五六七八九十百]+号",
    ],
    "date": [rf"{D}{{4}}年{D}{{1,2}}月{D}{{1,2}}日", rf"{D}{{4}}年{D}{{1,2}}月", rf"{D}{{4}}[/\-\.]{D}{{1,2}}[/\-\.]{D}{{1,2}}", rf"{D}{{1,2}}月{D}{{1,2}}日"],
    "amount": [rf"[{D},]+\.?{D}*[万亿]?元", rf"[￥¥][{D},]+\.?{D}*", rf"{D}+\.?{D}*%", rf"{D}+\.?{D}*[万亿千百十]"],
    "clause": [rf"第[一二三四五六七八九十百千{D}]+[条款项章节]", rf"第[（\(][一二三四五六七八九十百千{D}]+[）\)][条款项章节]", rf"[（\(][一二三四五六七八九十{D}]+[）\)]", rf"^{D}+[\.、]"],
    "law_name": [r"《[一-龥\p{Z}\s]+(?:法|条例|规定|办法|细则|准则|规范|标准|意见|通知|决定)》", r"[一-龥]{2,}(?:法|条例|规定|办法)(?![》一-龥])"],
    "fixed_phrase": ["根据[一-龥《》]+[，,]", "依据[一-龥《》]+[，,]", "按照[一-龥《》]+[，,]", "现将[一-龥]+(?:通知|印发|转发|公布)如下", "特此(?:通知|公告|说明|函复)", "此复[。]?"],
}
# Endings of names of bodies.
BODIES = "部 委 局 厅 处 科 室 中心 委员会 办公室 研究院 研究所 大学 学院 公司 集团 银行 协会 学会 基金会 人民政府 国务院 全国人大 全国政协".split()
ORGANIZATION = rf"{HAN}{{2,}}(?:{'|'.join(BODIES)})"
PRESETS = {"default": [*PATTERNS, "organization"], "document": [*PATTERNS, "organization"], "minimal": ["date", "amount"]}
# Marks that are never edited.
PUNCTUATION = "。，、；：？！\"【】《》（）—…·「」『』〈〉〔〕"
FIXED = rf"[{re.escape(PUNCTUATION)}\p{{Z}}\s\x00\x1c-\x1f]"


def find_all(text: Column, pattern: str, kind: str, confidence: float = 1.0) -> Column:
    """All matches in order as (start, end, text, type, confidence), by lengths of what stands between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    upto = lambda a, i: F.aggregate(F.slice(a, 1, i), F.lit(0), lambda s, x: s + F.length(x))

    def spans(z: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = upto(z["between"], i + 1) + upto(z["found"], i)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))

        return F.transform(z["found"], span)

    return let(F.struct(found.alias("found"), between.alias("between")), spans)


def find_word(text: Column, word: str) -> Column:
    """All occurrences of a word, overlapping ones too."""
    n = len(word)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(n)) == word)
    return F.transform(at, lambda i: F.struct(i.cast("int").alias("start"), (i + n).cast("int").alias("end"), F.lit(word).alias("text"), F.lit("custom").alias("type"), F.lit(1.0).alias("confidence")))


def detect(df: DataFrame, key: str, text: str, families: list[str] | str = "default", words: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """(key, start, end, text, type, confidence): raw spans of all families, own words and own patterns; one that doesn't
    compile is an error here, before any row is read. Null texts have no span."""
    for p in patterns:
        re.compile(p)
    t = F.col(text)
    arrays = []
    for f in PRESETS[families] if isinstance(families, str) else families:
        arrays += [F.filter(find_all(t, ORGANIZATION, f, 0.8), lambda s: F.length(s["text"]) >= 3)] if f == "organization" else [find_all(t, p, f) for p in PATTERNS[f]]
    arrays += [find_word(t, w) for w in words if w] + [find_all(t, p, "custom") for p in patterns]
    return df.where(t.isNotNull()).select(key, F.explode(F.flatten(F.array(*arrays))).alias("s")).select(key, "s.*")


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, type, confidence): overlapping spans as one, touching ones apart. Type is the first's, the
    confidence is raised only by spans that reach further."""
    w = Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("confidence"), "type")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("reach", reach).withColumn("new", (F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int"))
    rows = rows.withColumn("grp", F.sum("new").over(w)).withColumn("no", F.row_number().over(w))
    return rows.groupBy(key, "grp").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("type", "no").alias("type"), F.max(F.when((F.col("new") == 1) | (F.col("end") > F.col("reach")), F.col("confidence"))).alias("confidence")
    ).drop("grp")


def editable_positions(text: Column, spans: Column | None = None) -> Column:
    """0-based positions that are no punctuation, no white space and in no span (an array of structs start, end)."""
    # One pass replaces what isn't free by a sign that no character to edit is; then places are told by comparing.
    signs = F.split(F.regexp_replace(text, FIXED, "\x00"), "")
    free = (lambda c, i: c != "\x00") if spans is None else lambda c, i: (c != "\x00") & ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"]))
    at = F.filter(F.transform(signs, lambda c, i: F.when(free(c, i), i)), lambda i: i.isNotNull())
    return F.when(F.length(text) > 0, at).otherwise(F.array().cast("array<int>"))


def tagged(text: Column, spans: Column) -> Column:
    """The text with `<type>…</type>` around each of its merged spans (structs start, end, type, in order)."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(spans, i)["end"])
    piece = lambda s, i: F.concat(
        F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit("<"), s["type"], F.lit(">"), F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("</"), s["type"], F.lit(">")
    )
    rest = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(0)
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, rest + 1, F.length(text)))
