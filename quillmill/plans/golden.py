"""Queries over fixed rows whose results were worked out by hand: rules that no SQL of the test tables expresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize, protect, segment
from ..operators import align, confusion, corrupt, decide, labels, stats
from . import config

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"


def golden(columns: str, rows: list[tuple]):
    """Registers a query with the rows that it must give."""

    def register(f):
        QUERIES[f.__name__] = f
        values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {values}) t({columns})"
        return f

    return register


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_PAIRS = [("今天天汽很好", "今天天气很好"), ("这个句子少字了", "这个的句子少字了"), ("我我去北京", "我去北京"), ("天气好", "今天气好"), ("甲", "甲")]


def _pairs(spark):
    return spark.createDataFrame(_PAIRS, "source string, target string")


@golden("source, ops, inserts, template, gold, masks, n", [
    ("今天天汽很好", "0,0,0,2,0,0", "0,0,0,0,0,0", "今天天[MASK]很好", "气", "3", 6),
    ("这个句子少字了", "0,0,0,0,0,0,0", "0,1,0,0,0,0,0", "这个[MASK]句子少字了", "的", "2", 8),
    ("我我去北京", "0,1,0,0,0", "0,0,0,0,0", "我去北京", "", "", 4),
    ("天气好", "0,0,0", "1,0,0", "天[MASK]气好", "今", "1", 4),
    ("甲", "0", "0", "甲", "", "", 1),
])
def golden_labels(spark, d):
    """Pairs to ops, labels, templates and target lengths."""
    rows = labels.processed(_pairs(spark), "source", "target", "source")
    return rows.select("source", _joined("op_labels").alias("ops"), _joined("insert_labels").alias("inserts"), F.array_join("template_tokens", "").alias("template"), F.array_join("gold_tokens", "").alias("gold"), _joined("mask_positions").alias("masks"), labels.target_length(F.col("op_labels"), F.col("insert_labels")).cast("long").alias("n"))


@golden("source, ops, sample_id", [("今天天汽很好", "0,0,0,2,0,0", "sample_今天天汽很好"), ("这个句子少字了", "0,0,0,0,0,0,0", "sample_这个句子少字了"), ("我我去北京", "1,0,0,0,0", "sample_我我去北京"), ("天气好", "0,0,0", "sample_天气好"), ("甲", "0", "sample_甲")])
def golden_block_labels(spark, d):
    """The same by matching blocks, with ids from the key."""
    return labels.processed(_pairs(spark), "source", "target", "source", "blocks").select("source", _joined("op_labels").alias("ops"), "sample_id")


@golden("source, script, n_keep, n_delete, n_replace, n_insert, ok", [
    ("今天天汽很好", "今天天[汽>气]很好", 5, 0, 1, 0, True), ("这个句子少字了", "这个[+的]句子少字了", 7, 0, 0, 1, True), ("我我去北京", "我[-我]去北京", 4, 1, 0, 0, True), ("天气好", "[+今]天气好", 3, 0, 0, 1, True), ("甲", "甲", 1, 0, 0, 0, True),
])
def golden_scripts(spark, d):
    """Edit scripts, what they count and whether they make the target."""
    rows = align.align(_pairs(spark), "source", "target")
    rows = rows.select("*", *align.op_counts(F.col("ops")))
    return rows.select("source", align.shown(F.col("ops")).alias("script"), *[F.col(c).cast("long").alias(c) for c in ("n_keep", "n_delete", "n_replace", "n_insert")], (align.applied(F.col("ops")) == F.col("target")).alias("ok"))


@golden("case_no, ops, inserts, template, gold", [(1, "0,1,0", "0,1,0", "ac", ""), (2, "1,0", "1,1", "b[MASK]", "[UNK]")])
def golden_deleted_neighbours(spark, d):
    """Insertions after a deleted character, and in front of a deleted first one."""
    op = lambda k, s, t, a, b: (k, s, t, a, b)
    rows = spark.createDataFrame(
        [(1, "abc", [op(0, 0, 0, "a", "a"), op(1, 1, -1, "b", None), op(3, -1, 1, None, "x"), op(0, 2, 2, "c", "c")]), (2, "ab", [op(3, -1, 0, None, "x"), op(1, 0, -1, "a", None), op(0, 1, 1, "b", "b")])], f"case_no long, source string, ops {align.OPS}"
    )
    done = labels.gold_template(labels.planner_labels(rows, "source"), "source")
    return done.select("case_no", _joined("op_labels").alias("ops"), _joined("insert_labels").alias("inserts"), F.array_join("template_tokens", "").alias("template"), F.array_join("gold_tokens", "").alias("gold"))


_E = "position int, type string, original string, error string"


@golden("corrupted, ops, inserts, template, gold, masks", [
    ("这个句子少字了", "0,0,0,0,0,0,0", "0,1,0,0,0,0,0", "这个[MASK]句子少字了", "的", "2"), ("天气好", "0,0,0", "1,0,0", "[MASK]天气好", "今", "0"),
    ("我去去去北京", "0,0,1,1,0,0", "0,0,0,0,0,0", "我去北京", "", ""), ("今天天汽很好", "0,0,0,2,0,0", "0,0,0,0,0,0", "今天天[MASK]很好", "气", "3"), ("今天天气很好", "0,0,0,0,0,0", "0,0,0,0,0,0", "今天天气很好", "", ""),
])
def golden_direct_labels(spark, d):
    """Labels straight from the edit."""
    rows = spark.createDataFrame([("这个句子少字了", (2, "S", "的", "")), ("天气好", (0, "S", "今", "")), ("我去去去北京", (1, "M", "去", "去去")), ("今天天汽很好", (3, "R", "气", "汽")), ("今天天气很好", None)], f"corrupted string, e struct<{_E.replace(' int', ':int').replace(' string', ':string')}>")
    out = labels.direct_labels(rows, "corrupted", "e")
    return out.select("corrupted", _joined("op_labels").alias("ops"), _joined("insert_labels").alias("inserts"), F.array_join("template_tokens", "").alias("template"), F.array_join("gold_tokens", "").alias("gold"), _joined("mask_positions").alias("masks"))


@golden("no, text, target", [(1, "A1,。...", "ab"), (2, "x y\nz", "x"), (3, "", ""), (4, "ab", "A")])
def golden_normalization(spark, d):
    """Both texts of pairs through the whole pipeline."""
    rows = spark.createDataFrame([(1, "Ａ１，。…", "a​b"), (2, " x \t y \r\n z ", "x"), (3, "", ""), (4, "a​b", "Ａ")], "no long, s string, t string")
    s, t = normalize.normalize_pair(F.col("s"), F.col("t"))
    return rows.select("no", s.alias("text"), t.alias("target"))


_TEXTS = ["今天天气很好。好。我们去公园玩吧！", "好。今天天气很好。", "他说\"走。快走。\"然后离开了。", "今天天气很好\n好"]


@golden("text, sentence_id, start, stop, sentence", [(_TEXTS[0], 0, 0, 9, "今天天气很好。好。"), (_TEXTS[0], 1, 9, 17, "我们去公园玩吧！"), (_TEXTS[1], 0, 2, 9, "今天天气很好。"), (_TEXTS[2], 0, 0, 15, _TEXTS[2]), (_TEXTS[3], 0, 0, 7, "今天天气很好好")])
def golden_sentences(spark, d):
    """Splitting by marks and joining of short pieces."""
    rows = segment.processed_sentences(spark.createDataFrame([(t,) for t in _TEXTS], "text string").withColumn("whole", F.col("text")), "whole", "text")
    return rows.select(F.col("whole").alias("text"), F.col("sentence_id").cast("long").alias("sentence_id"), F.col("original_start").cast("long").alias("start"), F.col("original_end").cast("long").alias("stop"), F.col("text").alias("sentence"))


@golden("piece_no, text", [(0, "甲" * 6 + "，"), (1, "乙" * 10), (2, "乙" * 2)])
def golden_cut_long(spark, d):
    """A sentence over a limit of ten: after a weak mark of the second half, then hard."""
    rows = spark.createDataFrame([("a", "甲" * 6 + "，" + "乙" * 12, 0, 19)], "k string, text string, start int, end int")
    return segment.split_long(rows, 10).select(F.col("part_no").cast("long").alias("piece_no"), "text")


@golden("text, start, stop, type, confidence", [
    ("国发〔2024〕1号", 0, 10, "doc_number", 1.0), ("2024年12月13日", 0, 11, "date", 1.0), ("共100万元，增3.5%", 1, 6, "amount", 1.0), ("共100万元，增3.5%", 8, 12, "amount", 1.0),
    ("现将方案印发如下", 0, 8, "fixed_phrase", 1.0), ("见《劳动法》", 1, 6, "law_name", 1.0), ("请按财政部", 0, 5, "organization", 0.8), ("第三条", 0, 3, "clause", 1.0),
])
def golden_spans(spark, d):
    """Each family's spans, merged."""
    rows = spark.createDataFrame([(t,) for t in ("国发〔2024〕1号", "2024年12月13日", "共100万元，增3.5%", "现将方案印发如下", "见《劳动法》", "请按财政部", "第三条")], "text string")
    spans = protect.merge_spans(protect.detect(rows.withColumn("t", F.col("text")), "t", "text", "default"), "t")
    return spans.select(F.col("t").alias("text"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "type", "confidence")


@golden("text, start, stop", [("aaa", 0, 3), ("abcd", 0, 2), ("abcd", 2, 4)])
def golden_own_words(spark, d):
    """Overlapping hits are one span, touching ones two."""
    rows = spark.createDataFrame([("aaa",), ("abcd",)], "text string").withColumn("t", F.col("text"))
    spans = protect.merge_spans(protect.detect(rows, "t", "text", [], words=["aa", "ab", "cd"]), "t")
    return spans.select(F.col("t").alias("text"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@golden("char, confusions, shapes, sounds", [("的", "得,地,德", "得,地", "德"), ("末", "未", "未", None)])
def golden_confusion_set(spark, d):
    """A set of a shape and a sound table with one own pair; of a repeated head the last row holds."""
    shape = confusion.from_table(spark.createDataFrame([(0, "的", ["得", "地"]), (1, "末", ["木"]), (2, "末", ["未"])], "i long, char string, confusions array<string>"), "shape", "i")
    sound = confusion.from_table(spark.createDataFrame([(0, "的", ["地"])], "i long, char string, confusions array<string>"), "pinyin", "i")
    whole = confusion.added(confusion.confusion_set(shape, sound), spark.createDataFrame([("的", "德")], "char string, confusion string"))
    of = lambda t, n: (confusion.lookup(whole, type=t) if t else confusion.lookup(whole)).select("char", F.array_join("confusions", ",").alias(n))
    return of(None, "confusions").join(of("shape", "shapes"), "char", "left").join(of("custom", "sounds"), "char", "left")


@golden("name, p_corrupt, rate, skip, multiply, replace, most_edits", [
    ("default", 0.7, 1.5, 0.2, 0.3, 0.5, 4), ("balanced", 0.7, 1.5, 0.333, 0.333, 0.333, 4), ("insert_focused", 0.7, 1.5, 0.35, 0.35, 0.3, 4), ("conservative", 0.5, 1.0, 0.2, 0.3, 0.5, 2), ("aggressive", 0.8, 2.0, 0.2, 0.3, 0.5, 4),
])
def golden_error_presets(spark, d):
    rows = [(k, s.p_corrupt, s.rate, *[round(x, 3) for x in s.shares], s.most_edits) for k, s in corrupt.PRESETS.items()]
    return spark.createDataFrame(rows, "name string, p_corrupt double, rate double, skip double, multiply double, replace double, most_edits long")


@golden("name, inserts, deletes, auxiliary, refines, verifies, prompt, same", [
    ("default", True, True, True, False, False, True, True), ("no_gap", False, False, True, False, False, True, True), ("no_insert", False, True, True, False, False, True, True), ("no_delete", True, False, True, False, False, True, True),
    ("no_aux_mlm", True, True, False, False, False, True, True), ("with_refinement", True, True, True, True, False, True, True), ("with_verifier", True, True, True, False, True, True, True), ("no_f2", True, True, True, False, False, True, True),
    ("no_ptuning", True, True, True, False, False, False, True), ("ptuning_no_lstm", True, True, True, False, False, True, True), ("ptuning_shared", True, True, True, False, False, True, True),
])
def golden_presets(spark, d):
    """The named settings, and whether JSON keeps them."""
    names = ("default", "no_gap", "no_insert", "no_delete", "no_aux_mlm", "with_refinement", "with_verifier", "no_f2", "no_ptuning", "ptuning_no_lstm", "ptuning_shared")
    rows = [(n, s.labels.enable_insert, s.labels.enable_delete, s.features.auxiliary, s.decisions.refine, s.decisions.verify, s.prompt.prompt, config.Settings.from_json(s.to_json()) == s) for n in names for s in [config.preset(n)]]
    return spark.createDataFrame(rows, "name string, inserts boolean, deletes boolean, auxiliary boolean, refines boolean, verifies boolean, prompt boolean, same boolean")


@golden("ops, places, template, mask", [("0,2,1,0", "1,2,-1,4", "101,7,103,103,8,102", "1,1,1,1,1,1"), ("0,1", "1,-1", "101,7,102,0,0,0", "1,1,1,0,0,0")])
def golden_templates(spark, d):
    """Sparse templates, where source ids stand in them, and filling up to the batch's longest."""
    rows = spark.createDataFrame([("b", [7, 9, 5, 8], [0, 2, 1, 0], [0, 1, 0, 0]), ("b", [7, 5], [0, 1], [0, 0])], "batch string, ids array<int>, ops array<int>, inserts array<int>")
    out = rows.withColumn("template", decide.sparse_template(F.col("ids"), F.col("ops"), F.col("inserts"))).withColumn("places", decide.source_to_template(F.col("ops"), F.col("inserts")))
    return decide.padded_batches(out, "batch", "template").select(_joined("ops").alias("ops"), _joined("places").alias("places"), _joined("template").alias("template"), _joined("mask").alias("mask"))


@golden("op_weights, insert_weights, error", [("1.0,3.0,2.0", "1.0,5.0,5.0,5.0", 0.6)])
def golden_class_weights(spark, d):
    """Weights by label, and the weighted share of wrong labels where one of keep, replace and replace is wrong; ignored ones don't count."""
    ops, inserts = decide.class_weights()
    rows = spark.createDataFrame([([0, 1, 2, 0], [0, 2, 2, -100])], "p array<int>, t array<int>")
    return rows.select(_joined(ops).alias("op_weights"), _joined(inserts).alias("insert_weights"), F.round(1 - decide.weighted_error(F.col("p"), F.col("t"), ops), 6).alias("error"))


@golden("epoch, total, planner, infill", [(1, 2.0, 1.0, 0.0), (2, 3.0, 1.5, 0.5)])
def golden_mean_losses(spark, d):
    rows = spark.createDataFrame([(1, 1.0, 1.0, None), (1, 3.0, 1.0, None), (2, 3.0, 1.5, 0.5)], "epoch long, total double, planner double, infill double")
    return stats.mean_losses(rows, ["epoch"], ["total", "planner", "infill"])


@golden("kept", [("a,c",)])
def golden_accepted_edits(spark, d):
    rows = spark.createDataFrame([(["a", "b", "c"], [0.6, 0.5, 0.9])], "e array<string>, p array<double>")
    return rows.select(F.array_join(decide.accepted_edits(F.col("e"), F.col("p")), ",").alias("kept"))
