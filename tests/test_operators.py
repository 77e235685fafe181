import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import align, confusion, corrupt, decide, features, labels, stats
from quillmill.plans import config


def test_confusions(spark):
    rows = [(1, "的", ["得", "地"], "shape", None, 0), (2, "的", ["德", "得", None], "pinyin", [0.1, 0.2], 0), (3, None, ["x"], None, None, 0), (4, "一", [], None, None, 0), (5, "二", None, None, None, 0)]
    e = spark.createDataFrame(rows, "entry_id long, char string, confusions array<string>, confusion_type string, weights array<double>, extra int")
    p = confusion.pairs_from_entries(e)
    assert {r.char: r.confusions for r in confusion.lookup(p).collect()} == {"的": ["得", "地", "德"]}
    assert confusion.lookup(p, "shape").first().confusions == ["得", "地"]
    assert confusion.lookup(p, most=1).first().confusions == ["得"]
    assert {(r.type, r.n_pairs, r.n_chars) for r in confusion.stats(p).collect()} == {("shape", 2, 1), ("pinyin", 2, 1), (None, 4, 1)}
    raw = spark.createDataFrame([("一\t壹一\t漪",), ("# c",), ("",)], "value string")
    assert {(r.char, r.confusion) for r in confusion.from_raw_fields(raw).collect()} == {("一", "壹"), ("一", "漪")}


def undo(row):
    text = row.corrupted
    for e in row.edits:  # undone from the left: what is before a place is as in the original
        a = text[: e.position]
        b = text[e.position :]
        if e.type == "S":
            text = a + e.original + b
        elif e.type == "M":
            assert b.startswith(e.original + e.error)
            text = a + e.original + b[len(e.original) + len(e.error) :]
        else:
            assert b.startswith(e.error)
            text = a + e.original + b[len(e.error) :]
    return text


def test_corrupt(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("甲乙丙丁戊己，。 ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "短", "字" * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id int, text string, original int")
    conf = spark.createDataFrame([("甲", ["由", "申"]), ("乙", [])], "char string, confusions array<string>")
    s = corrupt.ErrorSettings(p_corrupt=1.0)
    got = corrupt.corrupt(df, "id", "text", conf, s).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.text is None:
            assert r.corrupted is None and not r.is_corrupted
            continue
        assert undo(r) == r.text and r.num_edits == len(r.edits) <= 4 and r.is_corrupted == bool(r.edits)
        assert all(e.original not in "，。 " for e in r.edits) and (len(r.text) >= 5 or not r.edits)
    assert sum(r.num_edits for r in got) > 300
    again = corrupt.corrupt(df.repartition(5), "id", "text", conf, s).collect()
    assert {r.id: r.corrupted for r in got} == {r.id: r.corrupted for r in again}
    assert {r.id: r.corrupted for r in got} != {r.id: r.corrupted for r in corrupt.corrupt(df, "id", "text", conf, s, epoch=1).collect()}
    with pytest.raises(ValueError):
        corrupt.ErrorSettings(skip=0, multiply=0, replace=0)


def test_exact_split(spark):
    n = {r.split: r["count"] for r in corrupt.exact_split(spark.range(13), "id").groupBy("split").count().collect()}
    assert n == {"train": 10, "dev": 1, "test": 2}


def aligned(spark, pairs, mode="minimal", **kw):
    df = align.align(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, s string, t string"), "s", "t", mode)
    return labels.gold_template(labels.planner_labels(df, "s", **kw), "s").orderBy("id").collect()


GOLDEN = [
    ("今天天汽很好", "今天天气很好", [0, 0, 0, 2, 0, 0], [0] * 6, "今天天[MASK]很好", ["气"], [3]),
    ("这个句子少字了", "这个的句子少字了", [0] * 7, [0, 1, 0, 0, 0, 0, 0], "这个[MASK]句子少字了", ["的"], [2]),
    ("我我去北京", "我去北京", [0, 1, 0, 0, 0], [0] * 5, "我去北京", [], []),
    ("天气好", "今天气好", [0, 0, 0], [1, 0, 0], "天[MASK]气好", ["今"], [1]),
]


def test_alignment_golden(spark):
    got = aligned(spark, [g[:2] for g in GOLDEN])
    for r, (s, t, ops, ins, template, gold, masks) in zip(got, GOLDEN):
        assert (r.op_labels, r.insert_labels, "".join(r.template_tokens), r.gold_tokens, r.mask_positions) == (ops, ins, template, gold, masks)
    assert aligned(spark, [("我我去北京", "我去北京")], "blocks")[0].op_labels == [1, 0, 0, 0, 0]


def ops_rows(spark, source, ops):
    df = spark.createDataFrame([(source, ops)], f"s string, ops {align.OPS}")
    return labels.gold_template(labels.planner_labels(df, "s"), "s").first()


def test_inserts_near_deletions(spark):
    K, D, I = align.KEEP, align.DELETE, align.INSERT
    r = ops_rows(spark, "abc", [(K, 0, 0, "a", "a"), (D, 1, -1, "b", None), (I, -1, 1, None, "x"), (K, 2, 2, "c", "c")])
    assert (r.op_labels, r.insert_labels, "".join(r.template_tokens)) == ([0, 1, 0], [0, 1, 0], "ac")
    r = ops_rows(spark, "ab", [(I, -1, 0, None, "x"), (D, 0, -1, "a", None), (K, 1, 1, "b", "b")])
    assert (r.op_labels, r.insert_labels, "".join(r.template_tokens), r.gold_tokens, r.mask_positions) == ([1, 0], [1, 1], "b[MASK]", ["[UNK]"], [1])


def test_alignment_is_minimal_and_makes_the_target(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("甲乙丙") for _ in range(rng.randint(0, 12))), "".join(rng.choice("甲乙丙") for _ in range(rng.randint(0, 12)))) for _ in range(400)]
    pairs += [("字" * 200, "字" * 100 + "新" + "字" * 99), (None, "x"), ("x", None)]
    df = spark.createDataFrame(pairs, "s string, t string")
    for mode in ("minimal", "blocks"):
        rows = align.align(df, "s", "t", mode)
        got = rows.select("s", "t", align.applied(F.col("ops")).alias("made"), "edit_distance", F.levenshtein("s", "t").alias("least")).collect()
        both = [r for r in got if r.s is not None and r.t is not None]
        assert all(r.made == r.t and (r.edit_distance == r.least if mode == "minimal" else r.edit_distance >= r.least) for r in both)
    rows = align.align(df.where("s is not null and t is not null"), "s", "t")
    ok = labels.planner_labels(rows.where("s <> ''"), "s").select(labels.labels_valid(F.col("s"), F.col("op_labels"), F.col("insert_labels")).alias("ok"))
    assert all(r.ok for r in ok.collect())


DIRECT = [
    ("这个句子少字了", (2, "S", "的", ""), [0] * 7, [0, 1, 0, 0, 0, 0, 0], "这个[MASK]句子少字了", ["的"], [2]),
    ("天气好", (0, "S", "今", ""), [0] * 3, [1, 0, 0], "[MASK]天气好", ["今"], [0]),
    ("我去去去北京", (1, "M", "去", "去去"), [0, 0, 1, 1, 0, 0], [0] * 6, "我去北京", [], []),
    ("今天天汽很好", (3, "R", "气", "汽"), [0, 0, 0, 2, 0, 0], [0] * 6, "今天天[MASK]很好", ["气"], [3]),
    ("今天天气很好", None, [0] * 6, [0] * 6, "今天天气很好", [], []),
]


def test_direct_labels_golden(spark):
    df = spark.createDataFrame([(i, d[0], d[1]) for i, d in enumerate(DIRECT)], "id int, s string, e struct<position:int,type:string,original:string,error:string>")
    for r, d in zip(labels.direct_labels(df, "s", "e").orderBy("id").collect(), DIRECT):
        assert (r.op_labels, r.insert_labels, "".join(r.template_tokens), r.gold_tokens, r.mask_positions) == d[2:]


def test_features(spark):
    vocab = spark.createDataFrame([("[PAD]", 0), ("甲", 104), ("乙", 105), (None, 7)], "token string, token_id int")
    v = features.vocabulary(vocab)
    df = spark.createDataFrame([("甲乙丙", "甲乙", [0, 2, 0], [0, 1, 0], ["甲", "[MASK]", "[MASK]", "丙"], ["乙", "甲"])], "s string, t string, o array<int>, i array<int>, k array<string>, g array<string>")
    t, l = features.sparse_features(F.col("k"), F.col("g"), v, 8)
    ft, fl = features.full_features(F.col("s"), F.col("t"), labels.target_length(F.col("o"), F.col("i")), v, 16)
    r = df.select(features.encoded(F.col("s"), v, 4).alias("cut"), features.encoded(F.lit(""), v, 4).alias("empty"), features.padded_ops(F.col("o"), 6).alias("po"), features.padded_inserts(F.col("i"), 6).alias("pi"), t.alias("st"), l.alias("sl"), ft.alias("ft"), fl.alias("fl")).first()
    assert r.cut == [101, 104, 105, 102] and r.empty == [101, 102, 0, 0]
    assert r.po == [-100, 0, 2, 0, -100, -100] and r.pi == [0, 0, 1, 0, 0, 0]
    assert r.st == [101, 104, 103, 103, 100, 102, 0, 0] and r.sl == [-100, -100, 105, 104, -100, -100, -100, -100]
    assert r.ft == [101, 104, 105, 100, 102, 103, 103, 103, 103, 102] + [0] * 6 and r.fl[5:7] == [104, 105]


def test_records_round_trip(spark, tmp_path):
    from quillmill.sources import writers

    rng = random.Random(6)
    rows = [tuple([rng.randint(-100, 120) for _ in range(8)] for _ in features.VECTORS) for _ in range(20)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} array<int>" for c in features.VECTORS))
    back = features.unpacked(features.packed(df).select("record"), 8).select(*features.VECTORS)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    writers.write_records(df, str(tmp_path / "r"), 8)
    assert sorted(map(tuple, features.unpacked(writers.read_records(spark, str(tmp_path / "r"), 8), 8).select(*features.VECTORS).collect())) == sorted(map(tuple, df.collect()))


def test_decisions(spark):
    df = spark.createDataFrame([([0.2, 0.45, 0.1], [0, 0, 2, 1, 0], [3, 2, 0, 5, 0], [7, 8, 9, 10, 11], [101, 5, 6, 102, 0], [0.9, 0.3, 0.2, 0.1, 0.0])], "p array<double>, o array<int>, i array<int>, x array<int>, y array<int>, c array<double>")
    b = decide.budgeted(F.col("o"), F.col("i"))
    r = df.select(
        decide.op_decision(F.col("p")).alias("op"), decide.insert_decision(F.col("p")).alias("ins"), b.alias("b"), decide.sparse_template(F.col("x"), F.col("o"), b).alias("t"),
        decide.capped_length(F.col("o"), F.col("i")).alias("n"), decide.least_sure(F.col("y"), F.col("c")).alias("low"), decide.filled(F.array(F.lit(103), F.lit(4)), F.array(F.lit(9), F.lit(8))).alias("f"),
    ).first()
    assert r.op == 0 and r.ins == 1 and r.b == [1, 0, 0, 0, 0] and r.t == [101, 7, 103, 8, 103, 11, 102]
    assert r.n == 6 and r.low == [2] and r.f == [9, 4]
    e = decide.extracted_edits(df.withColumn("id", F.lit(1)).withColumn("s", F.lit("甲乙丙丁戊")), "id", "s", "o", "i").collect()
    assert {(x.position, x.type, x.source_char, x["count"]) for x in e} == {(0, "INSERT", "甲", 3), (1, "INSERT", "乙", 2), (2, "REPLACE", "丙", 1), (3, "DELETE", "丁", 1), (3, "INSERT", "丁", 5)}


def test_schedules(spark):
    at = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [at(decide.learning_rate(F.lit(s), 10, 100)) for s in (5, 10, 55)] == [0.5, 1.0, 0.5]
    assert abs(at(decide.learning_rate(F.lit(55), 10, 100, "cosine")) - 0.5) < 1e-9
    assert abs(at(decide.sampling_ratio(F.lit(50), 0, 0.5, 100)) - 0.25) < 1e-9 and abs(at(decide.sampling_ratio(F.lit(50), 0, 0.5, 100, "cosine")) - 0.25) < 1e-9


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "is_corrupted boolean, num_edits int, edits array<struct<position:int,type:string>>")
    r = stats.corruption_stats(empty).first()
    assert (r.total, r.corrupted, r.rate, r.avg_edits) == (0, 0, None, None)
    assert stats.edit_types(empty).count() == 0


def test_settings_round_trip():
    for s in config.PRESETS.values():
        assert config.Settings.from_json(s.to_json()) == s
    assert config.PRESETS["default"].with_(errors={"seed": 7}).errors.seed == 7


def test_shown_and_tagged(spark):
    from quillmill.functions import protect

    r = align.align(spark.createDataFrame([("甲乙丙", "甲丁丙戊")], "s string, t string"), "s", "t").select(align.shown(F.col("ops")).alias("x")).first()
    assert r.x == "甲[乙>丁]丙[+戊]"
    df = spark.createDataFrame([("共100万元，增3.5%", [(1, 6, "amount"), (8, 12, "amount")]), ("甲", [])], "t string, s array<struct<start:int,end:int,type:string>>")
    assert [x.x for x in df.select(protect.tagged(F.col("t"), F.col("s")).alias("x")).collect()] == ["共<amount>100万元</amount>，增<amount>3.5%</amount>", "甲"]


def test_corrector(spark):
    from quillmill.plans import pipeline

    rows = spark.createDataFrame([(1, [7, 8, 9]), (2, [7])], "id int, ids array<int>")
    sure = lambda k, n: F.array(*[F.lit(float(i == k)) for i in range(n)])
    plan = lambda r: r.select("id", F.transform("ids", lambda x: F.when(x == 8, sure(2, 3)).when(x == 9, sure(1, 3)).otherwise(sure(0, 3))).alias("p_op"), F.transform("ids", lambda x: sure(0, 4)).alias("p_insert"))
    fill = lambda r: r.select("id", F.transform("ids", lambda x: F.when(x == 103, 55).otherwise(x)).alias("filled"), F.transform("ids", lambda x: F.when(x.isin(103, 55), 0.1).otherwise(0.9)).alias("confidence"))
    sparse = config.Settings(features=config.FeatureSettings(full_mask=False), decisions=config.DecisionSettings(refine=True))
    whole = {r.id: r for r in pipeline.Corrector(plan, fill).correct(rows).collect()}  # every target position is a mask; nothing is refined
    assert whole[1].prediction == [55, 55] and whole[2].prediction == [55] and [(e.position, e.type) for e in whole[1].edits] == [(1, "REPLACE"), (2, "DELETE")]
    got = {r.id: r for r in pipeline.Corrector(plan, fill, sparse).correct(rows).collect()}
    assert got[1].prediction == [7, 55] and got[1].is_changed and [(e.position, e.type) for e in got[1].edits] == [(1, "REPLACE"), (2, "DELETE")]
    assert got[2].prediction[0] == 55 and not got[2].edits  # refined: its only id is the least sure


def test_edit_distance_of_all_scripts(spark, tmp_path):
    from quillmill.plans import queries as core

    rows = [(1, "今天天气很好", "今天气真好"), (2, "東京へ行く", "東京に行った"), (3, "Привет, мир", "Превет мир"), (4, "ภาษาไทย", "ภาษไทยย"), (5, "हिन्दी भाषा", "हिंदी भाषा"), (6, "café", "cafe\u0301"), (7, "plain", "plane"), (8, "a😀b", "a😁😁b"), (9, "", "é"), (10, None, "é"), (11, "é", None)]
    spark.createDataFrame(rows, "row_id long, source_text string, target_text string").write.parquet(str(tmp_path / "model_inputs.parquet"))

    def distance(a, b):
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    got = {r.row_id: r.distance for r in core.QUERIES["edit_distance_all"](spark, str(tmp_path)).collect()}
    assert got == {k: distance(a, b) for k, a, b in rows if a is not None and b is not None}


def test_typed_errors(spark):
    conf = spark.createDataFrame([("的", ["得", "地"]), ("在", ["再"])], "char string, confusions array<string>")
    rows = [(i, "甲乙丙丁戊己庚辛的壬癸子丑" if i % 3 else "甲乙丙丁戊己庚", k) for i, k in enumerate("SMR" * 20)]
    rows = [(i, t if k == "R" or i % 2 else t + "在", k) for i, t, k in rows] + [(90, "的", "R"), (91, None, "S"), (92, "甲乙丙丁戊己", "R")]
    got = {r.id: r for r in corrupt.corrupt_typed(spark.createDataFrame(rows, "id long, text string, kind string"), "id", "text", "kind", conf).collect()}
    assert len(got) == len(rows)
    for i, t, k in rows:
        r = got[i]
        if t is None or len(t) < 5:
            assert not r.is_corrupted and r.corrupted == t
            continue
        (e,) = r.edits
        assert r.corrupted != t and e.original == t[e.position]
        assert e.type == (k if k != "R" or "的" in t or "在" in t else "M")
        assert e.type != "R" or e.original in "的在"
    n = spark.range(4000).select(corrupt.kinds_in_order(F.col("id")).alias("k")).collect()
    assert all(sorted(r.k) == ["M", "R", "S"] for r in n)
    first = [sum(r.k[0] == k for r in n) / 4000 for k in "SMR"]
    second = sum(r.k[:2] == ["R", "M"] for r in n) / 4000  # 0.5 * 0.3 / (0.2 + 0.3)
    assert all(abs(x - y) < 0.03 for x, y in zip(first, (0.2, 0.3, 0.5))) and abs(second - 0.3) < 0.03


def test_static_samples_have_two_kinds(spark):
    from quillmill.plans import queries as core

    kinds: dict = {}
    for r in core.QUERIES["static_samples"](spark, "/root/testdata/sf0.001").collect():
        kind = "R" if "2" in r.ops.split(",") else "M" if "1" in r.ops.split(",") else "S" if "1" in r.inserts.split(",") else ""
        kinds.setdefault(r.id // 3, []).append((kind, r.text))
    chars = {r.char for r in spark.read.parquet("/root/testdata/sf0.001/confusion_entries.parquet").select("char").collect()}
    assert kinds
    for both in kinds.values():
        assert len(both) == 3
        drawn = sorted(k for k, _ in both if k)
        assert len(drawn) == 2 and (drawn[0] != drawn[1] or drawn[0] == "M" and not chars & {*both[0][1]})
