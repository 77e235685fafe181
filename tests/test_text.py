import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import draws, normalize, protect, segment


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")
    return [r.out for r in df.select("id", expr.alias("out")).orderBy("id").collect()]


def test_normalize_golden(spark):
    got = one(spark, normalize.normalize(F.col("text")), "Ａ１，。…", "a​b", " x \t y \r\n z ", "", None)
    assert got == ["A1,。...", "ab", "x y\nz", "", None]


def test_strip_matches_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\r\x1c\x85\xa0　​中") for _ in range(12)) for _ in range(300)]
    want = ["\n".join(x.strip() for x in re.sub("\r\n?", "\n", re.sub("[ \t]+", " ", t)).split("\n")) for t in texts]
    assert one(spark, normalize.tidy_lines(F.col("text")), *texts) == want


def merged(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    out = segment.processed_sentences(df, "id", "text")
    return [(r.sentence_id, r.original_start, r.original_end, r.text) for r in out.orderBy("original_start").collect()]


def test_sentences_golden(spark):
    assert merged(spark, "今天天气很好。好。我们去公园玩吧！") == [(0, 0, 9, "今天天气很好。好。"), (1, 9, 17, "我们去公园玩吧！")]
    assert merged(spark, "好。今天天气很好。") == [(0, 2, 9, "今天天气很好。")]
    assert merged(spark, '他说"走。快走。"然后离开了。') == [(0, 0, 15, '他说"走。快走。"然后离开了。')]
    assert merged(spark, "今天天气很好\n好") == [(0, 0, 7, "今天天气很好好")]
    assert merged(spark, None) == [] == merged(spark, "")


def state_machine(text):
    out, cur, quoted = [], "", False
    for c in text:
        cur += c
        if quoted:
            quoted = c not in '"」』'
        elif c in '"「『':
            quoted = True
        elif c in "。！？；":
            out.append(cur)
            cur = ""
    return out + [cur] if cur else out


def test_sentences_match_a_state_machine(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice('ab。！"「」』；好') for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["字" * 50000 + "。" + "「" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in segment.split_sentences(df, "id", "text").orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r.text)
        assert texts[r.id][r.start : r.end] == r.text
    assert all(got.get(i, []) == state_machine(t) for i, t in enumerate(texts))


@settings(max_examples=200, deadline=None)
@given(st.text("ab，、", max_size=60))
def test_cut_long_keeps_text_and_limit(text):
    parts = segment.cut_long(text, 10)
    assert "".join(parts) == text and all(0 < len(p) <= 10 for p in parts)


def test_parallel(spark):
    df = spark.createDataFrame([(1, "甲甲甲。乙乙乙。", "甲甲。乙乙乙。"), (2, "甲甲。乙乙。", "甲甲乙乙。"), (3, None, "x")], "id int, s string, t string")
    got = [(r.id, r.pair_no, r.source, r.target) for r in segment.split_parallel(df, "id", "s", "t").orderBy("id", "pair_no").collect()]
    assert got == [(1, 0, "甲甲甲。", "甲甲。"), (1, 1, "乙乙乙。", "乙乙乙。"), (2, 0, "甲甲。乙乙。", "甲甲乙乙。")]


def spans(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    m = protect.merge_spans(protect.detect(df, "id", "text", **kw), "id").orderBy("start").collect()
    rows = df.withColumn("s", F.array(*[F.struct(F.lit(r.start).alias("start"), F.lit(r.end).alias("end")) for r in m]) if m else F.array().cast("array<struct<start:int,end:int>>"))
    return [(r.start, r.end, r.type) for r in m], rows.select(protect.editable_positions(F.col("text"), F.col("s")).alias("e")).first().e


def test_spans_golden(spark):
    assert spans(spark, "国发〔2024〕1号") == ([(0, 10, "doc_number")], [])
    assert spans(spark, "2024年12月13日")[0] == [(0, 11, "date")]
    assert spans(spark, "共100万元，增3.5%") == ([(1, 6, "amount"), (8, 12, "amount")], [0, 7])
    assert spans(spark, "aaa", families=[], words=["aa"]) == ([(0, 3, "custom")], [])
    assert spans(spark, "abcd", families=[], words=["ab", "cd"])[0] == [(0, 2, "custom"), (2, 4, "custom")]


def test_find_all_matches_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("1２3,.万亿元%年月日￥ab😀\n") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for p in protect.PATTERNS["amount"] + protect.PATTERNS["date"]:
        got = {r.id: [(s.start, s.end) for s in r.s] for r in df.select("id", protect.find_all(F.col("text"), p, "x").alias("s")).collect()}
        py = re.compile(p.replace(r"[\p{Nd},]", r"[\d,]").replace(r"\p{Nd}", r"\d"))
        assert all(got[i] == [m.span() for m in py.finditer(t)] for i, t in enumerate(texts)), p


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200)
    a = df.repartition(7).select("id", draws.draw(1, F.col("id"), "x").alias("d")).orderBy("id").collect()
    assert a == df.coalesce(1).select("id", draws.draw(1, F.col("id"), "x").alias("d")).orderBy("id").collect()


def test_rates(spark):
    assert [round(x, 4) for x in draws.truncated_poisson(1.5, 4)] == [0.4414, 0.331, 0.1655, 0.0621]
    df = spark.createDataFrame([(20,), (50,), (80,), (10,), (100,)], "n int")
    assert [(r.a, r.b) for r in df.select(draws.length_rate(F.col("n")).alias("a"), draws.ratio_rate(F.col("n")).alias("b")).collect()] == [(1.0, 1.0), (2.0, 2.5), (3.0, 4.0), (1.0, 1.0), (3.0, 5.0)]
    n = spark.range(4000).select(draws.poisson_column(draws.draw(F.col("id")), F.lit(1.5), 4).alias("n")).groupBy().avg("n").first()[0]
    assert abs(n - 1.848) < 0.05
