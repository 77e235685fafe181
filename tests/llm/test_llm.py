import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import leaks, lookalikes, mojibake, overlaps, pieces, quality, queries, segmenter, tokenizing, truncation

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


# ---- problem 1


def test_forms():
    r = lookalikes.default_rewriter()
    same = [("编号AM-8", "编号АM-8", "编号ＡＭ－８"), ("wörld", "wörld", "w​orld".replace("orld", "örld")), ("が", "が", "ｶﾞ".replace("ｶﾞ", "が")), ("ガ", "ｶﾞ"), ("木", "⽊"), ("a b", "a　b", "a b"), ("ภำ", "ภํา"), ("ख़", "ख़")]
    for group in same:
        assert len({r(x) for x in group}) == 1, group
    for a, b in (("A", "a"), ("2", "②"), ("2", "²"), ('"', "“"), ("a b", "a  b"), ("未", "末"), ("１", "①")):
        assert r(a) != r(b)
    assert r("") == "" and r("​") == ""
    f = lookalikes.PointFolder(r)
    texts = ["", "Ａb​", "é" * 3, "中" * 5000, "がﾎﾟ"]
    points, ends = f(texts)
    starts = [0, *ends[:-1]]
    assert ["".join(map(chr, points[a:b])) for a, b in zip(starts, ends)] == [r(t) for t in texts]


def test_form_is_the_same_for_composed_and_decomposed_text():
    r, norm = lookalikes.default_rewriter(), unicodedata.normalize
    assert not [o for o in range(0x110000) if not 0xD800 <= o < 0xE000 and r(norm("NFC", chr(o))) != r(norm("NFD", chr(o)))]
    assert r("a\u0302\u0323") == r("a\u0323\u0302") == r("\u1ead") == r("а\u0323\u0302")  # marks in any order, also on a Cyrillic letter
    assert r("한글") == r(norm("NFD", "한글")) and r("ﾡ") == r("ㄱ") == r("\u1100") and r("ㄱㅏ") != r("가")
    rng, f = random.Random(7), lookalikes.PointFolder(r)
    pool = [chr(o) for a, b in ((0x20, 0x250), (0x300, 0x345), (0x370, 0x460), (0x900, 0x980), (0xE01, 0xE5B), (0x1100, 0x1200), (0x3040, 0x3190), (0xAC00, 0xAC40), (0xFF01, 0xFFDD)) for o in range(a, b)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    points, ends = f(texts)
    assert ["".join(map(chr, points[a:b])) for a, b in zip([0, *ends[:-1]], ends)] == [r(t) for t in texts] == [r(norm("NFD", t)) for t in texts] == [r(r(t)) for t in texts]


def test_representative_is_the_most_frequent():
    rep = lookalikes.representatives({"А": 5, "A": 3})
    assert rep["A"] == "А" and "А" not in rep
    r = lookalikes.Rewriter(rep)
    assert r("AB") == r("A​B") == r("АB") and lookalikes.Rewriter(lookalikes.representatives()).keeps_ascii


def test_equal_looking_pairs(spark):
    rows = [(0, 1, "AB"), (0, 2, "ＡB"), (0, 3, "AB"), (0, 4, None), (0, 5, ""), (0, 6, "​"), (1, 7, "АB"), (0, 8, "x" * 100000), (0, 9, "x" * 100000 + "​")] + [(1, 100 + i, "copy") for i in range(500)] + [(1, 700, "cоpy")]
    df = spark.createDataFrame(rows, "kind int, id long, text string").withColumn("raw", F.lit("clash"))
    got = {tuple(r) for r in lookalikes.equal_looking_pairs(df.select("kind", "id", "text"), lookalikes.representatives()).collect()}
    assert {g for g in got if g[0] == 0} == {(0, 1, 2), (0, 2, 3), (0, 5, 6), (0, 8, 9)}
    assert {g for g in got if g[0] == 1} == {(1, 100 + i, 700) for i in range(500)}
    assert lookalikes.equal_looking_pairs(df.limit(0).select("kind", "id", "text"), {}).count() == 0
    assert lookalikes.member_counts(df)["Ａ"] == 1
    assert [r.f for r in lookalikes.canonical_text(df.where("id in (2, 4, 5)"), "text", "f").orderBy("id").collect()] == ["AB", None, ""]


# ---- problem 2


def test_cut_matches_search():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("ab1，. 。") for _ in range(rng.randint(0, 120)))
        ends = [i + 1 for i, c in enumerate(t) if c in pieces.BREAKS and not (0 < i < len(t) - 1 and t[i - 1] == "1" and t[i + 1] == "1")]
        ok = {}

        def can(s):
            if s not in ok:
                ok[s] = len(t) - s <= 20 or any(can(e - 4) for e in ends if s + 4 < e <= s + 20)
            return ok[s]

        got, natural = pieces.cut(t, 20, 4)
        assert natural == can(0) and all(b - a <= 20 for a, b in got) and got[0][0] == 0 and got[-1][1] == len(t)
        assert all(y[0] == x[1] - 4 for x, y in zip(got, got[1:]))


def test_pieces(spark):
    rows = [(1, "a" * 300, 10, 5), (2, "", 0, 5), (3, None, 0, 5), (4, "短，" * 100000, None, 5), (5, "a", 3, 5)]
    df = spark.createDataFrame(rows, "id long, text string, start int, piece_id int")
    got = {}
    for r in pieces.pieces(df, "id", "text", "start").orderBy("id", "piece_id").collect():
        got.setdefault(r.id, []).append(r)
    assert {*got} == {1, 2, 4, 5} and [r.cut_kind for r in got[1]] == ["forced"] * 3 and got[1][1].original_start == 10 + 128 - 16
    assert got[2][0].piece_text == "" and got[2][0].cut_kind == "whole" and {r.cut_kind for r in got[4]} == {"natural"}
    assert pieces.pieces(df.limit(0), "id", "text", "start").count() == 0
    with pytest.raises(ValueError):
        pieces.pieces(df, "id", "text", "start", 10, 10)


# ---- problem 3

SENTENCES = [
    ["老师傅提醒：“甲不一致！节后乙。”", "2013年1月23日会计记录"],
    ["“甲一致！乙。”他们午休时间说。", "于是技术员"],
    ["负责人喊「我们！快！」，凌晨他们。", "对"],
    ["「春。急いで。」と村の人は言った。", "朝早く"],
    ["Dr. Quennick said it.", "The mill ... or what was left ... closed because D. B. Quennick wrote v7.3 (see Fig. 4 and Sec. 8.2).", "He left at 8 p.m.", "The baker, e.g. etc., as in No. 25?", "Yes."],
    ['"Was it the gate?" and one went.', "“The baker? It was broken,” said the clerk.", "End"],
    ["Am 24. Oktober sah man, z. B. bei der Brücke Nr. 79.", "„Müller.“, sagte er.", "Ende"],
    ["« Le gérant a vérifié? », dit un élève.", "Selon M. Tresker, il (cf. art. 14, p. 93).", "Oui"],
    ["«Водитель закрыл!» — сказал садовник.", "Ученик, т. е. склад, и т. д., до стр. 14.", "Наш"],
    ["ลูกศิษย์มีรั้ว 35 หลังแล้วตอนเช้า", "เมื่อวานนี้คน"],
    ["सर्दी में देखा।", "मेले?", "सुबह"],
    ["参见《要不要？》一文的第3.3节。", "甲……", "乙？！", "丙"],
    ["甲乙丙", "丁戊", "2020年"],
    ["1. 种子"],
    ["Ａｐｐｒｏｘ. ２,６ copies."],
]


def test_sentence_units(spark):
    sep = lambda u: "" if any("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in u) and u[-1] in "。！？…”」" else " "
    texts = []
    for units in SENTENCES:
        t = "  "
        for u in units:
            t += u + sep(u)
        texts.append(t)
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate([*texts, None, "", " 　 "])], "id int, text string, i int")
    got = {}
    for r in segmenter.sentence_units(df, "id", "text").orderBy("id", "sentence_id").collect():
        got.setdefault(r.id, []).append(texts[r.id][r.unit_start : r.unit_end])
    assert [got.get(i) for i in range(len(texts))] == SENTENCES and {*got} == {*range(len(texts))}
    assert segmenter.sentence_units(df.limit(0), "id", "text").count() == 0


def test_long_texts_stay_linear(spark):
    df = spark.createDataFrame([(1, "字" * 100000), (2, "字，。" * 20000), (3, "“" * 10000)], "id int, text string")
    assert {r.id: r["count"] for r in segmenter.sentence_units(df, "id", "text").groupBy("id").count().collect()} == {1: 1, 2: 20000, 3: 1}


def test_long_quotations_and_brackets_are_units(spark):
    long = "今天天气很好。" * 600
    texts = [f"他说：“{long}”我走了。", f"甲（{long}）乙。丙。", f"„{'Es regnet. ' * 500}“, sagte er. Er ging.", f"“{long}", f"”甲。“{long}", "“" * 100000 + "。", '"' + "a. B" * 20000, "„Ja.“ „" + "Es regnet. " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in segmenter.sentence_units(df, "id", "text").orderBy("id", "sentence_id").collect():
        got.setdefault(r.id, []).append(texts[r.id][r.unit_start : r.unit_end])
    assert got[0] == [f"他说：“{long}”", "我走了。"] and got[1] == [f"甲（{long}）乙。", "丙。"] and got[2] == [texts[2][:-9], "Er ging."]
    assert len(got[3]) == 600 and len(got[4]) == 601 and len(got[5]) == 1 and len(got[7]) == 4  # left open


# ---- problem 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_cross_split_pairs(spark):
    rng = random.Random(2)
    base = ["".join(chr(0x4E00 + rng.randint(0, 800)) for _ in range(rng.randint(5, 70))) for _ in range(60)]
    base += ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randint(80, 140))) for _ in range(20)]
    rows, n = [], 0
    for t in base:
        for split in ("train", "test", "train"):
            s = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 20))):
                s[rng.randrange(len(s))] = rng.choice("甲乙xyz")
            rows.append((n, split, "".join(s), None if rng.random() < 0.3 else t[::-1], "x"))
            n += 1
    rows += [(n, None, "a", "a", "x"), (n + 1, "train", None, None, "x"), (n + 2, "dev", "", None, "x"), (n + 3, "train", "​", None, "x"), (n + 4, "train", "Ａ" * 3000, None, "x"), (n + 5, "dev", "A" * 2900 + "b" * 90, None, "x")]
    df = spark.createDataFrame(rows, "row_id long, split string, original string, corrupted string, field string")
    got = {tuple(r) for r in overlaps.cross_split_pairs(df).collect()}
    fold = lookalikes.default_rewriter()
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] in ("dev", "test"):
                for f in (2, 3):
                    if a[f] is not None and b[f] is not None:
                        x, y = fold(a[f]), fold(b[f])
                        if x == y or len(x) < 200 and distance(x, y) <= max(len(x), len(y)) // 10:
                            want.add((min(a[0], b[0]), max(a[0], b[0])))
    want.add((n + 4, n + 5))
    assert got == want
    assert {tuple(r) for r in overlaps.cross_split_pairs(df, most=2000).collect()} == got  # overfull partitions are split up
    assert overlaps.cross_split_pairs(df.limit(0)).count() == 0


def test_spread_edits_lose_no_pair(spark):
    """As many edits as are allowed, spread evenly: no longer stretch is left unchanged."""
    rng = random.Random(3)
    rows, want = [], set()
    for k in range(80):
        n = rng.randint(10, 160) if k else 9
        letters = "abcdefghijklmnop " if k % 2 else [chr(0x4E00 + i) for i in range(800)]
        t = [rng.choice(letters) for _ in range(n)]
        s = list(t)
        if k % 4 < 2:
            for i in range(n // 10):
                s[n * (i + 1) // (n // 10 + 1)] = "z"
        else:
            for i in reversed(range(max(1, n // 10))):
                s.insert(n * (i + 1) // (n // 10 + 1), "z")
        s, t = "".join(s), "".join(t)
        assert distance(s, t) <= max(len(s), len(t)) // 10
        rows += [(2 * k, "train", (s, t)[k % 3 == 0], None, "x"), (2 * k + 1, "test", (t, s)[k % 3 == 0], None, "x")]
        want.add((2 * k, 2 * k + 1))
    df = spark.createDataFrame(rows, "row_id long, split string, original string, corrupted string, field string")
    assert {tuple(r) for r in overlaps.cross_split_pairs(df).collect()} == want
    assert {tuple(r) for r in overlaps.cross_split_pairs(df, most=500).collect()} == want


def test_near_pairs_of_alphabetic_texts_are_all_found(spark):
    """One edit and a tenth of edits at random places, at lengths where texts have few pieces; and a piece that most texts share."""
    rng = random.Random(8)
    rows, want = [], set()
    for n in (10, 19, 20, 27, 28, 30, 31, 40, 60, 64, 120):
        for k in range(24):
            t = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)]
            if k % 3 == 0 and n >= 40:
                t[:15] = "the common piece"[:15]
            s = list(t)
            for _ in range(1 if k % 2 else n // 10):
                at = rng.randrange(len(s))
                kind = rng.randrange(3)
                if kind == 0:
                    s[at] = rng.choice("abcdefgh")
                elif kind == 1 and len(s) > n - n // 10 + 1:
                    del s[at]
                else:
                    s.insert(at, rng.choice("abcdefgh"))
            a, b = "".join(t), "".join(s)
            if distance(a, b) <= max(len(a), len(b)) // 10:
                want.add((len(rows), len(rows) + 1))
            rows += [(len(rows), "train", a, None), (len(rows) + 1, "dev", b, None)]
    df = spark.createDataFrame(rows, "row_id long, split string, original string, corrupted string")
    for most in (overlaps.MOST_ENTRIES, 500):
        got = {tuple(r) for r in overlaps.cross_split_pairs(df, most=most).collect()}
        assert len(want) > 200 and want <= got


def test_common_phrases_make_few_candidates(spark):
    """Texts of one pattern share most pieces but few are near: candidates must not grow with the square of such texts."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    things, places = [word(7) for _ in range(40)], [word(6) for _ in range(12)]
    forms, want = {}, set()
    for k in range(1500):
        t = f"At {word(8)}, {word(9)} and {word(7)}: the {rng.choice(things)} was returned before the end of the {rng.choice(places)} since the storm."
        forms.setdefault(t, 0b1010 if k % 5 == 0 else 0b0101)
        if k % 25 == 0:
            s = list(t)
            for _ in range(rng.randint(1, len(t) // 10)):
                s[rng.randrange(len(s))] = rng.choice("abcdefgh")
            s = "".join(s)
            if s not in forms:
                forms[s] = 0b0101
                want.add((t, s))
    ids = {t: i for i, t in enumerate(forms)}
    texts = spark.createDataFrame([(ids[t], ids[t], ids[t], side, t) for t, side in forms.items()], "id long, h1 long, h2 long, side int, form string")
    for most in (overlaps.MOST_ENTRIES, 3000):
        got = {tuple(r) for r in overlaps.candidates(texts, most).collect()}
        assert {(ids[a], ids[b]) for a, b in want} <= got
        assert len(got) < 10_000  # of 360,000 pairs, of which some 60 are near


def test_blocks_round_trip():
    e = np.zeros(5, overlaps.ENTRY)
    e["gram"], e["id"] = range(5), range(5, 10)
    assert (overlaps._unpacked(overlaps._packed(e)) == e).all()


# ---- problem 5


def test_cut_values(spark):
    full = "甲乙丙丁戊己庚辛壬癸。"
    inputs = [(i, f"s{i}", "a", full, t, 0) for i, t in enumerate([full, full[:6], full[:6] + "[...]", full[:6] + "…", full[:5] + "�", "关于加固甲的方案", "关于加固", None, "“甲。乙"])]
    # The ending of titles is learned from those that end as their source does; a limit from lengths that stand out.
    inputs += [(20 + i, f"t{i}", "a", f"关于关于{c}的方案", f"关于{c}的方案", 0) for i, c in enumerate("甲乙丙丁戊")]
    inputs += [(30 + i, f"u{i}", "b", None, ("甲乙丙丁戊己庚辛壬癸" * 3)[i : i + 12], 0) for i in range(9)] + [(50, "v0", "b", "甲乙丙丁戊己庚辛壬癸子，天地玄黄宇宙洪荒日月盈昃。", "甲乙丙丁戊己庚辛壬癸子。", 0), (51, "v1", "b", None, "甲乙。", 0)]
    ids = lambda n, width=16, sep=True: ([101, *range(104, 104 + n), *([102] * sep)] + [0] * width)[:width]
    samples = [(i, f"s{i}", "a", ids(len(full)), [101, 102] + [103] * len(full) + [102, 0], [-100, -100] + [104] * len(full) + [-100, -100]) for i in range(4)]
    samples += [(10, "s9", "a", ids(4), None, None), (11, "s0", "a", ids(4), [101, 103, 103, 102, 0], [-100, 104, -100, -100, -100]), (12, "s0", "a", ids(5, sep=False), None, None), (13, None, "a", None, None, None)]
    a = spark.createDataFrame(inputs, "row_id long, sample_id string, source string, source_text string, target_text string, t int")
    b = spark.createDataFrame(samples, "row_id long, sample_id string, source string, input_ids array<int>, template_input_ids array<int>, infill_labels array<int>")
    got = {}
    for r in truncation.cut_values(a, b, [104]).collect():
        got.setdefault(r.field, set()).add(r.row_id)
    assert got == {"target_text": {1, 2, 3, 4, 6, 8, *range(30, 39), 50}, "input_ids": {11, 12}, "infill_labels": {11}}
    assert truncation.cut_values(a.limit(0), b.limit(0), []).count() == 0


def test_hidden_limits(spark):
    rows = [("a", "字" * 20, 1) for _ in range(10)] + [("a", "字" * 35, 1) for _ in range(8)] + [("b", "é" * n + "。", 1) for n in range(5, 15)] + [("c", "é" * n, 1) for n in range(5, 45)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "source string, text string, unit int")
    got = {}
    for r in truncation.hidden_limits(df, "source", "text").collect():
        got.setdefault((r.source, r.unit), set()).add((r.cap, r.n_at_cap))
    assert got["a", "chars"] == {(20, 10), (35, 8)} and got["a", "utf8"] == {(60, 10), (105, 8)} and got["a", "gbk"] == {(40, 10), (70, 8)}
    assert {k[0] for k in got} == {"a"}  # closed texts and lengths of all sizes show no limit


# ---- problem 6


def test_garbled(spark):
    rng = random.Random(3)
    words = ["驾驶员", "管理员", "水渠", "数量达到", "不知道", "为什么", "比较干净", "，", "。", "老师傅", "记录了"]
    clean = ["".join(rng.choice(words) for _ in range(12)) for _ in range(400)] + ["Le préposé a vérifié la clé fermée près du château."] * 40
    bad = {
        1000: clean[0].encode().decode("latin-1"),
        1001: clean[1].encode().decode("gb18030", "replace"),
        1002: clean[2].encode("gb18030").decode("latin-1"),
        1003: clean[3][:10] + clean[3][10:].encode().decode("latin-1"),
        1004: clean[4].encode().decode("latin-1").encode().decode("latin-1"),
        1005: "Le prÃ©posÃ© a vÃ©rifiÃ© la clÃ© fermÃ©e.",
        1006: "管理�记录了水渠。",  # one character, all of whose bytes were lost in reading
    }
    good = {2000: "涓师傅不知道水渠，", 2001: "é", 2002: "Ã", 2003: "£", 2005: "", 2006: None, 2007: "字" * 50000}
    rows = [("original", i, "s", t) for i, t in enumerate(clean)] + [("original", i, "s", t) for i, t in {**bad, **good}.items()]
    df = spark.createDataFrame(rows, "field string, row_id long, source string, text string").withColumn("gain", F.lit("clash"))
    model = mojibake.Model.learn(df.select("text"))
    got = {r.row_id: r.restored for r in mojibake.garbled(df, model).collect()}
    assert {*got} == {*bad}
    assert got[1000] == clean[0] and got[1002] == clean[2] and got[1003] == clean[3] and got[1004] == clean[4]
    short = {"æ\x9c¯": "术", "Íä": "弯", "Ã¥Â¤Â«": "夫"}
    assert {k: mojibake.best_reading(k, model)[2] for k in short} == short
    assert mojibake.best_reading("��胯�嫘�∼����颯", model)[0] >= 0 and mojibake.suspects(["��胯�嫘�∼����颯"])[0]
    assert mojibake.garbled(df.limit(0), model).count() == 0


def test_garbled_in_other_code_pages(spark):
    clean = ["Привет, сегодня хорошая погода и мы идём гулять.", "สวัสดีครับ วันนี้อากาศดีมาก", "안녕하세요 오늘은 날씨가 좋습니다", "こんにちは、今日はいい天気ですね", "आज मौसम बहुत अच्छा है"]
    bad = {1000: (0, "cp1251"), 1001: (0, "koi8-r"), 1002: (1, "gb18030"), 1003: (1, "cp932"), 1004: (2, "euc_kr"), 1005: (3, "euc_jp"), 1006: (4, "gb18030")}
    read = lambda t, page: t.encode(page).decode("latin-1") if page.startswith("euc") else t.encode().decode(page, "replace")
    rows = [("original", i, "s", t) for i, t in enumerate(clean * 40)] + [("original", i, "s", read(clean[k], page)) for i, (k, page) in bad.items()]
    df = spark.createDataFrame(rows, "field string, row_id long, source string, text string")
    got = {r.row_id: r.restored for r in mojibake.garbled(df, mojibake.Model.learn(df.select("text"))).collect()}
    assert {*got} == {*bad}
    assert all(got[i] == clean[bad[i][0]] for i in (1000, 1001, 1004, 1005))


# ---- problem 7


@pytest.fixture(scope="module")
def automaton():
    path = os.path.join(tokenizing.TOKENIZERS, "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    return tokenizing.automaton(path)


def test_tokens_match_the_library(automaton):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(os.path.join(tokenizing.TOKENIZERS, "byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    rng = random.Random(4)
    signs = "'strevmld S\n\t\r 　a1é中²½ॐ.,!​\x1c😀<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + ["", "<|endoftext|>", "a" * 100000, "中文" * 30000]
    got = automaton.encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert all(automaton.decode(g.tolist()) == t for g, t in zip(got[:500], texts))
    automaton.flush()
    assert [g.tolist() for g in automaton.encode(texts[:100])] == [g.tolist() for g in got[:100]]


def test_token_ids(spark, automaton):
    df = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0)], "doc_id long, text string, ids int")
    assert {r.doc_id: r.ids for r in tokenizing.token_ids(df, "doc_id", "text").collect()} == {1: [31373, 995], 2: [], 3: []}
    assert tokenizing.token_ids(df.limit(0), "doc_id", "text").count() == 0


# ---- problem 8


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(80))
    items = [word() for _ in range(40)]
    other = [word() for _ in range(50)]
    changed = list(items[2])
    for i in (5, 20, 41, 60):
        changed[i] = "甲"
    docs = {
        1: other[0] + items[0] + other[1],
        2: other[2] + items[1][10:55] + other[3],
        3: other[4] + "".join(changed) + other[5],
        4: other[6] + " \n".join(items[3]) + "​",
        5: other[7] + items[4][:30] + other[8] + items[4][50:],
        6: other[9] * 30 + items[5] + items[6] + other[10] * 300,
        7: "",
        8: None,
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(100, None), (101, ""), (102, items[0])], "item_id long, text string")
    got = {tuple(r) for r in leaks.leaks(df, "doc_id", "text", it, "item_id", "text").collect()}
    assert got == {(1, 0), (1, 102), (2, 1), (3, 2), (4, 3), (6, 5), (6, 6)}
    assert leaks.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    assert leaks.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


# ---- problem 9


def test_rule_induction_on_held_out_rows():
    rng = np.random.default_rng(6)
    x = rng.random((3000, 4))
    y = np.where(x[:, 0] > 0.8, "table", np.where((x[:, 1] <= 0.3) & (x[:, 2] > 0.5), "junk", "prose"))
    rules = quality.induce_rules(x[:2000], y[:2000], ["table", "junk"])
    got = np.full(1000, "prose", dtype=object)
    for rule, label in reversed(rules):
        got[quality._cover(x[2000:], rule)] = label
    assert (got == y[2000:]).mean() > 0.97
    assert quality.induce_rules(x[:0], y[:0], ["a"]) == []


def test_rules_hold_on_labelled_documents_that_they_have_not_seen():
    x, y = quality.labelled()
    rng, right = np.random.default_rng(9), []
    at = rng.permutation(len(x))
    for k in range(5):
        held = at[k::5]
        rules = quality.induce_rules(np.delete(x, held, 0), np.delete(y, held), ["table", "junk", "list"])
        got = np.full(len(held), "prose", dtype=object)
        for rule, label in reversed(rules):
            got[quality._cover(x[held], rule)] = label
        right.append(got == y[held])
    right, true = np.concatenate(right), np.concatenate([y[at[k::5]] for k in range(5)])
    assert len(x) == 5419 and right.mean() > 0.99 and all(right[true == k].mean() > 0.97 for k in ("prose", "table", "list", "junk"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_labelled_statistics_are_those_of_the_documents(spark):
    docs, common = quality._inputs(spark, "/root/testdata/sf0.1")
    some = {int(k): v for k, v in zip(*np.genfromtxt(quality.__file__.replace("quality.py", quality.LABELLED), delimiter=",", names=True, usecols=(0, 2), unpack=True))}
    rows = quality.statistics(docs.where("doc_id < 300"), "doc_id", "text", common).collect()
    assert all(abs(r.lines - some[r.doc_id]) < 1e-6 for r in rows if r.doc_id in some)


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat, 12.\n- a\n\nx|y", 0), (2, "中文字。", 0), (3, "", 0), (4, None, 0), (5, " \n ", 0), (6, "字" * 100000, 0)], "id long, text string, lines int")
    got = {r.id: r for r in quality.statistics(df, "id", "text", ["the", "中"]).collect()}
    assert got[1].lines == 3 and got[1].words == 6 and abs(got[1].end_share - 1 / 3) < 1e-9 and abs(got[1].bullet_share - 1 / 3) < 1e-9
    assert got[2].words == 3 and got[2].common_share == 0.25 and got[2].end_share == 1
    assert got[3].n_chars == 0 and got[3].end_share is None and got[4].n_chars == 0 and got[5].lines == 0
    assert quality.kinds(df.limit(0), "id", "text", []).count() == 0
    assert {r.id for r in quality.kinds(df, "id", "text", [], rules=[]).collect()} == {1, 2, 6}


# ---- queries


@data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    queries.QUERIES[name](spark, DATA).collect()


@data
def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("sentences", "corruptions", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        assert sorted(map(tuple, queries.QUERIES[name](spark, DATA).collect())) == sorted(con.execute(sql).fetchall())


def test_unicode_data_is_what_the_table_expects():
    assert unicodedata.decomposition("Ａ").startswith("<wide>")
