import json

import pytest

from quillmill.sources import readers, writers


def put(path, *lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def pairs(df):
    return sorted((r.source, r.target) for r in df.collect())


def test_pair_formats(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"source": "a", "target": "b"}', '{"src": "c", "tgt": ["d", "e"]}', '{"source": "x", "target": []}', '{"source": "", "target": "b"}', "", "t1\tt2", "one", '{"broken": ', '{"broken\ty')
    assert pairs(readers.read_pairs(spark, p, "mucgec")) == [("a", "b"), ("c", "d"), ("t1", "t2"), ("x", "x"), ('{"broken', "y")]
    p = put(tmp_path / "b.tsv", 'a "q\tb', "only", "", "c\td\te")
    assert pairs(readers.read_pairs(spark, p, "parallel")) == [('a "q', "b"), ("c", "d")]
    assert pairs(readers.read_pairs(spark, put(tmp_path / "c.tsv", "1\ta\tb"), "sighan", id_column=True)) == [("a", "b")]
    p = put(tmp_path / "d.txt", "a\tb", '{"original": "c", "correct": "d"}', "{bad")
    assert pairs(readers.read_pairs(spark, p, "ecspell")) == [("a", "b"), ("c", "d")]
    assert pairs(readers.read_pairs(spark, put(tmp_path / "e.json", json.dumps([{"input": "a", "output": "b"}, {"src": "", "tgt": "x"}])), "custom")) == [("a", "b")]
    assert pairs(readers.read_pairs(spark, put(tmp_path / "f.json", json.dumps({"k": {"source": "a", "target": "b"}})), "custom")) == [("a", "b")]
    with pytest.raises(ValueError):
        readers.read_pairs(spark, p, "nope")


def test_labelled_and_plain(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", json.dumps({"source": "ab", "target": "a", "op_labels": [0, 1], "insert_labels": [0, 0]}), '{"source": "c", "target": "d"}')
    done, plain = readers.read_labelled(spark, p)
    assert done.first().op_labels == [0, 1] and pairs(plain) == [("c", "d")]
    assert readers.read_labelled(spark, p, strict=True)[1].count() == 0


def test_clean_texts(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"text": "a"}', '{"sentence": "b", "text": ""}', '"c"', "d", "")
    assert sorted(r.text for r in readers.read_clean(spark, p).collect()) == ["a", "b", "c", "d"]
    p = put(tmp_path / "b.json", json.dumps(["a", {"content": "b"}, {"target": "c"}]))
    assert sorted(r.text for r in readers.read_clean(spark, p, with_target=True).collect()) == ["a", "b", "c"]


def test_confusion_files(spark, tmp_path):
    get = lambda p: sorted((r.char, r.confusion) for r in readers.read_confusions(spark, p).collect())
    assert get(put(tmp_path / "a.json", '{"的": ["得", "地"]}')) == [("的", "地"), ("的", "得")]
    assert get(put(tmp_path / "b.json", '[{"char": "的", "confusions": ["得"], "type": "shape"}]')) == [("的", "得")]
    assert get(put(tmp_path / "c.jsonl", '{"char": "的", "confusions": ["得"]}')) == [("的", "得")]
    assert get(put(tmp_path / "d.tsv", "# c", "的\t得\t\t地", "")) == [("的", "地"), ("的", "得")]
    assert get(str(tmp_path / "none.tsv")) == []


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", True, 1), ("c", "c", False, 0)], "source string, target string, is_corrupted boolean, num_edits int")
    for fmt in ("jsonl", "json", "tsv"):
        writers.write_frozen(df, str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2
    assert len(json.loads("".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "json").glob("part-*"))))) == 2
    assert pairs(readers.read_pairs(spark, str(tmp_path / "tsv"), "parallel")) == [("a", "b"), ("c", "c")]
    with pytest.raises(ValueError):
        writers.write_frozen(df, str(tmp_path / "x"), "xml")
    out = df.withColumnRenamed("target", "prediction").withColumn("is_changed", df.is_corrupted)
    writers.write_predictions(out, str(tmp_path / "p"), only_changed=True)
    assert spark.read.json(str(tmp_path / "p")).count() == 1


def test_strings_that_look_like_lists(spark, tmp_path):
    rows = [("[1] a", "[b"), ('["q"]', "x"), ("c", "[]")]
    p = put(tmp_path / "a.jsonl", *(json.dumps({"source": a, "target": b}) for a, b in rows), '{"source": ["[d]", "e"], "target": ["f"]}')
    assert pairs(readers.read_pairs(spark, p, "mucgec")) == sorted([*rows, ("[d]", "f")])
    p = put(tmp_path / "b.json", json.dumps([{"input": "[a] b", "output": "c"}]))
    assert pairs(readers.read_pairs(spark, p, "custom")) == [("[a] b", "c")]


def test_bracketed_pairs_make_the_round_trip(spark, tmp_path):
    from quillmill.plans import queries as core

    rows = [(1, "[公告] 今天", "[公告] 明天"), (2, "a", "[b]"), (3, "c", "d")]
    spark.createDataFrame(rows, "row_id long, source_text string, target_text string").write.parquet(str(tmp_path / "model_inputs.parquet"))
    assert sorted(tuple(r) for r in core.QUERIES["read_pairs_json"](spark, str(tmp_path)).collect()) == rows
