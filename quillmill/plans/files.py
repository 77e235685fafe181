"""Queries of readers and writers: tables to files of each format and back, with what the files should give as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..operators import confusion, features
from ..runtime import checkpoint_dir, spread, table
from ..sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_CLEAN = r"[\t\n\r]"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, value, path: str) -> str:
    rows.select(value.alias("value")).write.text(path)
    return path


def _clean(c: str):
    return F.trim(F.regexp_replace(c, _CLEAN, " "))


def _pairs(spark, d) -> DataFrame:
    rows = spread(table(spark, d, "model_inputs", ["row_id", "source_text", "target_text"])).where("source_text is not null and target_text is not null")
    return rows.select("row_id", _clean("source_text").alias("s"), _clean("target_text").alias("t")).where("s <> '' and t <> ''")


def _keyed(pairs: DataFrame) -> DataFrame:
    """The row ids that the files carry in front of the source."""
    at = F.instr("source", "|")
    return pairs.select(F.substring("source", F.lit(1), at - 1).cast("long").alias("row_id"), F.substring("source", at + 1, F.length("source")).alias("source"), "target")


_ROWS = f"""SELECT row_id, trim(regexp_replace(source_text, '{_CLEAN}', ' ', 'g')) AS source, trim(regexp_replace(target_text, '{_CLEAN}', ' ', 'g')) AS target
FROM model_inputs WHERE trim(regexp_replace(source_text, '{_CLEAN}', ' ', 'g')) <> '' AND trim(regexp_replace(target_text, '{_CLEAN}', ' ', 'g')) <> ''"""


def _own():
    return F.concat_ws("|", F.col("row_id").cast("string"), "s")


@query(f"SELECT row_id, source, CASE WHEN row_id % 4 = 1 THEN row_id || '|' || source ELSE target END AS target FROM ({_ROWS})")
def read_pairs_file(spark, d):
    """JSON lines of four shapes by row: a list target, an empty list target, the short names, and no JSON but tabs."""
    k = F.col("row_id") % 4
    quoted = lambda c: F.to_json(F.array(c))
    line = (
        F.when(k == 0, F.concat(F.lit('{"source":'), F.substring(quoted(_own()), F.lit(2), F.length(quoted(_own())) - 2), F.lit(',"target":'), F.to_json(F.array("t", F.lit("other"))), F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"source":'), F.substring(quoted(_own()), F.lit(2), F.length(quoted(_own())) - 2), F.lit(',"target":[]}')))
        .when(k == 2, F.to_json(F.struct(_own().alias("src"), F.col("t").alias("tgt"))))
        .otherwise(F.concat_ws("\t", _own(), "t"))
    )
    return _keyed(readers.read_pairs(spark, _lines(_pairs(spark, d), line, _folder(spark)), "mucgec"))


@query(_ROWS)
def read_pairs_mixed(spark, d):
    """Tab-separated and JSON lines in one file."""
    line = F.when(F.col("row_id") % 2 == 0, F.concat_ws("\t", _own(), "t")).otherwise(F.to_json(F.struct(_own().alias("original"), F.col("t").alias("correct"))))
    return _keyed(readers.read_pairs(spark, _lines(_pairs(spark, d), line, _folder(spark)), "ecspell"))


@query(_ROWS)
def read_pairs_parallel(spark, d):
    return _keyed(readers.read_pairs(spark, _lines(_pairs(spark, d), F.concat_ws("\t", _own(), "t"), _folder(spark)), "parallel"))


@query(_ROWS)
def read_pairs_documents(spark, d):
    """JSON documents of some fifty pairs each, as lists and as objects."""
    group = F.floor(F.col("row_id") / 50)
    one = F.when(group % 2 == 0, F.to_json(F.struct(_own().alias("input"), F.col("t").alias("output")))).otherwise(F.concat(F.lit('"'), F.col("row_id").cast("string"), F.lit('":'), F.to_json(F.struct(_own().alias("src"), F.col("t").alias("tgt")))))
    docs = _pairs(spark, d).select(group.alias("g"), one.alias("x")).groupBy("g").agg(F.array_join(F.collect_list("x"), ",").alias("x"))
    return _keyed(readers.document_pairs(docs.select(F.when(F.col("g") % 2 == 0, F.concat(F.lit("["), "x", F.lit("]"))).otherwise(F.concat(F.lit("{"), "x", F.lit("}"))).alias("value"))))


_LABELS = "op_labels IS NOT NULL AND insert_labels IS NOT NULL"


@query(f"""SELECT s.row_id, count(*) FILTER (o <> 0)::BIGINT AS edit_distance FROM (SELECT row_id, sample_id, unnest(op_labels) AS o FROM tokenized_samples WHERE {_LABELS} AND len(op_labels) > 0) s GROUP BY s.row_id""")
def read_labelled_file(spark, d):
    """Rows that bring their labels, among plain pairs; the source is the row's id here."""
    rows = spread(table(spark, d, "tokenized_samples", ["row_id", "op_labels", "insert_labels"])).where(f"{_LABELS} and size(op_labels) > 0")
    line = F.to_json(F.struct(F.col("row_id").cast("string").alias("source"), F.lit("x").alias("target"), "op_labels", "insert_labels"))
    plain = rows.limit(1).select(F.lit('{"source":"a","target":"b"}').alias("value"))
    path = _folder(spark)
    rows.select(line.alias("value")).unionAll(plain).write.text(path)
    done, _ = readers.read_labelled(spark, path)
    return readers.labelled_within(done).select(F.col("source").cast("long").alias("row_id"), F.col("edit_distance").cast("long").alias("edit_distance"))


_TEXT = f"SELECT trim(regexp_replace(text, '{_CLEAN}', ' ', 'g')) AS text FROM sentences WHERE trim(regexp_replace(text, '{_CLEAN}', ' ', 'g')) <> '' AND substr(trim(regexp_replace(text, '{_CLEAN}', ' ', 'g')), 1, 1) NOT IN ('{{', '\"')"


def _texts(spark, d) -> DataFrame:
    return spread(table(spark, d, "sentences", ["seg_id", "text"])).select("seg_id", _clean("text").alias("t")).where("t <> '' and left(t, 1) not in ('{', '\"')")


@query(_TEXT)
def read_clean_lines(spark, d):
    """Plain lines, JSON strings, and objects by three names."""
    k = F.col("seg_id") % 5
    line = F.col("t")
    for i, name in enumerate(("text", "sentence", "content")):
        line = F.when(k == i, F.to_json(F.struct(F.col("t").alias(name)))).otherwise(line)
    quoted = F.to_json(F.array("t"))
    return readers.read_clean(spark, _lines(_texts(spark, d), F.when(k == 3, F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(line), f"{_folder(spark)}.jsonl"))


@query(_TEXT)
def read_clean_targets(spark, d):
    """As for a frozen set: the target stands in where no other name does."""
    return readers.read_clean(spark, _lines(_texts(spark, d), F.to_json(F.struct(F.col("t").alias("target"))), f"{_folder(spark)}.jsonl"), with_target=True)


@query(_TEXT)
def read_clean_strict(spark, d):
    """As for static samples: text or source, and broken JSON would be an error."""
    rows = _texts(spark, d).select(F.when(F.col("seg_id") % 2 == 0, F.to_json(F.struct(F.col("t").alias("source")))).otherwise(F.to_json(F.struct(F.col("t").alias("text")))).alias("value"))
    return readers.clean_texts(rows, ("text", "source"), strict=True)


@query(_ROWS.replace("SELECT row_id,", "SELECT", 1).replace("AS target\nFROM", "AS target\nFROM").join(["SELECT source FROM (", ")"]))
def read_sources_parallel(spark, d):
    return readers.read_sources(spark, _lines(_pairs(spark, d), F.concat_ws("\t", "s", "t"), _folder(spark)), parallel=True)


_MEMBERS = "SELECT DISTINCT char, c AS confusion FROM (SELECT trim(char) AS char, trim(unnest(confusions)) AS c FROM confusion_entries WHERE trim(char) <> '' AND char NOT LIKE '#%' AND char NOT LIKE '%\t%') WHERE c <> ''"


def _members(spark, d) -> DataFrame:
    return table(spark, d, "confusion_entries", ["entry_id", "char", "confusions"]).where("trim(char) <> '' and char not like '#%' and char not like '%\t%'")


@query(_MEMBERS)
def read_confusions_tsv(spark, d):
    path = _lines(_members(spark, d).where("size(confusions) > 0"), F.concat_ws("\t", "char", "confusions"), f"{_folder(spark)}.tsv")
    return readers.read_confusions(spark, path).select("char", "confusion").distinct()


@query(_MEMBERS)
def read_confusions_jsonl(spark, d):
    path = _lines(_members(spark, d), F.to_json(F.struct(F.trim("char").alias("char"), "confusions", F.lit("own").alias("type"))), f"{_folder(spark)}.jsonl")
    return readers.read_confusions(spark, path).where("type = 'own'").select("char", "confusion").distinct()


@query("SELECT DISTINCT char, c AS confusion FROM (SELECT char, unnest(string_split(array_to_string(list_filter(confusions, lambda x: x IS NOT NULL), ''), '')) AS c FROM confusion_entries WHERE length(char) = 1 AND trim(char) <> '' AND char <> '#') WHERE c <> '' AND c <> char")
def raw_confusions(spark, d):
    """Runs of characters behind a head, each of which is a confusion."""
    rows = table(spark, d, "confusion_entries", ["char", "confusions"]).where("length(char) = 1 and trim(char) <> '' and char <> '#' and size(confusions) > 0")
    return confusion.from_raw_fields(rows.select(F.concat_ws("\t", "char", "confusions").alias("value")))


@query("SELECT char, array_to_string(list_sort(list(DISTINCT c)), ',') AS confusions FROM (SELECT char, unnest(confusions) AS c FROM confusion_entries WHERE char IS NOT NULL) WHERE c IS NOT NULL AND c <> '' AND trim(c) = c AND trim(char) = char AND char NOT LIKE '#%' GROUP BY char")
def write_confusions(spark, d):
    """A set to a sorted file with a head line, and back."""
    pairs = confusion.pairs_from_entries(table(spark, d, "confusion_entries")).where("confusion <> '' and trim(confusion) = confusion and trim(char) = char and char not like '#%'")
    path = f"{_folder(spark)}.tsv"
    writers.write_confusions(confusion.lookup(pairs), path)
    back = readers.read_confusions(spark, path).groupBy("char").agg(F.array_sort(F.collect_set("confusion")).alias("l"))
    return back.select("char", F.array_join("l", ",").alias("confusions"))


def _frozen(spark, d):
    rows = spread(table(spark, d, "corruptions", ["row_id", "original", "corrupted", "is_corrupted", "num_edits"])).where("original is not null and corrupted is not null and num_edits is not null")
    return rows.select("row_id", F.concat_ws("|", F.col("row_id").cast("string"), _clean("corrupted")).alias("source"), _clean("original").alias("target"), "is_corrupted", "num_edits")


_FROZEN = f"SELECT row_id, trim(regexp_replace(corrupted, '{_CLEAN}', ' ', 'g')) AS source, trim(regexp_replace(original, '{_CLEAN}', ' ', 'g')) AS target, num_edits::BIGINT AS num_edits FROM corruptions WHERE original IS NOT NULL AND corrupted IS NOT NULL AND num_edits IS NOT NULL"


def _thawed(rows: DataFrame) -> DataFrame:
    return _keyed(rows.select("source", F.coalesce("target", F.lit("")).alias("target"))).join(rows.select(F.substring_index("source", "|", 1).cast("long").alias("row_id"), F.col("num_edits").cast("long").alias("num_edits")), "row_id")


@query(_FROZEN)
def frozen_jsonl(spark, d):
    path = _folder(spark)
    writers.write_frozen(_frozen(spark, d), path)
    return _thawed(spark.read.schema("source string, target string, num_edits int").json(path))


@query(_FROZEN)
def frozen_json(spark, d):
    """One array over all files."""
    path = _folder(spark)
    writers.write_frozen(_frozen(spark, d), path, "json")
    lines = spark.read.text(path).where("value <> ']'")
    rows = lines.select(F.from_json(F.substring("value", F.lit(2), F.length("value")), "source string, target string, num_edits int").alias("r")).select("r.*")
    return _thawed(rows)


@query(_FROZEN)
def frozen_tsv(spark, d):
    path = _folder(spark)
    writers.write_frozen(_frozen(spark, d), path, "tsv")
    f = F.split("value", "\t", -1)
    return _thawed(spark.read.text(path).select(F.get(f, F.lit(0)).alias("source"), F.get(f, F.lit(1)).alias("target"), F.get(f, F.lit(3)).alias("num_edits")))


@query("SELECT row_id, split, original FROM corruptions WHERE split IS NOT NULL AND original IS NOT NULL")
def samples_by_split(spark, d):
    path = _folder(spark)
    writers.write_samples(spread(table(spark, d, "corruptions", ["row_id", "split", "original"])).where("split is not null and original is not null"), path)
    return spark.read.schema("row_id long, original string, split string").json(path).select("row_id", "split", "original")


@query(f"SELECT row_id, source, target AS prediction FROM ({_ROWS}) WHERE row_id || '|' || source <> row_id || '|' || target")
def predictions_parallel(spark, d):
    """Changed predictions only."""
    rows = _pairs(spark, d).select(_own().alias("source"), F.concat_ws("|", F.col("row_id").cast("string"), "t").alias("prediction"))
    path = _folder(spark)
    writers.write_predictions(rows, path, "parallel", only_changed=True)
    back = _keyed(readers.tsv_pairs(spark.read.text(path)))
    return back.select("row_id", "source", F.substring_index("target", "|", -1).alias("p"), F.col("target").alias("prediction")).select("row_id", "source", F.substring("prediction", F.instr("prediction", "|") + 1, F.length("prediction")).alias("prediction"))


_HEX = {"h": "list_transform({0}, lambda v: printf('%02X%02X', (v::INTEGER & 255), ((v::INTEGER >> 8) & 255)))", "b": "list_transform({0}, lambda v: printf('%02X', (v::INTEGER & 255)))"}
_RECORD = " || ".join(f"array_to_string({_HEX[k].format(c)}, '')" for c, k in features.VECTORS.items())
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in features.VECTORS)


@query(f"SELECT row_id, {_RECORD} AS record FROM tokenized_samples WHERE {_WHOLE}")
def pack_records(spark, d):
    """The bytes of each record."""
    rows = features.packed(spread(table(spark, d, "tokenized_samples", ["row_id", *features.VECTORS])))
    return rows.where("record is not null").select("row_id", F.hex("record").alias("record"))


_WIDTH = " AND ".join(f"len({c}) = 128" for c in features.VECTORS)


@query(f"SELECT {', '.join(f'array_to_string({c}, chr(44)) AS {c}' for c in features.VECTORS)} FROM tokenized_samples WHERE {_WHOLE} AND {_WIDTH}")
def records_file(spark, d):
    """Records of one width to .bin and .idx files and back."""
    rows = spread(table(spark, d, "tokenized_samples", list(features.VECTORS))).where(_WIDTH.replace("len(", "size("))
    path = _folder(spark).removeprefix("file:")
    writers.write_records(rows, path, 128)
    back = features.unpacked(readers_records(spark, path), 128)
    return back.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in features.VECTORS])


def readers_records(spark, path: str) -> DataFrame:
    return writers.read_records(spark, path, 128)


@query(f"""SELECT count(*)::BIGINT AS n_lines, count(*) FILTER (row_id % 10 <> 0)::BIGINT AS n_read, count(*) FILTER (row_id % 10 = 0)::BIGINT AS n_rejected FROM ({_ROWS})""")
def rejected_rows(spark, d):
    """Every tenth line has one column only and is left out and counted."""
    lines = _pairs(spark, d).select(F.when(F.col("row_id") % 10 == 0, "x").otherwise(F.concat_ws("\t", _own(), "t")).alias("value"))
    return readers.rejected(lines, readers.tsv_pairs(lines))


@query("SELECT batch, count(*)::BIGINT AS n FROM (SELECT g, floor((row_number() OVER (PARTITION BY g ORDER BY h, row_id) - 1) / 64)::BIGINT AS b, g || '-' || floor((row_number() OVER (PARTITION BY g ORDER BY h, row_id) - 1) / 64)::BIGINT AS batch FROM (SELECT row_id, h, h % greatest(1, (SELECT count(*) FROM tokenized_samples) // 4096) AS g FROM (SELECT row_id, ('0x' || substr(md5('42:1:batch:' || row_id), 1, 8))::BIGINT AS h FROM tokenized_samples))) GROUP BY batch HAVING count(*) = 64")
def batches_of_an_epoch(spark, d):
    """Sizes of the complete batches of 64 rows."""
    return features.batches(table(spark, d, "tokenized_samples", ["row_id"]), "row_id", 64, epoch=1, drop_last=True).groupBy("batch").agg(F.count("*").alias("n"))


@query("SELECT row_id, array_to_string(list_transform(range(1, len(template_input_ids) + 1), lambda i: CASE WHEN template_input_ids[i] = 103 THEN 200 + ('0x' || substr(md5(row_id || ':f:' || (i - 1)), 1, 8))::BIGINT % 50 ELSE template_input_ids[i] END), ',') AS ids FROM tokenized_samples WHERE template_input_ids IS NOT NULL")
def fill_masks(spark, d):
    """Predicted ids in place of [MASK] only."""
    from ..operators import decide

    rows = spread(table(spark, d, "tokenized_samples", ["row_id", "template_input_ids"])).where("template_input_ids is not null")
    predicted = F.transform("template_input_ids", lambda x, i: 200 + draw(F.col("row_id"), "f", i) % 50)
    return rows.select("row_id", F.array_join(F.transform(decide.filled(F.col("template_input_ids").cast("array<bigint>"), predicted), lambda x: x.cast("string")), ",").alias("ids"))
