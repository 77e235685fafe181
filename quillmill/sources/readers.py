"""Readers of pair, clean-text and confusion files. Bad rows are left out, never fatal, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

ANY = "map<string,variant>"


def _first(m: Column, *names: str) -> Column:
    """The first of the names with a value that isn't empty; of a list its first member. A string that begins like a list
    is no list: the values of `m` know their JSON type."""

    def text(n: str) -> Column:
        v = F.try_variant_get(m[n], "$", "string")
        listed = F.schema_of_variant(m[n]).startswith("ARRAY")
        return F.when(v != "", F.when(listed, F.coalesce(F.try_variant_get(m[n], "$[0]", "string"), F.lit(""))).otherwise(v))

    return F.coalesce(*map(text, names))


def _pairs(rows: DataFrame, source: Column, target: Column) -> DataFrame:
    return rows.select(source.alias("source"), target.alias("target")).where("source <> '' and target <> ''")


def _tab(v: Column, i: int) -> Column:
    return F.get(F.split(v, "\t", -1), F.lit(i))


def jsonl_pairs(lines: DataFrame) -> DataFrame:
    """JSON lines with source|src and target|tgt (a list counts by its first member, an empty one as the source); lines that
    aren't JSON objects as two tab-separated columns."""
    v = F.trim("value")
    m = F.when(v.startswith("{"), F.from_json(v, ANY))
    source = _first(m, "source", "src")
    empty = F.coalesce(*[F.when(m[n].isNotNull(), F.schema_of_variant(m[n]) == "ARRAY<VOID>") for n in ("target", "tgt")], F.lit(False))
    target = F.when(empty, source).otherwise(_first(m, "target", "tgt"))
    return _pairs(lines.where(v != ""), F.when(m.isNotNull(), source).otherwise(_tab(v, 0)), F.when(m.isNotNull(), target).otherwise(_tab(v, 1)))


def rejected(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n_lines, n_read, n_rejected): how many lines that aren't blank a reader left out."""
    n = lines.where(F.trim("value") != "").agg(F.count("*").alias("n_lines"))
    return n.join(pairs.agg(F.count("*").alias("n_read"))).select("*", (F.col("n_lines") - F.col("n_read")).alias("n_rejected"))


def labelled_jsonl(lines: DataFrame) -> DataFrame:
    """JSON lines that bring their labels: source, target, op_labels, insert_labels, template_tokens, gold_tokens, mask_positions."""
    ints, strings = ArrayType(IntegerType()), ArrayType(StringType())
    schema = StructType([StructField(n, t) for n, t in (("source", StringType()), ("target", StringType()), ("op_labels", ints), ("insert_labels", ints), ("template_tokens", strings), ("gold_tokens", strings), ("mask_positions", ints))])
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*").where("source <> '' and op_labels is not null and insert_labels is not null")


def tsv_pairs(lines: DataFrame, id_column: bool = False) -> DataFrame:
    """Tab-separated source and target; `id_column` for files with an id in front. Nothing is unquoted."""
    v = F.trim("value")
    return _pairs(lines.where(v != ""), _tab(v, int(id_column)), _tab(v, 1 + int(id_column)))


def mixed_pairs(lines: DataFrame) -> DataFrame:
    """Two tab-separated columns, or JSON with original|src and correct|tgt."""
    v = F.trim("value")
    m = F.from_json(v, ANY)
    tab = F.instr(v, "\t") > 0
    return _pairs(lines.where(v != ""), F.when(tab, _tab(v, 0)).otherwise(_first(m, "original", "src")), F.when(tab, _tab(v, 1)).otherwise(_first(m, "correct", "tgt")))


def document_pairs(docs: DataFrame) -> DataFrame:
    """One JSON document a row: a list of objects, or an object of objects, with source|src|input and target|tgt|output."""
    v = F.trim("value")
    items = F.when(v.startswith("["), F.from_json(v, f"array<{ANY}>")).otherwise(F.map_values(F.from_json(v, f"map<string,{ANY}>")))
    rows = docs.select(F.explode(items).alias("m"))
    return _pairs(rows, _first(F.col("m"), "source", "src", "input"), _first(F.col("m"), "target", "tgt", "output"))


FORMATS = {"mucgec": jsonl_pairs, "sighan": tsv_pairs, "ecspell": mixed_pairs, "parallel": tsv_pairs, "custom": document_pairs}


def read_pairs(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(FORMATS)}")
    return FORMATS[fmt](spark.read.text(path, wholetext=fmt == "custom"), **options)


def read_labelled(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, plain pairs) of a JSON-lines file; with `strict`, plain pairs are dropped if any row is labelled."""
    lines = spark.read.text(path)
    done = labelled_jsonl(lines)
    plain = jsonl_pairs(lines.where(~(F.get_json_object("value", "$.op_labels").isNotNull() & F.get_json_object("value", "$.insert_labels").isNotNull()) | F.get_json_object("value", "$.op_labels").isNull()))
    return done, plain.limit(0) if strict and done.take(1) else plain


def clean_texts(rows: DataFrame, fields: tuple[str, ...] = ("text", "sentence", "content"), strict: bool = False) -> DataFrame:
    """(text): JSON strings, JSON objects by the first field with a value, or the line itself. With `strict` a line that
    begins like an object and is none is an error."""
    v = F.trim("value")
    if strict:
        broken = v.startswith("{") & F.from_json(v, ANY).isNull()
        v = F.when(broken, F.raise_error(F.concat(F.lit("no JSON: "), v))).otherwise(v)
    text = F.when(v.startswith("{"), _first(F.from_json(v, ANY), *fields)).when(v.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0))).otherwise(v)
    return rows.select(F.trim(text).alias("text")).where("text <> ''")


def read_clean(spark: SparkSession, path: str, text_field: str = "text", with_target: bool = False, most: int | None = None) -> DataFrame:
    """txt, jsonl, or json (a list of strings or objects). `most` keeps so many rows, for trials."""
    fields = tuple(dict.fromkeys((text_field, "text", "sentence", "content", *(["target"] if with_target else []))))
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        rows = whole.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    else:
        rows = spark.read.text(path)
    out = clean_texts(rows, fields)
    return out.limit(most) if most else out


def read_sources(spark: SparkSession, path: str, parallel: bool = False) -> DataFrame:
    """Texts to correct: the first column, or the whole line."""
    v = F.trim("value")
    return spark.read.text(path).select((_tab(v, 0) if parallel else v).alias("source")).where("source <> ''")


def read_confusions(spark: SparkSession, path: str, type: str = "custom") -> DataFrame:
    """(char, confusion, type, weight, ord) from JSON (object of lists, list of objects), JSON lines or TSV. A missing file
    has no rows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "char string, confusion string, type string, weight double, ord long")
    obj = "array<struct<char:string,confusions:array<string>,type:string>>"
    if path.endswith(".json"):
        v = F.trim("value")
        whole = spark.read.text(path, wholetext=True)
        as_map = F.transform(F.map_entries(F.from_json(v, "map<string,array<string>>")), lambda e: F.struct(e["key"].alias("char"), e["value"].alias("confusions"), F.lit(None).cast("string").alias("type")))
        rows = whole.select(F.posexplode(F.when(v.startswith("["), F.from_json(v, obj)).otherwise(as_map)).alias("i", "e")).select("i", "e.*")
    elif path.endswith(".jsonl"):
        rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.from_json("value", obj[6:-1]).alias("e")).select("i", "e.*")
    else:
        f = F.split("value", "\t", -1)
        rows = spark.read.text(path).where("trim(value) <> '' and not value like '#%'").select(F.monotonically_increasing_id().alias("i"), F.trim(F.element_at(f, 1)).alias("char"), F.filter(F.slice(f, 2, 1 << 20), lambda x: F.trim(x) != "").alias("confusions"), F.lit(None).cast("string").alias("type"))
    out = rows.where("char <> ''").select("char", F.posexplode("confusions").alias("pos", "confusion"), F.coalesce("type", F.lit(type)).alias("type"), "i")
    return out.select("char", F.trim("confusion").alias("confusion"), "type", F.lit(1.0).alias("weight"), (F.shiftleft("i", 20) + F.col("pos")).alias("ord")).where("confusion <> ''")


def labelled_within(rows: DataFrame, width: int = 128) -> DataFrame:
    """Labelled rows whose source fits, with `edit_distance`, the number of ops that change something."""
    return rows.where((F.length("source") > 0) & (F.length("source") <= width - 2)).withColumn("edit_distance", F.size(F.filter("op_labels", lambda x: x != 0)))


def within_limits(pairs: DataFrame, width: int = 128) -> DataFrame:
    """Pairs with both texts not empty and at most width - 2 code points."""
    return pairs.where((F.length("source") > 0) & (F.length("target") > 0) & (F.length("source") <= width - 2) & (F.length("target") <= width - 2))


def fit_for_training(texts: DataFrame, width: int = 128, least: int = 5) -> DataFrame:
    return texts.where(F.length("text").between(least, width - 10))
