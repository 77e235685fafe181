"""Problem 5: values cut off by field limits.

Lengths are recomputed under the encodings a store may have counted in; grouped by source, a limit shows as a length that
stands out. Values at a limit are candidates by that, and endings, learned ones too, and what other records of the sample
hold decide; values cut anywhere are found by the latter alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import let
from ..runtime import spread, table

# Token ids.
PAD, CLS, SEP, MASKED, IGNORE = 0, 101, 102, 103, -100
# An added mark of omission or a broken last character, which a cut may leave.
OMISSION = r"(?:\[(?:\.\.\.|…)\]|[(（](?:\.\.\.|…)[)）]|\s*[(（\[](?:cont|续|未完)[^()（）\[\]]{0,12}[)）\]]?|(?<![…])…|(?<!\.)\.\.\.|�+)\s*$"
CLOSED = r"(?:[。！？!?.…｡।]|[。！？…!?.][”」』\"])\s*$"
# A length stands out if so many values have it, and so many times as many as have each of the lengths below it on average.
MIN_AT_LIMIT, STANDS_OUT, BELOW = 4, 5, 8
# Units in which a limit may fall into a character, so that a cut value is up to three short of it.
BYTES = ["utf8", "gbk", "entities_utf8"]
# An ending without a mark is one of full texts (a title's) if so many values have it and such a share of these end as their source text does.
MIN_ENDING, SHARE_ENDING = 4, 0.8


def lengths(text: Column) -> dict[str, Column]:
    """How long `text` is in each unit a field's limit may count in."""
    chars, utf8 = F.length(text), F.octet_length(text)
    signs = lambda some: chars - F.length(F.translate(text, some, ""))
    wide = F.regexp_count(text, F.lit(r"[^\x00-\x7f]"))
    escaped = 4 * signs("&") + 3 * signs("<>") + 5 * signs("\"'")
    return {
        "chars": chars,
        "utf8": utf8,
        "gbk": chars + wide,
        "utf16": F.octet_length(F.encode(text, "UTF-16BE")),
        "entities": chars + escaped,
        "entities_utf8": utf8 + escaped,
        "json_ascii": chars + 5 * wide + signs("\"\\"),
        "crlf": chars + signs("\n"),
    }


def bare(text: Column) -> Column:
    return F.regexp_replace(text, OMISSION, "")


def _endless(text: Column) -> Column:
    """No sentence: the ending is none, or a quotation is still open."""
    opened = F.length(F.regexp_replace(text, "[^“]", "")) > F.length(F.regexp_replace(text, "[^”]", ""))
    return ~text.rlike(CLOSED) | (opened & text.rlike(r"\p{IsHan}"))


def standing_out(sizes: DataFrame) -> DataFrame:
    """(source, unit, cap, n_at_cap, n_closed, by_chance) of (source, unit, n, closed, rows): the lengths that stand out among the
    values of a source that aren't closed. `by_chance` is how many closed ones at a limit the lengths below it make expect.
    Histograms are summed map-side."""
    n = sizes.groupBy("source", "unit", "n").agg(F.sum(F.when(~F.col("closed"), F.col("rows")).otherwise(0)).alias("k"), F.sum(F.when(F.col("closed"), F.col("rows")).otherwise(0)).alias("c"))
    w = Window.partitionBy("source", "unit").orderBy("n").rangeBetween(-BELOW, -1)
    near = n.select("*", *[(F.coalesce(F.sum(x).over(w), F.lit(0)) / BELOW).alias(f"{x}_below") for x in "kc"])
    out = near.where((F.col("k") >= MIN_AT_LIMIT) & (F.col("k") >= STANDS_OUT * F.col("k_below")))
    return out.select("source", "unit", F.col("n").alias("cap"), (F.col("k") + F.col("c")).alias("n_at_cap"), F.col("c").alias("n_closed"), F.col("c_below").alias("by_chance"))


def hidden_limits(df: DataFrame, source: str, text: str) -> DataFrame:
    """As `standing_out`, of the lengths of a text without added marks in every unit. Null texts count nothing; a null
    source is a source."""
    t = F.col(text)
    rows = df.where(t.isNotNull()).select(F.coalesce(F.col(source), F.lit("")).alias("source"), (~_endless(t)).alias("closed"), bare(t).alias("t"))
    # Rows of one source and length in all units are counted together before units are set apart.
    together = rows.groupBy("source", "closed", F.struct(*[v.alias(k) for k, v in lengths(F.col("t")).items()]).alias("n")).agg(F.count("*").alias("rows"))
    units = F.explode(F.create_map(*[x for k in lengths(t) for x in (F.lit(k), F.col(f"n.{k}"))])).alias("unit", "n")
    return standing_out(together.select("source", "closed", "rows", units))


def title_endings(texts: DataFrame) -> DataFrame:
    """(ending): the last two code points that full texts without a closing mark have, learned from (source_text,
    target_text): cut texts end anywhere, and seldom where their source does."""
    ending = F.right("target_text", F.lit(2))
    rows = texts.where(F.col("source_text").isNotNull() & _endless(F.col("target_text"))).groupBy(ending.alias("ending"))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.right("source_text", F.lit(2)) == F.right("target_text", F.lit(2))).alias("k"))
    return seen.where((F.col("n") >= MIN_ENDING) & (F.col("k") >= SHARE_ENDING * F.col("n"))).select("ending")


def cut_values(inputs: DataFrame, samples: DataFrame, closing: list[int], unknown: int = 100) -> DataFrame:
    """(field, row_id) of the cut values.

    A text at a hidden limit of its source is a candidate by that alone: it is cut if it has no ending, if its source text
    goes on, or if closed texts at this limit are mostly more than chance would have. Any other text is cut if its ending
    is none (neither a mark nor a title's), if a mark of omission was added, if another row or record of its sample holds
    more of it, or if its source text plainly goes on. A vector is cut if
    its text holds more than it, if it breaks off without [SEP] or with [MASK]s left, or if it fills its width without
    an ending. Null texts and vectors are no case; an empty text is one, as it ends nowhere. Rows without a partner are
    judged by themselves. `closing` are the token ids of closing marks, a list bounded by the vocabulary.
    """
    special = [PAD, CLS, SEP]
    ids, labels, template = F.col("input_ids"), F.col("infill_labels"), F.col("template_input_ids")
    words, wanted = F.filter(ids, lambda x: ~x.isin(special)), F.filter(labels, lambda x: x != IGNORE)
    ended = lambda v: F.coalesce(F.element_at(v, -1).isin([*closing, unknown]), F.lit(False))
    filled = lambda v: F.coalesce(F.element_at(v, -1) != PAD, F.lit(False))
    s = samples.select(
        "row_id",
        "sample_id",
        ids.isNotNull().alias("has_ids"),
        labels.isNotNull().alias("has_labels"),
        F.when(ids.isNotNull(), F.size(words)).alias("n_ids"),
        F.array_contains(ids, F.lit(SEP)).alias("sep"),
        (filled(ids) & ~ended(words)).alias("ids_open"),
        F.when(labels.isNotNull(), F.size(wanted)).alias("n_labels"),
        F.when(template.isNotNull(), F.size(F.filter(template, lambda x: x == MASKED))).alias("n_masks"),
        (filled(template) & ~ended(wanted)).alias("labels_open"),
    )
    t, src = F.col("t"), F.col("source_text")
    texts = inputs.select("row_id", "sample_id", "source", "source_text", "target_text", bare(F.col("target_text")).alias("t"))
    per_text = texts.groupBy("sample_id").agg(F.max(F.length(src)).alias("n_source"), F.max(F.length(t)).alias("n_target"))
    per_record = s.groupBy("sample_id").agg(F.max("n_labels").alias("n_full"))
    chance = F.col("by_chance") + 1
    cap = F.struct("unit", "cap", (F.col("n_closed") > 2 * chance + 3 * F.sqrt(chance)).alias("beyond_chance"))
    caps = hidden_limits(inputs, "source", "target_text").groupBy("source").agg(F.collect_list(cap).alias("caps"))
    own = F.create_map(*[x for k, v in lengths(t).items() for x in (F.lit(k), v)])
    near = lambda n, c: (n <= c["cap"]) & (n >= c["cap"] - F.when(c["unit"].isin(BYTES), 3).otherwise(0))
    hit = F.when(F.size("caps") > 0, let(own, lambda n: F.filter("caps", lambda c: near(n[c["unit"]], c))))
    at_limit, beyond = F.size("hit") > 0, F.exists("hit", lambda c: c["beyond_chance"])
    tail = F.levenshtein(F.right(t, F.lit(10)), F.right(src, F.lit(10)))
    goes_on = lambda more, other: F.coalesce(src.rlike(CLOSED) & (F.length(src) - F.length(t) >= more) & (tail >= other), F.lit(False))
    open_end = _endless(F.col("target_text")) & F.col("ending").isNull()
    target = (
        texts.where("target_text is not null")
        .withColumn("source", F.coalesce("source", F.lit("")))
        .join(per_record, "sample_id", "left")
        .join(per_text, "sample_id", "left")
        .join(caps, "source", "left")
        .join(title_endings(inputs), F.right("target_text", F.lit(2)) == F.col("ending"), "left")
        .withColumn("hit", F.coalesce(hit, F.array().cast("array<struct<unit:string,cap:int,beyond_chance:boolean>>")))
        .where(
            F.coalesce(F.length(t) < F.greatest("n_full", "n_target"), F.lit(False))
            | open_end
            | F.col("target_text").rlike(OMISSION)
            | F.when(at_limit, goes_on(3, 6) | (src.isNull() & F.col("ending").isNull() & beyond)).otherwise(goes_on(6, 8))
        )
    )
    vectors = s.join(per_text, "sample_id", "left")
    ids_cut = F.col("has_ids") & (F.coalesce(F.col("n_ids") < F.col("n_source"), F.lit(False)) | ~F.col("sep") | F.col("ids_open"))
    labels_cut = F.col("has_labels") & (
        F.coalesce(F.col("n_labels") < F.col("n_target"), F.lit(False)) | F.coalesce(F.col("n_labels") < F.col("n_masks"), F.lit(False)) | F.col("labels_open")
    )
    found = F.explode(F.filter(F.array(F.when(ids_cut, F.lit("input_ids")), F.when(labels_cut, F.lit("infill_labels"))), lambda x: x.isNotNull()))
    return target.select(F.lit("target_text").alias("field"), "row_id").unionAll(vectors.select(found.alias("field"), "row_id"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[int]]:
    inputs = spread(table(spark, sf_dir, "model_inputs", ["row_id", "sample_id", "source", "source_text", "target_text"]))
    samples = spread(table(spark, sf_dir, "tokenized_samples", ["row_id", "sample_id", "source", "input_ids", "template_input_ids", "infill_labels"]))
    marks = table(spark, sf_dir, "vocab").where(F.col("token").isin(list("。！？!?.…”।"))).collect()  # a few tokens
    return inputs, samples, [r.token_id for r in marks]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(*_tables(spark, sf_dir))


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths that stand out by field, source and unit: hidden limits of target_text, and of the vectors without padding."""
    inputs, samples, _ = _tables(spark, sf_dir)
    source = F.coalesce("source", F.lit("")).alias("source")
    n = lambda c, none: F.size(F.filter(c, lambda x: x != none))
    sizes = lambda c, none: samples.where(F.col(c).isNotNull()).select(source, F.lit("ids").alias("unit"), n(c, none).alias("n"), F.lit(False).alias("closed"), F.lit(1).alias("rows"))
    found = {"target_text": hidden_limits(inputs, "source", "target_text"), "input_ids": standing_out(sizes("input_ids", PAD)), "infill_labels": standing_out(sizes("infill_labels", IGNORE))}
    return reduce(DataFrame.unionAll, [x.select(F.lit(k).alias("field"), "*") for k, x in found.items()])


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, source, n_rows, n_cut): how often each source truncates; null values count as rows."""
    inputs, samples, closing = _tables(spark, sf_dir)
    rows = inputs.select(F.lit("target_text").alias("field"), "row_id", "source").unionAll(samples.select(F.explode(F.array(F.lit("input_ids"), F.lit("infill_labels"))).alias("field"), "row_id", "source"))
    cut = cut_values(inputs, samples, closing).withColumn("cut", F.lit(1))
    return rows.join(cut, ["field", "row_id"], "left").groupBy("field", "source").agg(F.count("*").alias("n_rows"), F.count("cut").alias("n_cut"))


QUERIES = {"p5_found": p5_found, "p5_limits": p5_limits, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
