"""The core's queries and their SQL, by name. Every query runs over its whole tables and whole texts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws, normalize, protect, segment
from ..functions.draws import draw
from ..operators import align, confusion, corrupt, decide, features, labels, stats
from ..runtime import checkpoint_dir, checkpointed, spread, table
from ..sources import readers
from ..streaming import stream
from . import files, golden, pipeline
from .config import DecisionSettings, FeatureSettings, Settings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _sql_draw(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", ["doc_id", "text"]))


def _sents(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "sentences", ["seg_id", "text", *more]))


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def _sql_case(value: str, probabilities: list[float], outcomes: list) -> str:
    upto, out = 0.0, ""
    for p, o in list(zip(probabilities, outcomes))[:-1]:
        upto += p
        out += f" WHEN {value} < {int(upto * draws.SPAN)} THEN {o!r}"
    return f"CASE{out} ELSE {outcomes[-1]!r} END"


# ---- draws and text


@query(f"SELECT doc_id, {_sql_draw('42', '0', 'doc_id', chr(39) + 'u' + chr(39))} AS u FROM documents")
def hash_uniform(spark, d):
    return _docs(spark, d).select("doc_id", draw(42, 0, F.col("doc_id"), "u").alias("u"))


_STRIP = rf"^{normalize.BLANK}+|{normalize.BLANK}+$"
_TIDY = rf"array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), chr(10))"


@query(f"SELECT doc_id, {_TIDY} AS text FROM documents")
def normalize_whitespace(spark, d):
    return _docs(spark, d).select("doc_id", normalize.tidy_lines(F.col("text")).alias("text"))


_FROM, _TO = normalize.width_table()


@query(f"SELECT doc_id, translate(text, '{_FROM}', '{_TO.replace(chr(39), chr(39) * 2)}') AS text FROM documents")
def fullwidth_translate(spark, d):
    return _docs(spark, d).select("doc_id", normalize.half_width(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(text, '{normalize.INVISIBLE}', '', 'g') AS text FROM documents")
def remove_invisible(spark, d):
    return _docs(spark, d).select("doc_id", normalize.without_invisible(F.col("text")).alias("text"))


@query()
def nfkc(spark, d):
    return _docs(spark, d).select("doc_id", normalize.compatibility_form(F.col("text")).alias("text"))


@query()
def normalize_all(spark, d):
    return _docs(spark, d).select("doc_id", normalize.normalize(F.col("text")).alias("text"))


@query("SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 5 AND 118")
def filter_length(spark, d):
    return readers.fit_for_training(_docs(spark, d))


@query("SELECT row_id, source_text AS source, target_text AS target FROM model_inputs WHERE length(source_text) BETWEEN 1 AND 38 AND length(target_text) BETWEEN 1 AND 38")
def pairs_within_limits(spark, d):
    return readers.within_limits(_pairs(spark, d).withColumnsRenamed({"source_text": "source", "target_text": "target"}), 40)


# ---- segmentation

_LINES = """
lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS text, (SELECT coalesce(sum(length(x) + 1), 0) FROM unnest(l[1:i - 1]) t(x))::BIGINT AS start
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"""


@query(f"WITH {_LINES} SELECT doc_id, line_no::BIGINT AS line_no, text, start, (start + length(text))::BIGINT AS \"end\" FROM lines WHERE text <> ''")
def split_newline_offsets(spark, d):
    return segment.split_lines(_docs(spark, d), "doc_id", "text").select("doc_id", F.col("line_no").cast("long"), "text", F.col("start").cast("long"), F.col("end").cast("long"))


def _sql_pieces(pattern: str) -> str:
    return f"""
pieces AS (SELECT doc_id, line_no, i - 1 AS piece_no, m[i] AS text, start + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
           FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, list_filter(regexp_extract_all(text, '{pattern}'), lambda x: length(x) > 0) AS m FROM lines WHERE text <> '')))"""


_PLAIN, _QUOTED = r"[^。！？；]*(?:[。！？；]|$)", r'(?:[^"「『。！？；]+|["「『][^"」』]*(?:["」』]|$))*(?:[。！？；]|$)'
_PIECES = "SELECT doc_id, line_no::BIGINT AS line_no, piece_no::BIGINT AS piece_no, text, start::BIGINT AS start, (start + length(text))::BIGINT AS \"end\" FROM pieces"


def _pieces(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("line_no").cast("long"), F.col("piece_no").cast("long"), "text", F.col("start").cast("long"), F.col("end").cast("long"))


@query(f"WITH {_LINES}, {_sql_pieces(_QUOTED)} {_PIECES}")
def split_sentences(spark, d):
    return _pieces(segment.split_sentences(_docs(spark, d), "doc_id", "text"))


@query(f"WITH {_LINES}, {_sql_pieces(_PLAIN)} {_PIECES}")
def split_sentences_plain(spark, d):
    return _pieces(segment.split_sentences(_docs(spark, d), "doc_id", "text", quotes=False))


@query()
def split_long(spark, d):
    return segment.split_long(segment.split_sentences(_docs(spark, d), "doc_id", "text"))


@query(
    f"""WITH {_LINES}, {_sql_pieces(_QUOTED)},
g AS (SELECT *, sum(CASE WHEN length(text) >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, piece_no ROWS UNBOUNDED PRECEDING) AS grp FROM pieces)
SELECT doc_id, (grp - 1)::BIGINT AS sentence_id, string_agg(text, '' ORDER BY line_no, piece_no) AS text, min(start)::BIGINT AS original_start,
       (min(start) + sum(length(text)))::BIGINT AS original_end
FROM g WHERE grp > 0 GROUP BY doc_id, grp"""
)
def merge_short(spark, d):
    out = segment.merge_short(segment.split_sentences(_docs(spark, d), "doc_id", "text"), "doc_id", ["line_no", "piece_no"])
    return out.select("doc_id", F.col("sentence_id").cast("long"), "text", F.col("original_start").cast("long"), F.col("original_end").cast("long"))


@query()
def processed_sentences(spark, d):
    return segment.processed_sentences(_docs(spark, d), "doc_id", "text")


def _pairs(spark, d):
    return spread(table(spark, d, "model_inputs", ["row_id", "source_text", "target_text"])).where("source_text is not null and target_text is not null")


_CUT = f"list_filter(regexp_extract_all({{c}}, '{_QUOTED}'), lambda x: length(x) > 0)"


@query(
    f"""WITH p AS (SELECT row_id, source_text AS s, target_text AS t, {_CUT.format(c='source_text')} AS a, {_CUT.format(c='target_text')} AS b
FROM model_inputs WHERE source_text IS NOT NULL AND target_text IS NOT NULL),
q AS (SELECT *, abs(length(s) - length(t)) <= 0.2 * length(s) AND len(a) = len(b) AS zip FROM p)
SELECT row_id, (i - 1)::BIGINT AS pair_no, CASE WHEN zip THEN a[i] ELSE s END AS source, CASE WHEN zip THEN b[i] ELSE t END AS target
FROM (SELECT *, unnest(range(1, CASE WHEN zip THEN len(a) ELSE 1 END + 1)) AS i FROM q)"""
)
def split_parallel(spark, d):
    return segment.split_parallel(_pairs(spark, d), "row_id", "source_text", "target_text").select("row_id", F.col("pair_no").cast("long"), "source", "target")


# ---- protected spans


def _sql_spans(family: str, table_: str = "documents", key: str = "doc_id", patterns: list[str] | None = None) -> str:
    one = lambda p: f"""SELECT {key}, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, m[i] AS text
FROM (SELECT {key}, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS s FROM {table_}))"""  # noqa: E731
    return " UNION ALL ".join(one(p) for p in patterns or protect.PATTERNS[family])


def _spans(spark, d, family):
    rows = protect.detect(_sents(spark, d), "seg_id", "text", [family])
    return rows.select("seg_id", F.col("start").cast("long"), F.col("end").cast("long"), "text")


def _span_query(family: str) -> str:
    return f"SELECT seg_id, start::BIGINT AS start, (start + length(text))::BIGINT AS \"end\", text FROM ({_sql_spans(family, 'sentences', 'seg_id')})"


@query(_span_query("amount"))
def spans_amount(spark, d):
    return _spans(spark, d, "amount")


@query(_span_query("date"))
def spans_date(spark, d):
    return _spans(spark, d, "date")


@query(f"SELECT doc_id, start::BIGINT AS start, (start + length(text))::BIGINT AS \"end\", text FROM ({_sql_spans('clause')})")
def spans_clause(spark, d):
    rows = protect.detect(_docs(spark, d), "doc_id", "text", ["clause"])
    return rows.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), "text")


def _planted(text: Column) -> Column:
    """Texts with a document number, a set phrase and a law's name at places by the row's id."""
    k = (F.col("seg_id") % 9).cast("int")
    n = (F.col("seg_id") % 90 + 1).cast("string")
    return F.concat(F.substring(text, F.lit(1), k), F.lit("，国办发〔2024〕"), n, F.lit("号，按照《条例》规定，现将方案印发如下：见《劳动法》和城市管理条例。"), F.substring(text, k + 1, F.length(text)))


_PLANTED = "(SELECT seg_id, substr(text, 1, (seg_id % 9)::INTEGER) || '，国办发〔2024〕' || (seg_id % 90 + 1) || '号，按照《条例》规定，现将方案印发如下：见《劳动法》和城市管理条例。' || substr(text, (seg_id % 9)::INTEGER + 1) AS text FROM sentences)"


def _planted_spans(spark, d, family):
    rows = protect.detect(_sents(spark, d).withColumn("text", _planted(F.col("text"))), "seg_id", "text", [family])
    return rows.select("seg_id", F.col("start").cast("long"), F.col("end").cast("long"), "text")


def _planted_query(family: str) -> str:
    return f"SELECT seg_id, start::BIGINT AS start, (start + length(text))::BIGINT AS \"end\", text FROM ({_sql_spans(family, _PLANTED, 'seg_id')})"


@query(_planted_query("doc_number"))
def spans_doc_number(spark, d):
    return _planted_spans(spark, d, "doc_number")


@query(_planted_query("fixed_phrase"))
def spans_fixed_phrase(spark, d):
    return _planted_spans(spark, d, "fixed_phrase")


# A name without marks ends where its run of ideographs does, and not in front of a closing title mark: runs are taken whole.
_RUNS = _sql_spans("", _PLANTED, "seg_id", [r"[一-龥]+》?"])


@query(
    f"""SELECT seg_id, start::BIGINT AS start, (start + length(text))::BIGINT AS "end", text FROM (
{_sql_spans('', _PLANTED, 'seg_id', protect.PATTERNS['law_name'][:1])} UNION ALL SELECT * FROM ({_RUNS}) WHERE regexp_full_match(text, '[一-龥]{{2,}}(?:法|条例|规定|办法)'))"""
)
def spans_law_name(spark, d):
    return _planted_spans(spark, d, "law_name")


@query(f"SELECT seg_id, start::BIGINT AS start, (start + length(text))::BIGINT AS \"end\", text FROM ({_sql_spans('', 'sentences', 'seg_id', [protect.ORGANIZATION])}) WHERE length(text) >= 3")
def spans_organization(spark, d):
    return _spans(spark, d, "organization")


@query()
def spans_all(spark, d):
    return protect.merge_spans(protect.detect(_sents(spark, d), "seg_id", "text", "default", words=["管理员"], patterns=["[A-Z][A-Za-z]-[0-9]+"]), "seg_id")


@query("SELECT doc_id, i::BIGINT AS start, (i + 2)::BIGINT AS \"end\" FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 2, 0) + 1)) AS i FROM documents WHERE text IS NOT NULL) WHERE substr(text, i + 1, 2) = '！！'")
def spans_custom_words(spark, d):
    rows = protect.detect(_docs(spark, d), "doc_id", "text", [], words=["！！"])
    return rows.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"))


# Families with SQL, and their spans merged: of a run of overlapping ones the first's type, and the largest confidence of those
# that reach further than all before.
_FAMILIES = ["doc_number", "date", "amount", "clause", "fixed_phrase", "organization"]
_TYPED = " UNION ALL ".join(
    f"SELECT seg_id, start, start + length(text) AS e, '{k}' AS type, {0.8 if k == 'organization' else 1.0}::DOUBLE AS confidence FROM ({_sql_spans(k, 'sentences', 'seg_id', [protect.ORGANIZATION] if k == 'organization' else None)}) WHERE length(text) >= {3 if k == 'organization' else 1}"
    for k in _FAMILIES
)
_ORDER = "PARTITION BY seg_id ORDER BY start, e DESC, confidence DESC, type"
_MERGED = f"""s AS ({_TYPED}),
r AS (SELECT *, max(e) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER ({_ORDER}) AS no FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY seg_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS grp FROM r),
merged AS (SELECT seg_id, min(start) AS start, max(e) AS e, arg_min(type, no) AS type, max(confidence) FILTER (reach IS NULL OR e > reach) AS confidence FROM g GROUP BY seg_id, grp)"""


@query(
    f"""WITH {{spans}} SELECT seg_id, start::BIGINT AS start, e::BIGINT AS "end", type, confidence FROM merged""".replace("{spans}", _MERGED)
)
def merge_spans(spark, d):
    rows = protect.merge_spans(protect.detect(_sents(spark, d), "seg_id", "text", _FAMILIES), "seg_id")
    return rows.select("seg_id", F.col("start").cast("long"), F.col("end").cast("long"), "type", "confidence")


_FIXED = r"(?s)[\x{00}。，、；：？！\"【】《》（）—…·「」『』〈〉〔〕\p{Z}\s\x{0B}\x{1C}-\x{1F}]"


_FREE = f"list_filter(range(0, length(text)), lambda i: NOT regexp_full_match(substr(text, i + 1, 1), '{_FIXED}'))"


@query(f"SELECT seg_id, array_to_string({_FREE}, ',') AS free FROM sentences WHERE text IS NOT NULL")
def editable_positions(spark, d):
    return _sents(spark, d).where("text is not null").select("seg_id", _joined(protect.editable_positions(F.col("text"))).alias("free"))


@query(f"WITH {_MERGED}, n AS (SELECT seg_id, sum(e - start) AS n FROM merged GROUP BY seg_id) SELECT s.seg_id, round(coalesce(n, 0) / length(text), 9)::DOUBLE AS share FROM sentences s LEFT JOIN n ON s.seg_id = n.seg_id WHERE length(text) > 0")
def protected_coverage(spark, d):
    """Share of each row's code points that stand in a protected span."""
    rows = _sents(spark, d)
    merged = protect.merge_spans(protect.detect(rows, "seg_id", "text", _FAMILIES), "seg_id").groupBy("seg_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    return rows.where("length(text) > 0").join(merged, "seg_id", "left").select("seg_id", F.round(F.coalesce("n", F.lit(0)) / F.length("text"), 9).alias("share"))


_TAGS = f"""WITH {_MERGED}, o AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY seg_id ORDER BY start) AS before FROM merged)
SELECT s.seg_id, string_agg(substr(text, (before + 1)::INTEGER, (start - before)::INTEGER) || '<' || type || '>' || substr(text, (start + 1)::INTEGER, (e - start)::INTEGER) || '</' || type || '>', '' ORDER BY start) || substr(any_value(text), (max(e) + 1)::INTEGER) AS tagged
FROM sentences s JOIN o ON s.seg_id = o.seg_id GROUP BY s.seg_id"""


@query(_TAGS)
def tagged_spans(spark, d):
    """Texts with their protected spans in tags."""
    rows = _sents(spark, d).where("text is not null")
    merged = protect.merge_spans(protect.detect(rows, "seg_id", "text", _FAMILIES), "seg_id").groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("spans"))
    return rows.join(merged, "seg_id").select("seg_id", protect.tagged(F.col("text"), F.col("spans")).alias("tagged"))


# ---- confusion sets


def _conf(spark, d):
    return confusion.pairs_from_entries(table(spark, d, "confusion_entries"))


_CPAIRS = """cp AS (SELECT char, c AS confusion, confusion_type AS type, entry_id * 1048576 + i - 1 AS ord
FROM (SELECT entry_id, char, confusion_type, confusions[i] AS c, i FROM (SELECT *, unnest(range(1, len(confusions) + 1)) AS i FROM confusion_entries WHERE char IS NOT NULL)) WHERE c IS NOT NULL)"""
_LOOK = "SELECT char, {0} AS confusions FROM (SELECT char, list(confusion ORDER BY ord) AS l FROM (SELECT char, confusion, min(ord) AS ord FROM cp GROUP BY char, confusion) GROUP BY char)"


@query(f"WITH {_CPAIRS} {_LOOK.format('array_to_string(l, chr(44))')}")
def confusion_lookup(spark, d):
    return confusion.lookup(_conf(spark, d)).select("char", F.array_join("confusions", ",").alias("confusions"))


@query(f"WITH {_CPAIRS} {_LOOK.format('array_to_string(l[1:2], chr(44))')}")
def confusion_top_n(spark, d):
    return confusion.lookup(_conf(spark, d), most=2).select("char", F.array_join("confusions", ",").alias("confusions"))


@query(f"WITH {_CPAIRS} SELECT coalesce(type, 'none') AS type, count(*)::BIGINT AS n_pairs, count(DISTINCT char)::BIGINT AS n_chars FROM cp GROUP BY coalesce(type, 'none') UNION ALL SELECT NULL, count(*)::BIGINT, count(DISTINCT char)::BIGINT FROM cp")
def confusion_stats(spark, d):
    return confusion.stats(_conf(spark, d))


@query(f"WITH {_CPAIRS} SELECT char, confusion FROM cp WHERE type = 'shape' UNION SELECT char, confusion FROM cp WHERE type = 'pinyin'")
def confusion_merge(spark, d):
    p = _conf(spark, d)
    return confusion.merge(p.where("type = 'shape'"), p.where("type = 'pinyin'"))


_CHARS = "ch AS (SELECT c AS char, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM sentences) WHERE c <> '' GROUP BY c)"


def _chars(spark, d):
    return _sents(spark, d).select(F.explode(F.split("text", "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))


@query(f"WITH {_CHARS} SELECT * FROM ch WHERE char IN (SELECT char FROM confusion_entries WHERE char IS NOT NULL)")
def confusable_chars_semi(spark, d):
    return _chars(spark, d).join(_conf(spark, d).select("char").union(table(spark, d, "confusion_entries", ["char"])).where("char is not null").distinct(), "char", "left_semi")


@query(f"WITH {_CHARS} SELECT * FROM ch WHERE char NOT IN (SELECT char FROM confusion_entries WHERE char IS NOT NULL)")
def unconfusable_chars_anti(spark, d):
    return _chars(spark, d).join(table(spark, d, "confusion_entries", ["char"]).where("char is not null").distinct(), "char", "left_anti")


# ---- error injection

_POISSON = draws.truncated_poisson(1.5, 4)


@query(f"SELECT seg_id, ({_sql_case(_sql_draw('42', '0', 'seg_id', chr(39) + 'n' + chr(39)), _POISSON, [1, 2, 3, 4])})::BIGINT AS n FROM sentences")
def poisson_edits(spark, d):
    return _sents(spark, d).select("seg_id", corrupt.n_edits(draw(42, 0, F.col("seg_id"), "n")).cast("long").alias("n"))


@query("SELECT seg_id, round(CASE WHEN length(text) <= 20 THEN 1.0 WHEN length(text) >= 80 THEN 3.0 ELSE 1.0 + (length(text) - 20) / 60.0 * 2.0 END, 6)::DOUBLE AS rate, round(greatest(1.0, length(text) * 0.05), 6)::DOUBLE AS by_ratio FROM sentences WHERE text IS NOT NULL")
def length_lambda(spark, d):
    n = F.length("text")
    return _sents(spark, d).where("text is not null").select("seg_id", F.round(draws.length_rate(n), 6).alias("rate"), F.round(draws.ratio_rate(n), 6).alias("by_ratio"))


@query(f"SELECT kind, count(*)::BIGINT AS n FROM (SELECT {_sql_case(_sql_draw('42', '0', 'seg_id', chr(39) + 'kind' + chr(39)), [0.2, 0.3, 0.5], ['S', 'M', 'R'])} AS kind FROM sentences) GROUP BY kind")
def error_type_draw(spark, d):
    return _sents(spark, d).select(corrupt.error_kind(draw(42, 0, F.col("seg_id"), "kind")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_POS = _sql_draw("42", "0", "seg_id", "'at'") + " % length(text)"


@query(
    f"""SELECT seg_id, p::BIGINT AS position, k AS type, CASE WHEN k = 'S' THEN substr(text, 1, p) || substr(text, p + 2) ELSE substr(text, 1, p + 1) || repeat(substr(text, p + 1, 1), 1) || substr(text, p + 2) END AS corrupted
FROM (SELECT seg_id, text, ({_POS})::INTEGER AS p, {_sql_case(_sql_draw('42', '0', 'seg_id', "'kind'"), [0.4, 0.6], ['S', 'M'])} AS k FROM sentences WHERE length(text) >= 5)"""
)
def corrupt_one(spark, d):
    """One deleted or repeated character per text, at a drawn place."""
    rows = _sents(spark, d).where("length(text) >= 5")
    p = (draw(42, 0, F.col("seg_id"), "at") % F.length("text")).cast("int")
    k = draws.by_thresholds(draw(42, 0, F.col("seg_id"), "kind"), [0.4, 0.6], ["S", "M"])
    t, one = F.col("text"), lambda: F.substring("text", p + 1, F.lit(1))
    made = F.when(k == "S", F.concat(F.substring(t, F.lit(1), p), F.substring(t, p + 2, F.length(t)))).otherwise(F.concat(F.substring(t, F.lit(1), p + 1), one(), F.substring(t, p + 2, F.length(t))))
    return rows.select("seg_id", p.cast("long").alias("position"), k.alias("type"), made.alias("corrupted"))


def _sql_corrupt(rows: str, key: str, most: int, wanted: str, kind: str | None = None, free: str = _FREE) -> str:
    """CTEs of rows (key, text, ...) to `made` (key, text, corrupted, edits): places drawn one after the other from what is left,
    edits by draws and confusions. `kind` fixes the kind of the one edit."""
    u = lambda *slot: _sql_draw("'42'", "'0'", key, *slot)
    steps = [f"c0 AS (SELECT *, {wanted} AS wanted, {free} AS r0 FROM {rows})"]
    for n in range(most):
        steps.append(f"q{n} AS (SELECT *, CASE WHEN wanted > {n} AND len(r{n}) > 0 THEN r{n}[({u(chr(39) + 'at' + chr(39), str(n))} % len(r{n}) + 1)::INTEGER] END AS p{n} FROM c{n})")
        steps.append(f"c{n + 1} AS (SELECT *, CASE WHEN p{n} IS NULL THEN r{n} ELSE list_filter(r{n}, lambda x: x <> p{n}) END AS r{n + 1} FROM q{n})")
    places = ", ".join(f"p{n}" for n in range(most))
    kind = kind or _sql_case(u("'kind'", "p"), [0.2, 0.3, 0.5], ["S", "M", "R"])
    return f"""{_CPAIRS}, conf AS (SELECT char, list(confusion ORDER BY ord) AS l FROM (SELECT char, confusion, min(ord) AS ord FROM cp GROUP BY char, confusion) GROUP BY char),
{", ".join(steps)},
chosen AS (SELECT * FROM (SELECT *, unnest([{places}]) AS p FROM c{most}) WHERE p IS NOT NULL),
kinds AS (SELECT chosen.*, substr(text, (p + 1)::INTEGER, 1) AS original, {kind} AS k, l FROM chosen LEFT JOIN conf ON conf.char = substr(text, (p + 1)::INTEGER, 1)),
typed AS (SELECT *, CASE WHEN k = 'R' AND l IS NULL THEN 'M' ELSE k END AS type FROM kinds),
edited AS (SELECT *, CASE type WHEN 'S' THEN '' WHEN 'M' THEN repeat(original, ({u("'k'", "p")} % 3 + 1)::INTEGER) ELSE l[({u("'pick'", "p")} % len(l) + 1)::INTEGER] END AS error FROM typed),
chars AS (SELECT {key}, text, unnest(range(0, length(text))) AS i FROM {rows} WHERE length(text) > 0),
bodies AS (SELECT chars.{key}, string_agg(CASE WHEN e.p IS NULL THEN substr(text, (i + 1)::INTEGER, 1) WHEN e.type = 'S' THEN '' WHEN e.type = 'M' THEN e.original || e.error ELSE e.error END, '' ORDER BY i) AS corrupted
           FROM chars LEFT JOIN (SELECT {key} AS ek, p, type, original, error FROM edited) e ON chars.{key} = e.ek AND chars.i = e.p GROUP BY chars.{key}),
lists AS (SELECT {key}, list({{'position': p::INTEGER, 'type': type, 'original': original, 'error': error}} ORDER BY p) AS edits FROM edited GROUP BY {key}),
made AS (SELECT r.*, coalesce(bodies.corrupted, r.text) AS corrupted, coalesce(lists.edits, []) AS edits FROM {rows} r LEFT JOIN bodies ON r.{key} = bodies.{key} LEFT JOIN lists ON r.{key} = lists.{key})"""


_GATE = f"CASE WHEN length(text) >= 5 AND {_sql_draw(chr(39) + '42' + chr(39), chr(39) + '0' + chr(39), '{key}', chr(39) + 'gate' + chr(39))} < {int(0.7 * draws.SPAN)} THEN {{n}} ELSE 0 END"
_COUNT = _sql_case(_sql_draw("'42'", "'0'", "seg_id", "'n'"), _POISSON, [1, 2, 3, 4])
_SHOWN = "array_to_string(list_transform(edits, lambda e: e.position || ':' || e.type || ':' || e.original || '>' || e.error), '|')"


def _shown(edits: Column) -> Column:
    return F.array_join(F.transform(edits, lambda e: F.concat(e["position"].cast("string"), F.lit(":"), e["type"], F.lit(":"), e["original"], F.lit(">"), e["error"])), "|")


@query(f"WITH {_sql_corrupt('sentences', 'seg_id', 4, _GATE.format(key='seg_id', n=_COUNT))} SELECT seg_id, corrupted, len(edits) > 0 AS is_corrupted, len(edits)::BIGINT AS num_edits, {_SHOWN} AS edits FROM made")
def corrupt_multi(spark, d):
    rows = corrupt.corrupt(_sents(spark, d), "seg_id", "text", confusion.lookup(_conf(spark, d)))
    return rows.select("seg_id", "corrupted", "is_corrupted", F.col("num_edits").cast("long").alias("num_edits"), _shown(F.col("edits")).alias("edits"))


_OUTSIDE = f"list_filter({_FREE}, lambda i: NOT list_bool_or(list_append(list_transform(coalesce(spans, []), lambda z: i >= z.a AND i < z.b), false)))"


@query(
    f"""WITH {_MERGED}, sp AS (SELECT seg_id, list({{'a': start, 'b': e}}) AS spans FROM merged GROUP BY seg_id), base AS (SELECT s.seg_id, s.text, sp.spans FROM sentences s LEFT JOIN sp ON s.seg_id = sp.seg_id),
{_sql_corrupt('base', 'seg_id', 4, _GATE.format(key='seg_id', n=_COUNT), free=_OUTSIDE)} SELECT seg_id, corrupted, len(edits)::BIGINT AS num_edits FROM made"""
)
def corrupt_protected(spark, d):
    """Errors outside protected spans only."""
    rows = _sents(spark, d)
    spans = protect.merge_spans(protect.detect(rows, "seg_id", "text", _FAMILIES), "seg_id").groupBy("seg_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    with_spans = rows.join(spans, "seg_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    out = corrupt.corrupt(with_spans, "seg_id", "text", confusion.lookup(_conf(spark, d)), spans="spans")
    return out.select("seg_id", "corrupted", F.col("num_edits").cast("long").alias("num_edits"))


_ORDERED = "list_transform(list_sort([" + ", ".join(f"{{'r': -ln(({_sql_draw(chr(39) + '42' + chr(39), chr(39) + '0' + chr(39), 'seg_id', chr(39) + 'order' + chr(39), chr(39) + k + chr(39))} + 0.5) / {draws.SPAN}) / {w}, 'k': '{k}'}}" for k, w in zip("SMR", (0.2, 0.3, 0.5))) + "]), lambda x: x.k)"
_KINDS = f"base AS (SELECT seg_id * 3 + v AS id, text, CASE WHEN v > 0 THEN {_ORDERED}[v] END AS kind, seg_id, heads FROM sentences, (SELECT unnest([0, 1, 2]) AS v), (SELECT list(DISTINCT char) AS heads FROM (SELECT char, unnest(confusions) AS c FROM confusion_entries WHERE char IS NOT NULL) WHERE c IS NOT NULL) WHERE length(text) BETWEEN 5 AND 118)"
_POOL = f"coalesce(CASE WHEN kind = 'R' THEN nullif(list_filter({_FREE}, lambda i: list_contains(heads, substr(text, i + 1, 1))), []) END, {_FREE})"


def _typed(spark, d) -> DataFrame:
    rows = _sents(spark, d).where("length(text) between 5 and 118").select(F.col("seg_id").alias("id"), "text", F.explode(F.array(*map(F.lit, range(3)))).alias("variant"))
    rows = rows.withColumn("id", F.col("id") * 3 + F.col("variant"))
    negative = rows.where("variant > 0").withColumn("kind", F.get(corrupt.kinds_in_order(F.floor(F.col("id") / 3)), F.col("variant") - 1))
    return corrupt.corrupt_typed(negative, "id", "text", "kind", confusion.lookup(_conf(spark, d))), rows


@query(f"WITH {_KINDS}, {_sql_corrupt('base', 'id', 1, 'CASE WHEN kind IS NULL THEN 0 ELSE 1 END', 'kind', _POOL)} SELECT id, corrupted, {_SHOWN} AS edits FROM made WHERE kind IS NOT NULL")
def corrupt_with_kind(spark, d):
    """Two edits of distinct kinds, each in a copy of the text; a replaced character is one with confusions where there is any."""
    return _typed(spark, d)[0].select("id", "corrupted", _shown(F.col("edits")).alias("edits"))


@query(f"SELECT seg_id, array_to_string({_ORDERED}, '') AS kinds FROM sentences")
def kinds_in_order(spark, d):
    """All kinds, drawn by weight without replacement."""
    return _sents(spark, d).select("seg_id", F.array_join(corrupt.kinds_in_order(F.col("seg_id")), "").alias("kinds"))


_SPLIT = _sql_case(_sql_draw("'42'", "seg_id", "'split'"), [0.8, 0.1, 0.1], ["train", "dev", "test"])


@query(
    f"""WITH {_KINDS}, {_sql_corrupt('base', 'id', 1, 'CASE WHEN kind IS NULL THEN 0 ELSE 1 END', 'kind', _POOL)},
{{direct}} SELECT b.id, coalesce(x.s, b.text) AS corrupted, b.text, coalesce(x.ops, array_to_string(list_transform(range(0, length(b.text)), lambda i: 0), ',')) AS ops,
coalesce(x.inserts, array_to_string(list_transform(range(0, length(b.text)), lambda i: 0), ',')) AS inserts, coalesce(x.template, b.text) AS template, coalesce(x.gold, '') AS gold, {_SPLIT} AS split
FROM base b LEFT JOIN labelled x ON b.id = x.row_id WHERE b.kind IS NULL OR x.row_id IS NOT NULL"""
)
def static_samples(spark, d):
    """One positive and two negatives per text, of two kinds drawn without replacement, each with one edit and labels straight
    from it."""
    made, rows = _typed(spark, d)
    made = made.where("is_corrupted").withColumn("e", F.get("edits", F.lit(0)))
    both = made.select("id", "text", "corrupted", "e").unionByName(rows.where("variant = 0").select("id", "text", F.col("text").alias("corrupted"), F.lit(None).cast(made.schema["e"].dataType).alias("e")))
    out = labels.direct_labels(both, "corrupted", "e").withColumn("split", corrupt.split_of(draw(42, F.floor(F.col("id") / 3), "split")))
    return out.select("id", "corrupted", "text", _joined(F.col("op_labels")).alias("ops"), _joined(F.col("insert_labels")).alias("inserts"), F.array_join("template_tokens", "").alias("template"), F.array_join("gold_tokens", "").alias("gold"), "split")


@query(f"SELECT doc_id, {_sql_case(_sql_draw('42', 'doc_id', chr(39) + 'split' + chr(39)), [0.8, 0.1, 0.1], ['train', 'dev', 'test'])} AS split FROM documents")
def split_train_dev_test(spark, d):
    return _docs(spark, d).select("doc_id", corrupt.split_of(draw(42, F.col("doc_id"), "split")).alias("split"))


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_sql_draw('42', 'doc_id')}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM r""")
def split_exact(spark, d):
    return corrupt.exact_split(table(spark, d, "documents", ["doc_id"]), "doc_id")


@query(f"SELECT doc_id, epoch::BIGINT AS epoch, ({_sql_case(_sql_draw('42', 'epoch', 'doc_id', chr(39) + 'n' + chr(39)), _POISSON, [1, 2, 3, 4])})::BIGINT AS n FROM documents, (SELECT unnest([0, 1, 2]) AS epoch)")
def epoch_resample(spark, d):
    rows = table(spark, d, "documents", ["doc_id"]).select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("epoch"))
    return rows.select("doc_id", F.col("epoch").cast("long"), corrupt.n_edits(draw(42, F.col("epoch"), F.col("doc_id"), "n")).cast("long").alias("n"))


@query(f"SELECT seg_id, text FROM sentences WHERE length(text) BETWEEN 5 AND 118 ORDER BY {_sql_draw('42', 'seg_id', chr(39) + 'dev' + chr(39))}, seg_id LIMIT 100")
def frozen_dev_sample(spark, d):
    """A sampling operator: the 100 rows with the lowest draws."""
    return readers.fit_for_training(_sents(spark, d)).orderBy(draw(42, F.col("seg_id"), "dev"), "seg_id").limit(100)


# ---- alignment, labels, templates


@query("SELECT row_id, levenshtein(source_text, target_text)::BIGINT AS distance FROM model_inputs WHERE regexp_full_match(source_text, '[\\x00-\\x7f]*') AND regexp_full_match(target_text, '[\\x00-\\x7f]*')")
def edit_distance(spark, d):
    plain = r"\A[\x00-\x7f]*\z"
    return _pairs(spark, d).where(F.col("source_text").rlike(plain) & F.col("target_text").rlike(plain)).select("row_id", F.levenshtein("source_text", "target_text").cast("long").alias("distance"))


@query()
def edit_distance_all(spark, d):
    """The edit distance in code points of all pairs, in any script. DuckDB's levenshtein counts bytes: `edit_distance` keeps
    to the pairs for which this is the same."""
    return _pairs(spark, d).select("row_id", F.levenshtein("source_text", "target_text").cast("long").alias("distance"))


def _aligned(spark, d, mode="minimal"):
    return align.align(_pairs(spark, d), "source_text", "target_text", mode)


@query()
def align_ops(spark, d):
    return _aligned(spark, d).select("row_id", F.explode(F.filter("ops", lambda o: o["op_type"] != 0)).alias("o")).select("row_id", "o.*")


@query()
def align_blocks(spark, d):
    return _aligned(spark, d, "blocks").select("row_id", "edit_distance")


@query("SELECT row_id, true AS ok FROM model_inputs WHERE source_text IS NOT NULL AND target_text IS NOT NULL")
def align_verify(spark, d):
    """Whether the ops make the target, by a script no longer than the edit distance."""
    return _aligned(spark, d).select("row_id", ((align.applied(F.col("ops")) == F.col("target_text")) & (F.col("edit_distance") == F.levenshtein("source_text", "target_text"))).alias("ok"))


@query()
def align_stats(spark, d):
    return _aligned(spark, d).select("row_id", *align.op_counts(F.col("ops")), "edit_distance")


@query()
def planner_labels(spark, d):
    return labels.planner_labels(_aligned(spark, d), "source_text").select("row_id", _joined(F.col("op_labels")).alias("ops"), _joined(F.col("insert_labels")).alias("inserts"))


def _templates(spark, d):
    return labels.gold_template(labels.planner_labels(_aligned(spark, d).where("source_text <> ''"), "source_text"), "source_text")


@query()
def gold_template(spark, d):
    return _templates(spark, d).select("row_id", F.array_join("template_tokens", "").alias("template"), F.array_join("gold_tokens", "").alias("gold"), _joined(F.col("mask_positions")).alias("masks"))


@query("SELECT row_id, true AS labels_ok, true AS template_ok FROM model_inputs WHERE source_text IS NOT NULL AND target_text IS NOT NULL AND source_text <> ''")
def validate_labels(spark, d):
    return _templates(spark, d).select("row_id", labels.labels_valid(F.col("source_text"), F.col("op_labels"), F.col("insert_labels")).alias("labels_ok"), labels.template_valid(F.col("template_tokens"), F.col("gold_tokens"), F.col("mask_positions")).alias("template_ok"))


_E = "edits[1]"
_DIRECT = f"""
e AS (SELECT row_id, corrupted AS s, {_E}.position AS p, {_E}.type AS k, {_E}.original AS o, length({_E}.error) AS n, range(0, length(corrupted)) AS places FROM corruptions WHERE len(edits) = 1 AND corrupted IS NOT NULL),
l AS (SELECT *, list_transform(places, lambda i: CASE WHEN k = 'M' AND i > p AND i <= p + n THEN 1 WHEN k = 'R' AND i = p THEN 2 ELSE 0 END) AS ops,
             list_transform(places, lambda i: CASE WHEN k = 'S' AND i = greatest(p - 1, 0) THEN 1 ELSE 0 END) AS ins FROM e)
SELECT row_id, array_to_string(ops, ',') AS ops, array_to_string(ins, ',') AS inserts,
       CASE WHEN k = 'S' THEN substr(s, 1, p) || '[MASK]' || substr(s, p + 1) WHEN k = 'M' THEN substr(s, 1, p + 1) || substr(s, p + n + 2) ELSE substr(s, 1, p) || CASE WHEN p < length(s) THEN '[MASK]' ELSE '' END || substr(s, p + 2) END AS template,
       CASE WHEN k = 'M' OR (k = 'R' AND p >= length(s)) THEN '' ELSE o END AS gold
FROM l"""


_CTE, _ROWS = _DIRECT.rsplit("\nSELECT row_id, array_to_string(ops", 1)
ORACLES["static_samples"] = ORACLES["static_samples"].replace("{direct}", _CTE.replace("SELECT row_id, corrupted AS s", "SELECT id AS row_id, corrupted AS s").replace("FROM corruptions", "FROM made") + ",\nlabelled AS (SELECT s, row_id, array_to_string(ops" + _ROWS + "),".removesuffix(","))


@query("WITH " + _DIRECT)
def direct_labels(spark, d):
    """Labels of the rows with exactly one edit, straight from it."""
    rows = spread(table(spark, d, "corruptions", ["row_id", "corrupted", "edits"])).where("size(edits) = 1 and corrupted is not null")
    out = labels.direct_labels(rows.withColumn("e", F.get("edits", F.lit(0))), "corrupted", "e")
    return out.select("row_id", _joined(F.col("op_labels")).alias("ops"), _joined(F.col("insert_labels")).alias("inserts"), F.array_join("template_tokens", "").alias("template"), F.array_join("gold_tokens", "").alias("gold"))


@query("SELECT row_id, array_to_string(list_transform(range(0, length(original)), lambda i: 0), ',') AS ops, original AS template FROM corruptions WHERE original IS NOT NULL AND NOT is_corrupted")
def positive_labels(spark, d):
    rows = spread(table(spark, d, "corruptions", ["row_id", "original", "is_corrupted", "edits"])).where("original is not null and not is_corrupted")
    out = labels.direct_labels(rows.withColumn("e", F.get(F.filter("edits", lambda x: F.lit(False)), F.lit(0))), "original", "e")
    return out.select("row_id", _joined(F.col("op_labels")).alias("ops"), F.array_join("template_tokens", "").alias("template"))


def _samples(spark, d, *cols):
    return spread(table(spark, d, "tokenized_samples", ["row_id", *cols]))


@query("SELECT row_id, coalesce(list_sum(list_transform(range(1, least(len(op_labels), len(insert_labels)) + 1), lambda i: CASE WHEN op_labels[i] IN (0, 2) THEN 1 + greatest(insert_labels[i]::INTEGER, 0) ELSE 0 END)), 0)::BIGINT AS n FROM tokenized_samples WHERE op_labels IS NOT NULL AND insert_labels IS NOT NULL")
def target_length(spark, d):
    return _samples(spark, d, "op_labels", "insert_labels").where("op_labels is not null and insert_labels is not null").select("row_id", labels.target_length(F.col("op_labels"), F.col("insert_labels")).cast("long").alias("n"))


@query()
def align_shown(spark, d):
    return _aligned(spark, d).select("row_id", align.shown(F.col("ops")).alias("script"))


# ---- features

_VOCAB = "(SELECT map_from_entries(list((token, token_id))) FROM vocab)"
_FIT = "array_to_string(list_resize({0}, 128, {1}), ',')"


@query(f"SELECT row_id, {_FIT.format(f'list_concat([101], list_transform(string_split(source_text, chr(0))[1:0], lambda x: 0), list_transform(range(1, least(length(source_text), 126) + 1), lambda i: coalesce(v[substr(source_text, i, 1)], 100)), [102])', 0)} AS ids FROM (SELECT *, {_VOCAB} AS v FROM model_inputs WHERE source_text IS NOT NULL)")
def encode_chars(spark, d):
    v = features.vocabulary(table(spark, d, "vocab"))
    rows = spread(table(spark, d, "model_inputs", ["row_id", "source_text"])).where("source_text is not null")
    return rows.select("row_id", _joined(features.encoded(F.col("source_text"), v, 128)).alias("ids"))


@query(f"SELECT row_id, {_FIT.format('list_concat([-100], op_labels[1:126]::INTEGER[], [-100])', -100)} AS ops, {_FIT.format('list_concat([0], insert_labels[1:126]::INTEGER[], [0])', 0)} AS inserts FROM tokenized_samples WHERE op_labels IS NOT NULL AND insert_labels IS NOT NULL")
def pad_labels(spark, d):
    rows = _samples(spark, d, "op_labels", "insert_labels").where("op_labels is not null and insert_labels is not null")
    return rows.select("row_id", _joined(features.padded_ops(F.col("op_labels"), 128)).alias("ops"), _joined(features.padded_inserts(F.col("insert_labels"), 128)).alias("inserts"))


@query()
def features_sparse(spark, d):
    v = features.vocabulary(table(spark, d, "vocab"))
    t, l = features.sparse_features(F.col("template_tokens"), F.col("gold_tokens"), v, 128)
    return _templates(spark, d).withColumn("t", t).withColumn("l", l).select("row_id", _joined(F.col("t")).alias("template_ids"), _joined(F.col("l")).alias("infill"))


_FULL = f"""
s AS (SELECT row_id, least(length(source_text), 125) AS n, source_text AS s, target_text AS t, {_VOCAB} AS v FROM model_inputs WHERE source_text IS NOT NULL AND target_text IS NOT NULL),
r AS (SELECT *, greatest(0, least(length(t), 125 - n)) AS m FROM s)
SELECT row_id, {_FIT.format("list_concat([101], list_transform(range(1, n + 1), lambda i: coalesce(v[substr(s, i, 1)], 100)), [102], list_transform(range(0, m), lambda i: 103), [102])", 0)} AS template_ids,
       {_FIT.format("list_concat(list_transform(range(0, n + 2), lambda i: -100), list_transform(range(1, m + 1), lambda i: coalesce(v[substr(t, i, 1)], 100)))", -100)} AS infill
FROM r"""


@query("WITH " + _FULL)
def features_full(spark, d):
    v = features.vocabulary(table(spark, d, "vocab"))
    t, l = features.full_features(F.col("source_text"), F.col("target_text"), F.length("target_text"), v, 128)
    return _pairs(spark, d).select("row_id", _joined(t).alias("template_ids"), _joined(l).alias("infill"))


@query()
def aux_mlm(spark, d):
    rows = _samples(spark, d, "input_ids", "op_labels").where("input_ids is not null and op_labels is not null")
    return rows.select("row_id", _joined(features.auxiliary_labels(F.col("input_ids"), F.col("op_labels"), F.col("row_id"))).alias("labels"))


_SIZES = " + ".join(f"{2 if k == 'h' else 1} * len({c})" for c, k in features.VECTORS.items())


@query(f"SELECT row_id, ({_SIZES})::BIGINT AS n_bytes FROM tokenized_samples WHERE {' AND '.join(f'{c} IS NOT NULL' for c in features.VECTORS)}")
def pack_record_size(spark, d):
    rows = features.packed(_samples(spark, d, *features.VECTORS))
    return rows.where("record is not null").select("row_id", F.octet_length("record").cast("long").alias("n_bytes"))


@query(f"SELECT shard, count(*)::BIGINT AS n FROM (SELECT {_sql_draw('42', chr(39) + 'shard' + chr(39), 'row_id')} % 8 AS shard FROM tokenized_samples) GROUP BY shard")
def shard_sizes(spark, d):
    return _samples(spark, d).select(features.shard_of(F.col("row_id"), 8).cast("long").alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"SELECT row_id, lag(row_id) OVER (ORDER BY h, row_id) AS before FROM (SELECT row_id, {_sql_draw(chr(39) + '42' + chr(39), chr(39) + '1' + chr(39), 'row_id')} AS h FROM tokenized_samples)")
def shuffled_epoch(spark, d):
    """Each row with the one that stands before it in the epoch's order, across partitions: neighbours within each, and the
    last row of the partition before for the first."""
    rows = features.shuffled(_samples(spark, d), "row_id", epoch=1).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    kept = checkpointed(rows)
    w = Window.partitionBy("p").orderBy("i")
    last = kept.groupBy("p").agg(F.max_by("row_id", "i").alias("row_id")).collect()  # a row a partition
    ends = {r.p: r.row_id for r in last}
    known = sorted(ends)
    first = {b: ends[a] for a, b in zip(known, known[1:])}
    before = F.lag("row_id").over(w)
    other = F.create_map(*[F.lit(x).cast("long") for kv in first.items() for x in kv])[F.col("p").cast("long")] if first else F.lit(None).cast("long")
    return kept.select("row_id", F.coalesce(before, other).alias("before"))


# ---- decision rules

_P3 = "[{0} % 100 / 100.0, {1} % 100 / 100.0, {2} % 100 / 100.0]".format(*[_sql_draw("row_id", f"'p{i}'") for i in range(3)])


def _p3() -> Column:
    return F.array(*[draw(F.col("row_id"), f"p{i}") % 100 / 100.0 for i in range(3)])


@query(
    f"""SELECT row_id, (CASE WHEN b = 1 AND p[2] < 0.5 THEN 0 ELSE b END)::BIGINT AS op, (CASE WHEN 1 - p[1] >= 0.5 THEN b ELSE 0 END)::BIGINT AS inserts, list_max(p)::DOUBLE AS confidence
FROM (SELECT row_id, p, list_position(p, list_max(p)) - 1 AS b FROM (SELECT row_id, {_P3} AS p FROM tokenized_samples))"""
)
def planner_threshold(spark, d):
    rows = _samples(spark, d).select("row_id", _p3().alias("p"))
    return rows.select("row_id", decide.op_decision(F.col("p")).cast("long").alias("op"), decide.insert_decision(F.col("p")).cast("long").alias("inserts"), F.array_max("p").alias("confidence"))


# Ops and insertions drawn for each id of the source.
_IDS = "list_filter(input_ids, lambda x: x NOT IN (0, 101, 102))"
_DRAWN = f"""
s AS (SELECT row_id, {_IDS} AS ids FROM tokenized_samples WHERE input_ids IS NOT NULL),
o AS (SELECT row_id, ids, list_transform(range(0, len(ids)), lambda i: {_sql_draw('row_id', "'o'", 'i')} % 3) AS ops, list_transform(range(0, len(ids)), lambda i: greatest({_sql_draw('row_id', "'i'", 'i')} % 12 - 8, 0)) AS ins,
             least(6, floor(len(ids) * 0.1)::INTEGER + 1) AS cap FROM s),
w AS (SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ops[i] <> 1 THEN ins[i] ELSE 0 END) AS want FROM o),
b AS (SELECT *, list_transform(range(1, len(ids) + 1), lambda i: greatest(0, least(want[i], cap - least(coalesce(list_sum(want[1:i - 1]), 0), cap)))) AS spent FROM w)"""


def _drawn(spark, d):
    rows = _samples(spark, d, "input_ids").where("input_ids is not null").select("row_id", F.filter("input_ids", lambda x: ~x.isin(0, 101, 102)).cast("array<int>").alias("ids"))
    at = F.when(F.size("ids") > 0, F.sequence(F.lit(0), F.size("ids") - 1)).otherwise(F.array().cast("array<int>"))
    ops = F.transform(at, lambda i: (draw(F.col("row_id"), "o", i) % 3).cast("int"))
    ins = F.transform(at, lambda i: F.greatest((draw(F.col("row_id"), "i", i) % 12 - 8).cast("int"), F.lit(0)))
    return rows.withColumn("ops", ops).withColumn("ins", ins)


@query(
    f"""WITH {_DRAWN} SELECT row_id, array_to_string(spent, ',') AS inserts,
array_to_string(list_concat([101], flatten(list_transform(range(1, len(ids) + 1), lambda i: list_concat(CASE ops[i] WHEN 0 THEN [ids[i]::INTEGER] WHEN 2 THEN [103] ELSE [] END, list_transform(range(0, spent[i]::INTEGER), lambda j: 103)))), [102]), ',') AS template FROM b"""
)
def sparse_template_budget(spark, d):
    rows = _drawn(spark, d).withColumn("spent", decide.budgeted(F.col("ops"), F.col("ins")))
    return rows.select("row_id", _joined(F.col("spent")).alias("inserts"), _joined(decide.sparse_template(F.col("ids"), F.col("ops"), F.col("spent"))).alias("template"))


@query(f"WITH {_DRAWN} SELECT row_id, coalesce(list_sum(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ops[i] <> 1 THEN 1 + least(ins[i], cap) ELSE 0 END)), 0)::BIGINT AS n FROM b")
def capped_target_length(spark, d):
    return _drawn(spark, d).select("row_id", decide.capped_length(F.col("ops"), F.col("ins")).cast("long").alias("n"))


@query(f"WITH s AS (SELECT row_id, ({_IDS})[1:125] AS ids FROM tokenized_samples WHERE input_ids IS NOT NULL) SELECT row_id, array_to_string(list_concat([101], ids::INTEGER[], [102], list_transform(range(0, greatest(0, least(len(ids) + 1, 125 - len(ids)))), lambda i: 103), [102]), ',') AS template FROM s")
def full_template(spark, d):
    rows = _drawn(spark, d).withColumn("ids", F.slice("ids", 1, 125))
    return rows.select("row_id", _joined(decide.full_template(F.col("ids"), F.size("ids") + 1, 128)).alias("template"))


@query(
    f"""SELECT row_id, array_to_string(list_transform(list_sort(l)[1:greatest(1, floor(len(l) * 0.15)::INTEGER)], lambda x: x['i']), ',') AS positions
FROM (SELECT row_id, list_filter(list_transform(range(0, len(input_ids)), lambda i: {{'c': {_sql_draw('row_id', "'c'", 'i')} % 1000, 'i': i, 'x': input_ids[i + 1]}}), lambda z: z['x'] NOT IN (0, 101, 102)) AS l FROM tokenized_samples WHERE input_ids IS NOT NULL)"""
)
def refine_bottom_k(spark, d):
    rows = _samples(spark, d, "input_ids").where("input_ids is not null")
    confidence = F.transform("input_ids", lambda x, i: draw(F.col("row_id"), "c", i) % 1000)
    return rows.select("row_id", _joined(decide.least_sure(F.col("input_ids"), confidence)).alias("positions"))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(0, len(embedding)), lambda i: {'m': -embedding[i + 1], 'i': i}))[1:5], lambda x: x['i']), ',') AS tokens FROM embeddings")
def topk_tokens(spark, d):
    return table(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", _joined(F.transform(decide.top_tokens(F.col("embedding")), lambda x: x["token"])).alias("tokens"))


@query(f"SELECT row_id FROM tokenized_samples WHERE {_sql_draw('row_id', chr(39) + 'v' + chr(39))} % 100 / 100.0 > 0.5")
def verifier_filter(spark, d):
    return _samples(spark, d).where(decide.accepted(draw(F.col("row_id"), "v") % 100 / 100.0))


@query(
    f"""WITH {_DRAWN}, x AS (SELECT row_id, ops, ins, unnest(range(1, len(ops) + 1)) AS i FROM b)
SELECT row_id, (i - 1)::BIGINT AS position, CASE ops[i] WHEN 1 THEN 'DELETE' ELSE 'REPLACE' END AS type, 1::BIGINT AS count FROM x WHERE ops[i] <> 0
UNION ALL SELECT row_id, (i - 1)::BIGINT, 'INSERT', ins[i]::BIGINT FROM x WHERE ins[i] > 0"""
)
def extract_edits(spark, d):
    rows = decide.extracted_edits(_drawn(spark, d).withColumn("s", F.lit("")), "row_id", "s", "ops", "ins")
    return rows.select("row_id", F.col("position").cast("long"), "type", F.col("count").cast("long"))


@query()
def correct_with_plug(spark, d):
    """The whole prediction path around plugged functions: drawn op and insertion probabilities, masks filled with one id."""
    rows = _samples(spark, d, "input_ids").where("input_ids is not null").select(F.col("row_id").alias("id"), F.filter("input_ids", lambda x: ~x.isin(0, 101, 102)).cast("array<int>").alias("ids"))

    def plan(r):
        p = lambda slot, n: F.transform("ids", lambda x: F.transform(F.array(*map(F.lit, range(n))), lambda k: draw(F.col("id"), slot, x, k) / draws.SPAN))
        return r.select("id", p("op", 3).alias("p_op"), p("ins", 4).alias("p_insert"))

    def fill(r):
        return r.select("id", F.transform("ids", lambda x: F.when(x == features.MASK, 104).otherwise(x)).alias("filled"), F.transform("ids", lambda x: draw(F.col("id"), "c", x) / draws.SPAN).alias("confidence"))

    sparse = Settings(features=FeatureSettings(full_mask=False), decisions=DecisionSettings(refine=True))
    out = pipeline.Corrector(plan, fill, sparse).correct(rows)
    return out.select("id", _joined(F.col("prediction")).alias("prediction"), F.round("confidence", 6).alias("confidence"), "is_changed", F.size("edits").alias("n_edits"))


@query(
    "SELECT s::BIGINT AS step, round(CASE WHEN s < 10 THEN s / 10.0 ELSE greatest(0.0, (100 - s) / 90.0) END, 6)::DOUBLE AS linear, "
    "round(CASE WHEN s < 10 THEN s / 10.0 ELSE greatest(0.0, 0.5 * (1 + cos(pi() * (s - 10) / 90.0))) END, 6)::DOUBLE AS cosine, round(CASE WHEN s < 10 THEN s / 10.0 ELSE 1.0 END, 6)::DOUBLE AS constant FROM range(0, 101) t(s)"
)
def lr_schedule(spark, d):
    s = F.col("id")
    return spark.range(101).select(s.alias("step"), *[F.round(decide.learning_rate(s, 10, 100, k), 6).alias(k) for k in ("linear", "cosine", "constant")])


@query("SELECT s::BIGINT AS step, round(0.5 * least(1.0, s / 100.0), 6)::DOUBLE AS linear, round(0.5 * 0.5 * (1 - cos(pi() * least(1.0, s / 100.0))), 6)::DOUBLE AS cosine FROM range(0, 121) t(s)")
def sampling_ratio(spark, d):
    s = F.col("id")
    return spark.range(121).select(s.alias("step"), *[F.round(decide.sampling_ratio(s, 0.0, 0.5, 100, k), 6).alias(k) for k in ("linear", "cosine")])


# ---- statistics


def _corruptions(spark, d, *cols):
    return spread(table(spark, d, "corruptions", ["row_id", *cols]))


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (is_corrupted)::BIGINT AS corrupted, round(count(*) FILTER (is_corrupted) / count(*), 6)::DOUBLE AS rate, round(avg(num_edits) FILTER (is_corrupted), 6)::DOUBLE AS avg_edits FROM corruptions")
def corruption_stats(spark, d):
    return stats.corruption_stats(_corruptions(spark, d, "is_corrupted", "num_edits"))


@query("SELECT e.type AS type, count(*)::BIGINT AS n FROM (SELECT unnest(edits) AS e FROM corruptions) GROUP BY e.type")
def edit_type_histogram(spark, d):
    return stats.edit_types(_corruptions(spark, d, "edits"))


@query("SELECT num_edits::BIGINT AS num_edits, count(*)::BIGINT AS n FROM corruptions GROUP BY num_edits")
def edit_count_histogram(spark, d):
    return _corruptions(spark, d, "num_edits").groupBy(F.col("num_edits").cast("long").alias("num_edits")).agg(F.count("*").alias("n"))


@query(
    """SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN list_bool_or(list_transform(insert_labels, lambda x: x > 0)) THEN 'S' WHEN list_contains(op_labels, 1) THEN 'M' WHEN list_contains(op_labels, 2) THEN 'R' ELSE 'positive' END AS kind
FROM tokenized_samples WHERE op_labels IS NOT NULL AND insert_labels IS NOT NULL) GROUP BY kind"""
)
def static_stats(spark, d):
    return stats.sample_kinds(_samples(spark, d, "op_labels", "insert_labels").where("op_labels is not null and insert_labels is not null"))


@query("SELECT source, split, count(*)::BIGINT AS n, count(*) FILTER (original <> corrupted)::BIGINT AS n_changed FROM corruptions GROUP BY source, split")
def changed_ratio(spark, d):
    return stats.changed(_corruptions(spark, d, "source", "split", "original", "corrupted"))


@query(
    f"""WITH g AS (SELECT row_id, unnest(edits) AS e FROM corruptions), a AS (SELECT DISTINCT row_id, e.position AS p, e.type AS t FROM g),
b AS (SELECT DISTINCT row_id, CASE WHEN h % 5 = 1 THEN p + 1 ELSE p END AS p, t FROM (SELECT *, {_sql_draw('row_id', 'p', "'f'")} AS h FROM a) WHERE h % 5 <> 0),
n AS (SELECT (SELECT count(*) FROM b) AS x, (SELECT count(*) FROM a) AS y, (SELECT count(*) FROM a JOIN b USING (row_id, p, t)) AS z)
SELECT x::BIGINT AS n_predicted, y::BIGINT AS n_true, z::BIGINT AS n_right, round(z / x, 6)::DOUBLE AS "precision", round(z / y, 6)::DOUBLE AS recall, round(1.25 * (z / x) * (z / y) / (0.25 * (z / x) + z / y), 6)::DOUBLE AS f_half FROM n"""
)
def edit_f_score(spark, d):
    """Precision, recall and F0.5 of predicted edits; here every fifth true one is missing and every fifth stands a place off."""
    true = _corruptions(spark, d, "edits").select("row_id", F.explode("edits").alias("e")).select("row_id", F.col("e.position").alias("position"), F.col("e.type").alias("type")).distinct()
    h = draw(F.col("row_id"), F.col("position"), "f")
    guessed = true.where(h % 5 != 0).withColumn("position", F.when(h % 5 == 1, F.col("position") + 1).otherwise(F.col("position")))
    return stats.f_score(guessed, true, ["row_id", "position", "type"])


# ---- readers and streams


@query("SELECT row_id, source_text AS source, target_text AS target FROM model_inputs WHERE source_text <> '' AND target_text <> '' ")
def read_pairs_json(spark, d):
    """Pairs as JSON lines and back."""
    lines = _pairs(spark, d).select(F.to_json(F.struct(F.concat_ws("|", F.col("row_id").cast("string"), "source_text").alias("src"), F.col("target_text").alias("tgt"))).alias("value"))
    p = readers.jsonl_pairs(lines)
    bar = F.instr("source", "|")
    return p.select(F.substring("source", F.lit(1), bar - 1).cast("long").alias("row_id"), F.substring("source", bar + 1, F.length("source")).alias("source"), "target").where("source <> ''")


_CLEAN = r"[\t\n\r]"


@query(f"SELECT row_id, trim(regexp_replace(source_text, '{_CLEAN}', ' ', 'g')) AS source, trim(regexp_replace(target_text, '{_CLEAN}', ' ', 'g')) AS target FROM model_inputs WHERE trim(source_text) <> '' AND trim(target_text) <> ''")
def read_pairs_tsv(spark, d):
    """Pairs as tab-separated lines with an id in front, and back."""
    clean = lambda c: F.trim(F.regexp_replace(c, _CLEAN, " "))
    rows = _pairs(spark, d).select("row_id", F.concat_ws("\t", F.lit("x"), F.concat_ws("|", F.col("row_id").cast("string"), clean("source_text")), clean("target_text")).alias("value"))
    p = readers.tsv_pairs(rows.select("value"), id_column=True)
    bar = F.instr("source", "|")
    return p.select(F.substring("source", F.lit(1), bar - 1).cast("long").alias("row_id"), F.substring("source", bar + 1, F.length("source")).alias("source"), "target").where("source <> ''")


def _stream(spark, d, name, *cols):
    """The table `name` as a stream of files."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    df = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return df.select(*cols)


@query("SELECT time_bucket(INTERVAL 7 DAY, created_at, TIMESTAMP '1970-01-01') AS start, count(*)::BIGINT AS n, count(*) FILTER (is_corrupted)::BIGINT AS n_corrupted FROM corruptions WHERE created_at IS NOT NULL GROUP BY 1")
def stream_changed_rate(spark, d):
    """Counts per week of event time from a stream of all rows, run until nothing is left."""
    rows = _stream(spark, d, "corruptions", F.col("created_at").cast("timestamp").alias("created_at"), "is_corrupted").where("created_at is not null")
    out = stream.run_once(stream.changed_rate(rows), f"{checkpoint_dir(spark)}/stream-{os.urandom(6).hex()}", f"{checkpoint_dir(spark)}/stream-{os.urandom(6).hex()}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "n_corrupted")


@query(f"SELECT seg_id, {_TIDY} AS text FROM sentences")
def stream_normalize(spark, d):
    """Blanks and lines tidied on a stream, row by row."""
    rows = _stream(spark, d, "sentences", "seg_id", "text").withColumn("text", normalize.tidy_lines(F.col("text")))
    return stream.run_once(rows, f"{checkpoint_dir(spark)}/stream-{os.urandom(6).hex()}", f"{checkpoint_dir(spark)}/stream-{os.urandom(6).hex()}")


@query("SELECT count(*)::BIGINT AS n FROM sentences")
def stream_normalize_all(spark, d):
    """The whole pipeline, compatibility forms too, on a stream: the rows that came through."""
    rows = stream.normalized_stream(_stream(spark, d, "sentences", "seg_id", "text"))
    return stream.run_once(rows, f"{checkpoint_dir(spark)}/stream-{os.urandom(6).hex()}", f"{checkpoint_dir(spark)}/stream-{os.urandom(6).hex()}").agg(F.count("*").alias("n"))


# ---- flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to labelled samples: sentences of all documents, one drawn error each, labels straight from the edit; counted
    by kind of error."""
    sentences = segment.split_sentences(_docs(spark, sf_dir), "doc_id", "text").where(F.length("text").between(5, 118))
    keyed = sentences.select(F.concat_ws("-", "doc_id", "start").alias("id"), "text")
    made = corrupt.corrupt(keyed, "id", "text", confusion.lookup(_conf(spark, sf_dir)), corrupt.ErrorSettings(most_edits=1)).withColumn("e", F.get("edits", F.lit(0)))
    done = labels.direct_labels(made, "corrupted", "e")
    return done.groupBy(F.coalesce("e.type", F.lit("none")).alias("type")).agg(
        F.count("*").alias("n"), F.sum(labels.target_length(F.col("op_labels"), F.col("insert_labels"))).alias("target_chars"), F.sum(F.size("mask_positions")).alias("masks")
    )


QUERIES["flagship"] = flagship
ORACLES["flagship"] = f"""WITH {_LINES}, {_sql_pieces(_QUOTED)}, keyed AS (SELECT doc_id || '-' || start::BIGINT AS id, text FROM pieces WHERE length(text) BETWEEN 5 AND 118),
{_sql_corrupt("keyed", "id", 1, _GATE.format(key="id", n=1))}
SELECT coalesce(edits[1].type, 'none') AS type, count(*)::BIGINT AS n, sum(length(corrupted) + CASE edits[1].type WHEN 'S' THEN 1 WHEN 'M' THEN -length(edits[1].error) ELSE 0 END)::BIGINT AS target_chars, count(*) FILTER (edits[1].type IN ('S', 'R'))::BIGINT AS masks FROM made GROUP BY 1"""
QUERIES |= files.QUERIES | golden.QUERIES
ORACLES |= files.ORACLES | golden.ORACLES
