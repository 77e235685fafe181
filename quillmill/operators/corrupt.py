"""Controlled synthetic errors: delete (S), repeat (M) or replace (R) characters, chosen by hash draws."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import SPAN, by_thresholds, draw, length_rate, let, poisson_column, truncated_poisson
from ..functions.protect import editable_positions

# Heads of confusions that may be a literal in the plan.
MOST_LITERAL = 20_000


@dataclass(frozen=True)
class ErrorSettings:
    """Rates of corruption. The shares of the kinds are normalised; all of them zero is an error."""

    p_corrupt: float = 0.7
    rate: float = 1.5
    skip: float = 0.2
    multiply: float = 0.3
    replace: float = 0.5
    most_edits: int = 4
    most_repeats: int = 3
    least_length: int = 5
    by_length: bool = False
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.skip, self.multiply, self.replace) < 0 or self.skip + self.multiply + self.replace <= 0:
            raise ValueError("shares of error kinds must not be negative nor all zero")

    @property
    def shares(self) -> list[float]:
        total = self.skip + self.multiply + self.replace
        return [self.skip / total, self.multiply / total, self.replace / total]


PRESETS = {
    "default": ErrorSettings(),
    "balanced": ErrorSettings(skip=1 / 3, multiply=1 / 3, replace=1 / 3),
    "insert_focused": ErrorSettings(skip=0.35, multiply=0.35, replace=0.3),
    "conservative": ErrorSettings(p_corrupt=0.5, rate=1.0, most_edits=2),
    "aggressive": ErrorSettings(p_corrupt=0.8, rate=2.0, most_edits=4),
}


def n_edits(value: Column, settings: ErrorSettings = ErrorSettings(), rate: Column | None = None) -> Column:
    if rate is not None:
        return poisson_column(value, rate, settings.most_edits)
    return by_thresholds(value, truncated_poisson(settings.rate, settings.most_edits), list(range(1, settings.most_edits + 1)))


def error_kind(value: Column, settings: ErrorSettings = ErrorSettings()) -> Column:
    return by_thresholds(value, settings.shares, ["S", "M", "R"])


class Confusable:
    """Confusions as a literal: per code point of the basic plane an array, for other heads a map. Made only from at most
    MOST_LITERAL heads; a larger set is joined."""

    def __init__(self, lists: dict[str, list[str]]) -> None:
        plain = {ord(c): v for c, v in lists.items() if len(c) == 1 and ord(c) < 0x10000}
        self.size = max(plain, default=-1) + 1
        self.table = F.from_json(F.lit(json.dumps([plain.get(o) for o in range(self.size)])), "array<array<string>>")
        self.rest = F.from_json(F.lit(json.dumps({c: v for c, v in lists.items() if len(c) != 1 or ord(c) >= 0x10000})), "map<string,array<string>>")

    def __call__(self, char: Column) -> Column:
        """The confusions of a character, or null."""
        point = F.ascii(char)
        return F.when(point < min(self.size, 0x10000), F.get(self.table, point)).otherwise(self.rest[char])

    @classmethod
    def of(cls, confusions: DataFrame) -> Confusable | None:
        rows = confusions.where(F.size("confusions") > 0).select("char", "confusions").limit(MOST_LITERAL + 1).collect()
        return cls({r.char: list(r.confusions) for r in rows}) if len(rows) <= MOST_LITERAL else None


def _chosen(free: Column, wanted: Column, d) -> Column:
    """`wanted` of the free places in order, drawn without replacement, a draw a place."""
    step = lambda z, j: let(F.get(z["rest"], (d("at", j) % F.greatest(F.size(z["rest"]), F.lit(1))).cast("int")), lambda p: F.struct(F.array_remove(z["rest"], p).alias("rest"), F.array_append(z["at"], p).alias("at")))
    start = lambda f: F.struct(f.alias("rest"), F.array().cast("array<int>").alias("at"))
    turns = lambda f: F.slice(F.sequence(F.lit(0), F.lit(99)), F.lit(1), F.least(wanted, F.size(f)))
    return let(free, lambda f: F.array_sort(F.aggregate(turns(f), start(f), step)["at"]))


def corrupt(df: DataFrame, key: str, text: str, confusions: DataFrame, settings: ErrorSettings = ErrorSettings(), epoch: int = 0, spans: str | None = None) -> DataFrame:
    """`df` with corrupted, is_corrupted, num_edits and edits (position, type, original, error), in places of the
    original. Sentences under the least length, or that the first draw spares, stay as they are; null stays null.
    A character without confusions is repeated instead of replaced. `confusions` is (char, confusions); rows aren't
    shuffled for a set of up to MOST_LITERAL characters, a larger one is joined to the chosen characters."""
    t, s = F.col(text), settings
    d = lambda *slot: draw(s.seed, epoch, F.col(key), *slot)
    free = editable_positions(t, F.col(spans) if spans else None)
    go = (F.length(t) >= s.least_length) & (d("gate") < int(s.p_corrupt * SPAN))
    wanted = n_edits(d("n"), s, length_rate(F.length(t)) if s.by_length else None)
    places = F.when(go, _chosen(free, wanted, d))
    return _edited(df, key, text, F.transform(places, lambda p: F.struct(p.alias("position"), F.substring(t, p + 1, F.lit(1)).alias("original"), error_kind(d("kind", p), s).alias("kind"))), confusions, s, d)


def kinds_in_order(key: Column, settings: ErrorSettings = ErrorSettings(), epoch: int = 0) -> Column:
    """All kinds in an order drawn without replacement by their shares: the least of -ln(u) / share comes first."""
    u = lambda k: (draw(settings.seed, epoch, key, "order", k) + 0.5) / SPAN
    keys = [F.struct((-F.log(u(k)) / w if w else F.lit(float("inf"))).alias("r"), F.lit(k).alias("k")) for k, w in zip("SMR", settings.shares)]
    return F.transform(F.array_sort(F.array(*keys)), lambda x: x["k"])


def corrupt_typed(df: DataFrame, key: str, text: str, kind: str, confusions: DataFrame, settings: ErrorSettings = ErrorSettings(), epoch: int = 0, spans: str | None = None) -> DataFrame:
    """As `corrupt`, but just one edit in each text of the least length, of the kind in the column `kind`. A replaced
    character is one of those that have confusions; a text without any has a repeated one instead."""
    t, s = F.col(text), settings
    d = lambda *slot: draw(s.seed, epoch, F.col(key), *slot)
    free = editable_positions(t, F.col(spans) if spans else None)
    go = (F.length(t) >= s.least_length) & F.col(kind).isNotNull()
    known = Confusable.of(confusions)
    if known:
        some = lambda f: F.when(F.col(kind) == "R", F.filter(f, lambda p: F.size(known(F.substring(t, p + 1, F.lit(1)))) > 0))
        pool = let(free, lambda f: let(some(f), lambda c: F.when(F.size(c) > 0, c).otherwise(f)))
    else:
        rows = df.where(go & (F.col(kind) == "R")).select(key, t.alias("t"), F.explode(free).alias("p")).withColumn("char", F.substring("t", F.col("p") + 1, F.lit(1)))
        places = rows.join(confusions.where(F.size("confusions") > 0).select("char"), "char", "left_semi").groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("_c"))
        df = df.join(places, key, "left")
        pool = F.coalesce(F.col("_c"), free)
    one = F.when(go, _chosen(pool, F.lit(1), d))
    out = _edited(df, key, text, F.transform(one, lambda p: F.struct(p.alias("position"), F.substring(t, p + 1, F.lit(1)).alias("original"), F.col(kind).alias("kind"))), confusions, s, d, known)
    return out.drop("_c")


def _edit(e: Column, own: Column, s: ErrorSettings, d) -> Column:
    """(position, type, original, error) of a chosen place, given its character's confusions."""
    some = F.coalesce(F.size(own) > 0, F.lit(False))
    kind = F.when((e["kind"] == "R") & ~some, "M").otherwise(e["kind"])
    repeats = (d("k", e["position"]) % s.most_repeats + 1).cast("int")
    pick = F.get(own, (d("pick", e["position"]) % F.greatest(F.size(own), F.lit(1))).cast("int"))
    error = F.when(kind == "S", "").when(kind == "M", F.repeat(e["original"], repeats)).otherwise(pick)
    return F.struct(e["position"].alias("position"), kind.alias("type"), e["original"].alias("original"), error.alias("error"))


def _edited(df: DataFrame, key: str, text: str, places: Column, confusions: DataFrame, s: ErrorSettings, d, known: Confusable | None = None) -> DataFrame:
    """`df` with the edits at `places`, an array of (position, original, kind) or null, made."""
    known = known or Confusable.of(confusions)
    if known:
        done = df.withColumn("edits", F.transform(places, lambda e: let(known(e["original"]), lambda own: _edit(e, own, s, d))))
    else:
        rows = df.select(key, F.explode(places).alias("e")).join(confusions.select(F.col("char").alias("_char"), "confusions"), F.col("e.original") == F.col("_char"), "left")
        edits = rows.select(key, _edit(F.col("e"), F.col("confusions"), s, d).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("edits"))
        done = df.join(edits, key, "left")
    done = done.withColumn("edits", F.coalesce("edits", F.array().cast(done.schema["edits"].dataType)))
    t = F.col(text)
    # One pass: pieces between the edits, and what each edit leaves.
    piece = lambda e, i: F.concat(
        F.substring(t, F.when(i == 0, 1).otherwise(F.element_at("edits", i)["position"] + 2), e["position"] - F.when(i == 0, 0).otherwise(F.element_at("edits", i)["position"] + 1)),
        F.when(e["type"] == "S", "").when(e["type"] == "M", F.concat(e["original"], e["error"])).otherwise(e["error"]),
    )
    last = F.element_at("edits", -1)["position"]
    body = F.when(F.size("edits") == 0, t).otherwise(F.concat(F.array_join(F.transform("edits", piece), ""), F.substring(t, last + 2, F.length(t))))
    return done.withColumn("corrupted", body).withColumn("num_edits", F.size("edits")).withColumn("is_corrupted", F.size("edits") > 0)


def split_of(value: Column, train: float = 0.8, dev: float = 0.1) -> Column:
    """train, dev or test by a draw: no order of all rows is needed. Shares hold on average."""
    return by_thresholds(value, [train, dev, 1 - train - dev], ["train", "dev", "test"])


def exact_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """`df` with `split`, of exactly int(n * share) train and dev rows in order of their draws. Only the draws at the two
    borders are looked for over all rows, by counts of 65,536 ranges of draws and then of the rows in the two ranges."""
    h = draw(seed, F.col(key))
    sizes = sorted((r._b, r.n) for r in df.groupBy(F.shiftright(h, 16).alias("_b")).agg(F.count("*").alias("n")).collect())
    n = sum(x for _, x in sizes)
    borders = []
    for upto in (int(n * train), int(n * train) + int(n * dev)):
        before = 0
        for b, x in sizes:
            if before + x > upto:
                row = df.where(F.shiftright(h, 16) == b).select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(upto - before + 1).orderBy(F.desc("h"), F.desc("k")).first()
                borders.append((row.h, row.k))
                break
            before += x
        else:
            borders.append(None)
    under = lambda b: F.lit(True) if b is None else (h < b[0]) | ((h == b[0]) & (F.col(key) < F.lit(b[1])))
    return df.withColumn("split", F.when(under(borders[0]), "train").when(under(borders[1]), "dev").otherwise("test"))
