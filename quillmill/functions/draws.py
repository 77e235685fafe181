"""Hash draws: random choices that depend on a seed, an epoch, a row's id and a slot only, never on partitions or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


def let(value: Column, body) -> Column:
    """`body` of `value` as a lambda variable: an expression that a lambda of its own names is else evaluated anew for
    every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def draw(*parts: Column | str | int) -> Column:
    """A uniform integer in [0, 2^32) from the parts; strings are literals, columns are columns."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    return draw(*parts) / SPAN


def truncated_poisson(lam: float, most: int) -> list[float]:
    """Probabilities of 1..most of a Poisson variable, given that it is one of them."""
    w = [lam**k / math.factorial(k) for k in range(1, most + 1)]
    return [x / sum(w) for x in w]


def by_thresholds(value: Column, probabilities: list[float], outcomes: list) -> Column:
    """The outcome whose share of [0, 2^32) holds the draw; the last one takes what rounding leaves."""
    upto, case = 0.0, None
    for p, o in list(zip(probabilities, outcomes))[:-1]:
        upto += p
        cond = value < int(upto * SPAN)
        case = F.when(cond, F.lit(o)) if case is None else case.when(cond, F.lit(o))
    return F.lit(outcomes[-1]) if case is None else case.otherwise(F.lit(outcomes[-1]))


def poisson_column(value: Column, lam: Column, most: int) -> Column:
    """Truncated Poisson on 1..most with a rate per row, by inverting the distribution function."""
    w = [F.pow(lam, F.lit(k)) / math.factorial(k) for k in range(1, most + 1)]
    total = sum(w[1:], w[0])
    u, out, upto = value / SPAN * total, F.lit(most), F.lit(0.0)
    steps = []
    for x in w[:-1]:
        upto = upto + x
        steps.append(upto)
    for k in range(most - 1, 0, -1):
        out = F.when(u < steps[k - 1], F.lit(k)).otherwise(out)
    return out


def length_rate(n: Column, shortest: int = 20, longest: int = 80, low: float = 1.0, high: float = 3.0) -> Column:
    """Rate of edits by length: constant outside [shortest, longest], linear within."""
    return F.when(n <= shortest, low).when(n >= longest, high).otherwise(low + (n - shortest) / (longest - shortest) * (high - low))


def ratio_rate(n: Column, ratio: float = 0.05) -> Column:
    return F.greatest(F.lit(1.0), n * ratio)
