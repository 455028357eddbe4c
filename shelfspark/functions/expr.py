"""Column helpers: exact sums, guarded ratios, rule conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(24,8)"


def exact_sum(c) -> Column:
    """Sum as a double; zero where nothing is summed."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def ratio(a, b) -> Column:
    """a / b as doubles, NULL on a zero or NULL base."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def all_of(conditions) -> Column:
    """Conditions joined by AND; a NULL counts as false."""
    return reduce(lambda x, y: x & y, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(True))


#: Rule operators: gt, gte, lt, lte, eq, between (inclusive), in, not_in.
OPERATORS = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "eq": lambda c, v: c == v,
    "between": lambda c, v: c.between(*v),
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
}


def rule_condition(conditions: list[tuple[str, str, object]], columns: list[str]) -> Column:
    """(field, operator, value) triples joined by AND; a missing field never matches."""
    if any(field not in columns for field, _, _ in conditions):
        return F.lit(False)
    return all_of(OPERATORS[op](F.col(field), value) for field, op, value in conditions)


#: The upper ends of the volume ranges in litres, half-open (min, max], and the ids of the ranges.
VOLUME_EDGES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 5.0)
VOLUME_IDS = ("le_0_25", "gt_0_25_le_0_50", "gt_0_50_le_0_75", "gt_0_75_le_1_00", "gt_1_00_le_1_50", "gt_1_50_le_2_00", "gt_2_00_le_5_00", "gt_5_00")


def volume_range(v) -> Column:
    """Id of the half-open volume range, NULL for NULL or non-positive volumes."""
    c = F.col(v) if isinstance(v, str) else v
    out = F.when(c <= 0, F.lit(None).cast("string"))
    for name, edge in zip(VOLUME_IDS, VOLUME_EDGES, strict=False):
        out = out.when(c <= edge, F.lit(name))
    return out.when(c.isNotNull(), F.lit(VOLUME_IDS[-1]))


def volume_filter(v, exact: tuple[float, ...] = (), ranges: tuple[str, ...] = ()) -> Column:
    """Positive volumes that equal a value (to six decimals) or lie in one of the ranges; NULL never passes."""
    c = F.col(v) if isinstance(v, str) else v
    bounds = dict(zip(VOLUME_IDS, zip((0.0, *VOLUME_EDGES), (*VOLUME_EDGES, None), strict=True), strict=True))
    out = F.round(c, 6).isin(*[round(x, 6) for x in exact]) if exact else F.lit(False)
    for name in ranges:
        low, high = bounds[name]
        out = out | ((c > low) & (c <= high) if high is not None else c > low)
    return F.coalesce((c > 0) & out, F.lit(False))
