"""Global order without one task that has all rows: row numbers, running totals, exact quantiles.

Rows are dealt by ranges of the order and sorted where they are; the driver only has a number for each range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import cut

RANGES, FEW = 2048, 1000


def _dealt(rows: DataFrame, order) -> DataFrame:
    """Rows in ranges, with `_at`: the range in the upper bits, the place within it in the lower 33."""
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def _before(dealt: DataFrame, value: Column) -> DataFrame:
    """(_range, _before): the sum of a value over all ranges before each."""
    sums = sorted(dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.coalesce(F.sum(value), F.lit(0)).alias("s")).collect())
    out, total = [], 0
    for r in sums:
        out.append((r["_range"], total))
        total += r["s"]
    kind = "double" if isinstance(total, float) else "long"
    return F.broadcast(dealt.sparkSession.createDataFrame(out, f"_range long, _before {kind}"))


def numbered(rows: DataFrame, *order, name: str = "k") -> DataFrame:
    """The rows with their numbers from 1 in an order; rows that the order can't tell apart have them in any order."""
    dealt = _dealt(rows, order)
    placed = dealt.withColumn("_range", F.shiftright("_at", 33)).join(_before(dealt, F.lit(1)), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, name)


def running_total(rows: DataFrame, value: str, *order, name: str = "total") -> DataFrame:
    """The rows with the sum of a value over all rows up to each in an order; a null counts as 0."""
    dealt = _dealt(rows, order)
    placed = dealt.withColumn("_range", F.shiftright("_at", 33)).join(_before(dealt, F.col(value)), "_range")
    own = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(own), F.lit(0))).select(*rows.columns, name)


def exact_quantiles(rows: DataFrame, column: str, at: list[float], ranges: int = RANGES, few: int = FEW) -> list[float | None]:
    """The quantiles of a column, interpolated between the two nearest values; nulls and NaN are left out, None if nothing is left.

    The values' range is cut into `ranges` equal ones, which are counted; only those that a wanted rank lies in are cut again, until
    they have one value or a few. So the driver has some thousand counts a round, and no task has all values.
    """
    values = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    whole = values.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not whole["n"]:
        return [None] * len(at)
    n = whole["n"]
    ranks = sorted({r for q in at for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    open_, known = [(whole["low"], whole["high"], 0, n)], {}  # ranges with the ranks of their first values and their sizes
    while open_:
        further, small = [], []
        for low, high, first, size in open_:
            own = [r for r in ranks if first <= r < first + size]
            if low == high:
                known |= dict.fromkeys(own, low)
            elif own and size <= few:
                small.append((low, high, first))
            elif own:
                further.append((low, high, first))
        inside = lambda r: F.col("x").between(r[0], r[1])
        for r in small:
            got = sorted(x["x"] for x in values.where(inside(r)).collect())
            known |= {k: got[k - r[2]] for k in ranks if r[2] <= k < r[2] + len(got)}
        if not further:
            break
        place = None
        for i, (low, high, _) in enumerate(further):
            step = F.least(F.floor((F.col("x") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) * ranges), F.lit(ranges - 1)).cast("long") + i * ranges
            place = F.when(inside(further[i]), step) if place is None else place.when(inside(further[i]), step)
        counts = values.select("x", place.alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        firsts = [f for _, _, f in further]
        open_ = []
        for r in sorted(counts.collect()):
            i = r["p"] // ranges
            open_.append((r["low"], r["high"], firsts[i], r["n"]))
            firsts[i] += r["n"]
    exact = lambda q: (known[math.floor(q * (n - 1))], known[math.ceil(q * (n - 1))], q * (n - 1) - math.floor(q * (n - 1)))
    return [a + (b - a) * f for a, b, f in map(exact, at)]
