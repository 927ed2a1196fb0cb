"""Orders over whole tables without one task for all rows.

Distinct values are dealt to ranges by cut points from a bounded sample; a range is sorted alone, and the sums of the
ranges before lift what is counted inside it. A range depends on the value alone, so it is the same in every branch of a plan.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PARTS = 64
SAMPLE = 16_384
RANGE_ROWS = 1_000_000  # distinct values of a range, about


def _sample(values: DataFrame, column: str, most: int) -> list:
    return [r[0] for r in values.select(column).orderBy(F.xxhash64(column), column).limit(most).collect()]


def ranges(values: DataFrame, column: str, parts: int = PARTS, of: str | None = None) -> Column:
    """The number of a value's range. Cut points: quantiles of SAMPLE of the distinct values, taken in hash order.

    Tables of more than PARTS * RANGE_ROWS values get up to PARTS * PARTS ranges, from a sample that is four times as large:
    PARTS of them by halving, and those of each by a list. of: the column to place, if it is another than that of the values.
    """
    own = F.col(of or column)
    picked, inner = _sample(values, column, SAMPLE), 1
    if len(picked) == SAMPLE:
        inner = min(parts, max(1, math.ceil(values.count() / (parts * RANGE_ROWS))))
        picked = _sample(values, column, 4 * SAMPLE) if inner > 1 else picked
    picked = sorted(x for x in picked if x == x)
    every = [picked[len(picked) * n // (parts * inner)] for n in range(1, parts * inner)] if picked else []
    cuts = every[inner - 1 :: inner]

    def place(low: int, high: int) -> Column:
        """How many of cuts[low:high] lie below the value, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(own <= F.lit(cuts[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    outer = place(0, len(cuts))
    if inner == 1:
        return outer
    lists = F.array(*[F.array(*[F.lit(x) for x in every[n * inner : n * inner + inner - 1]]) for n in range(parts)])
    return outer * inner + F.size(F.filter(F.get(lists, outer), lambda x: x < own))


def running(values: DataFrame, column: str, amount: str, name: str = "before", parts: int = PARTS) -> DataFrame:
    """values (one row for each value of column) with the sum of `amount` over all smaller values."""
    placed = values.withColumn("_range", ranges(values, column, parts))
    sums = placed.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(before.orderBy("_range")), F.lit(0)).alias("_base"))  # at most PARTS * PARTS rows
    inside = F.coalesce(F.sum(amount).over(W.partitionBy("_range").orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, inside).join(F.broadcast(base), "_range").withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base")


def running_within(df: DataFrame, keys: list[str], order: list, cell: Column, amount: Column, name: str, nulls: bool = True) -> DataFrame:
    """df with the sum of `amount` over the earlier rows of the same keys; a key's rows are cut into cells, so that one with very
    many rows spreads over tasks.

    cell: a number that does not fall along `order`, such as the range of its first column. The sums of a key's earlier cells,
    at most one row a cell, are added to the sum inside the cell. nulls: whether rows with null keys, which are a key, are kept;
    without them rows are shuffled once and not twice.
    """
    kept = df if nulls else df.dropna(subset=keys)
    placed = kept.withColumn("_cell", cell).withColumn("_amount", amount)
    sums = placed.groupBy(*keys, "_cell").agg(F.sum("_amount").alias("_sum"))
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    own = [*keys, "_cell"]
    earlier = F.coalesce(F.sum("_sum").over(before(*keys).orderBy("_cell")), F.lit(0))
    base = sums.select(*[F.col(c).alias(f"_b{n}") for n, c in enumerate(own)], earlier.alias("_base"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b{n}")) for n, c in enumerate(own)])  # null keys are a key
    inside = F.coalesce(F.sum("_amount").over(before(*keys, "_cell").orderBy(*order)), F.lit(0))
    if not nulls:
        base, same = base.withColumnsRenamed({f"_b{n}": c for n, c in enumerate(own)}), own
    return placed.withColumn(name, inside).join(base, same).select(*df.columns, (F.col(name) + F.col("_base")).alias(name))


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """column, idx: dense numbers from 0 in sorted order; nulls get none."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return running(values, column, "_one", "idx").select(column, F.col("idx").cast("long").alias("idx"))


def quantiles(df: DataFrame, column: str, points: list[float]) -> list[float]:
    """Exact quantiles, linear between neighbours; none for a column without values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    few = counts.orderBy(F.xxhash64(column), column).limit(SAMPLE + 1).collect()
    if not few:
        return []
    whole = len(few) <= SAMPLE  # then these are all values
    total = sum(r[1] for r in few) if whole else counts.agg(F.sum("_n")).first()[0]
    at = [p * (total - 1) for p in points]
    wanted = sorted({f(h) for h in at for f in (math.floor, math.ceil)})
    if whole:
        few = sorted((float(r[0]), r[1]) for r in few)
        found = [(x, end - n, n) for (x, n), end in zip(few, accumulate(n for _, n in few), strict=True)]
    else:
        ranked = running(counts, column, "_n", "_before")
        holds = F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("_before")) & (w < F.col("_before") + F.col("_n")))
        found = [(float(r[0]), r[1], r[2]) for r in ranked.where(holds).select(column, "_before", "_n").collect()]
    value = {w: next(x for x, before, n in found if before <= w < before + n) for w in wanted}
    return [value[math.floor(h)] if h == math.floor(h) else (math.ceil(h) - h) * value[math.floor(h)] + (h - math.floor(h)) * value[math.ceil(h)] for h in at]
