"""Exact quantiles of groups of any size, and profiles kept as mergeable sketches.

A group's quantile needs one or two of its order statistics. Their place is narrowed by histograms: the interval that holds
the wanted rank is cut into BINS bins, which are counted (with their own smallest and largest value) over all rows, and the
bin with the rank is the next interval. Once an interval holds at most `most` values, or only one distinct value, these are
looked at themselves. So no task holds more than `most` values of a group, and counts are combined before they are shuffled.
Groups of at most `most` values, known by a count, become one list each straight from the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import io

BINS = 1024
MOST = 8192
PASSES = 8


def _bin(x: Column, bins: int) -> Column:
    """The bin of x in lo..hi; halves keep the width of very wide intervals finite."""
    share = (x / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, points: list[float], names: list[str], most: int = MOST, bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """keys and a column a point: exact quantiles, linear between neighbours. Nulls and NaN are left out, groups without
    values have no row; null keys are a group.

    Intervals that still hold more than `most` values after `passes` passes (values over hundreds of orders of magnitude)
    are ordered by a window, which Spark spills to disk.
    """
    every = df.select(F.struct(*[F.col(k) for k in keys]).alias("key"), F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    sizes = every.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    base = io.stored(sizes.where(F.col("n") > most), "ends")
    large = base.select("key")
    whole = every if base.isEmpty() else every.join(large, "key", "left_anti")
    lists = whole.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("v")).withColumn("n", F.size("v"))
    small = lists.select(*_results(keys, points, names, lambda at: F.get("v", at.cast("int"))))
    if base.isEmpty():
        return small
    keyed = every.join(large, "key", "left_semi")
    at = [F.lit(p) * (F.col("n") - 1) for p in points]
    wanted = F.array_distinct(F.array(*[f(h).cast("long") for h in at for f in (F.floor, F.ceil)]))
    todo = base.select("key", F.explode(wanted).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    settled = (F.col("lo") == F.col("hi")) | (F.col("inside") <= most)
    for _ in range(passes):
        todo = io.stored(todo, "intervals")
        wide = todo.where(~settled).select("key", "lo", "hi").distinct()
        if wide.isEmpty():
            break
        inside = keyed.join(wide, "key").where("x >= lo AND x <= hi")
        counted = inside.groupBy("key", "lo", "hi", _bin(F.col("x"), bins).alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        below = W.partitionBy("key", "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most `bins` rows
        cut = counted.withColumn("below", F.coalesce(F.sum("c").over(below), F.lit(0)))
        place = F.col("rank") - F.col("before")
        next_ones = todo.where(~settled).join(cut, ["key", "lo", "hi"]).where((place >= F.col("below")) & (place < F.col("below") + F.col("c")))
        next_ones = next_ones.select("key", "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("c").alias("inside"))
        todo = todo.where(settled).unionByName(next_ones)
    todo = io.stored(todo, "intervals")
    alone = todo.where("lo = hi").select("key", "rank", F.col("lo").alias("value"))
    some = todo.where("lo < hi")
    few = some.where(F.col("inside") <= most).groupBy("key", "lo", "hi", "before").agg(F.collect_list("rank").alias("ranks"))  # at most two a point
    listed = keyed.join(few, "key").where("x >= lo AND x <= hi").groupBy("key", "lo", "hi", "before", "ranks").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    picked = listed.select("key", F.explode("ranks").alias("rank"), "xs", "before").select("key", "rank", F.get("xs", (F.col("rank") - F.col("before")).cast("int")).alias("value"))
    many = some.where(F.col("inside") > most).select("key", "lo", "hi", "before").distinct()
    order = W.partitionBy("key", "lo", "hi").orderBy("x")
    ranked = keyed.join(many, "key").where("x >= lo AND x <= hi").select("key", (F.row_number().over(order) - 1 + F.col("before")).alias("rank"), F.col("x").alias("value"))
    found = alone.unionByName(picked).unionByName(ranked.join(todo.select("key", "rank"), ["key", "rank"], "left_semi"))
    values = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    joined = values.join(base.select("key", "n"), "key")
    return small.unionByName(joined.select(*_results(keys, points, names, lambda at: F.element_at("v", at))))


def _results(keys: list[str], points: list[float], names: list[str], value) -> list[Column]:
    """keys and the quantiles from n and value, which gives the value at a place from 0."""

    def between(p: float) -> Column:
        h = F.lit(p) * (F.col("n") - 1)
        low, high = (value(f(h).cast("long")) for f in (F.floor, F.ceil))
        return F.when(F.floor(h) == h, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return [*[F.col("key")[k].alias(k) for k in keys], *[between(p).alias(n) for p, n in zip(points, names, strict=True)]]


# Profiles


def sketch_parts(df: DataFrame, columns: list[str], by: str, log_size: int = 12, k: int = 400) -> DataFrame:
    """by, column, count, nulls, min, max, sum, squares, distinct and order sketches: one row a part and column, to be stored.

    A part is a value of `by`, such as a day. Distinct counts err by about 1.04 / sqrt(2 ** log_size), ranks by about 1.7 / k.
    """
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_r")
    rows = df.select(F.col(by), long).select(by, "_r.column", "_r.x")
    return rows.groupBy(by, "column").agg(
        F.count("x").alias("count"),
        F.count(F.when(F.col("x").isNull(), 1)).alias("nulls"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.sum("x").alias("sum"),
        F.sum(F.col("x") * F.col("x")).alias("squares"),
        F.hll_sketch_agg(F.when(F.col("x").isNotNull(), F.xxhash64("x")), log_size).alias("distinct"),
        F.kll_sketch_agg_double("x", k).alias("order"),
    )


def add_parts(df: DataFrame, columns: list[str], by: str, path: str, **sizes) -> list:
    """Sketch the parts of df that the table at path lacks, and add them; returns their values of `by`. Only those parts are read."""
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path).select(by).distinct() if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root) else None
    parts = df.select(by).distinct()
    new = [r[0] for r in (parts if known is None else parts.join(known, by, "left_anti")).collect()]
    if new:
        sketch_parts(df.where(F.col(by).isin(new)), columns, by, **sizes).write.mode("append").parquet(path)
    return sorted(new)


def merged_profile(parts: DataFrame) -> DataFrame:
    """The profile of all parts together: column, count, nulls, n_distinct, min, max, mean, std, q1, q2, q3."""
    sums = parts.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("count", "nulls", "sum", "squares")],
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
        F.kll_merge_agg_double("order").alias("_o"),
    )
    mean = F.try_divide("sum", "count")
    spread = F.when(F.col("count") > 1, F.sqrt(F.greatest((F.col("squares") - F.col("sum") * mean) / (F.col("count") - 1), F.lit(0.0))))
    quarters = [F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_o", F.lit(q))).alias(f"q{n + 1}") for n, q in enumerate((0.25, 0.5, 0.75))]
    return sums.select("column", "count", "nulls", "n_distinct", "min", "max", mean.alias("mean"), spread.alias("std"), *quarters)


def stated_errors(log_size: int = 12, k: int = 400) -> tuple[float, float]:
    """(relative error of a distinct count, error of a rank as a share of the rows), each met in about two of three cases or more."""
    return 1.04 / math.sqrt(2**log_size), 1.7 / k
