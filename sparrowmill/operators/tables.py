"""Joins, aggregates, windows and set operations that the pipelines are made of."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import days_between
from ..sources import io
from .quantiles import grouped_quantiles
from .ranks import quantiles, ranges, running_within


def left_chain(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def left_fill(base: DataFrame, other: DataFrame, keys: list[str], column: str, value=0) -> DataFrame:
    return base.join(other, keys, "left").withColumn(column, F.coalesce(column, F.lit(value)))


def outer_on(key: str, *frames: DataFrame) -> DataFrame:
    """Full outer join of feature tables that hold a key once each."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def lookup(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Replace a column through a two-column table; unmapped values become null. Spark broadcasts the table if it is small."""
    pairs = mapping.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    return df.join(pairs, F.col(column) == F.col("_from"), "left").withColumn(column, F.col("_to")).drop("_from", "_to")


def through_attribute(tx: DataFrame, items: DataFrame, user: str, item: str, attribute: str) -> DataFrame:
    """user, item once each: all items that share the attribute with one of the user's.

    An item of one attribute is met through that alone, so only pairs with items of several attributes are made distinct.
    """
    tagged = items.select(item, attribute).distinct()
    liked = tx.join(tagged, item).select(user, attribute).distinct()
    counted = tagged.where(F.col(attribute).isNotNull()).groupBy(item).agg(F.collect_list(attribute).alias("_of"))
    one = counted.where(F.size("_of") == 1).select(item, F.get("_of", F.lit(0)).alias(attribute))
    several = counted.where(F.size("_of") > 1).select(item, F.explode("_of").alias(attribute))
    met = lambda part: liked.join(part, attribute).select(user, item)
    return met(one).unionByName(met(several).distinct())


def distinct_then_count(df: DataFrame, pair: list[str], by: str, name: str) -> DataFrame:
    return df.select(*pair).distinct().groupBy(by).agg(F.count("*").alias(name))


def days_to_newest(df: DataFrame, key: str, date_col: str) -> DataFrame:
    """Days from each key's first and last date to the newest of all."""
    by = df.groupBy(key).agg(F.min(date_col).alias("first"), F.max(date_col).alias("last"))
    top = by.agg(F.max("last").alias("newest"))
    joined = by.crossJoin(F.broadcast(top))  # one row
    return joined.select(key, days_between("newest", "first").alias("days_since_first"), days_between("newest", "last").alias("days_since_last"))


def share_of(df: DataFrame, key: str, condition: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias(name))


def rebuy_share(df: DataFrame, user: str, item: str, name: str = "rebuy_share") -> DataFrame:
    """Share of an item's buyers who bought it more than once."""
    return df.groupBy(user, item).agg(F.count("*").alias("n")).groupBy(item).agg(F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias(name))


_STATS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def deep_features(df: DataFrame, parent: str, columns: list[str], date_col: str, windows: list[int | None], suffix: str) -> DataFrame:
    """sum, mean, median, max, min of columns and a count for each parent and window of days.

    Names end in _{n}_{suffix}, or _{suffix} for the window None (everything). A parent with nothing in a window has nulls.
    Medians are exact and hold a bounded number of a parent's values at a time; the others come from one pass.
    """
    top = df.agg(F.max(date_col).alias("newest"))
    dated = io.stored(df.crossJoin(F.broadcast(top)).select(parent, *columns, date_col, "newest"), "dated")  # read three times
    aggs, cases, medians = [], [], []
    for n in windows:
        inside = F.lit(True) if n is None else F.col(date_col) >= F.date_sub("newest", n)
        end = f"_{suffix}" if n is None else f"_{n}_{suffix}"
        aggs += [f(F.when(inside, F.col(c))).alias(f"{name}_{c}{end}") for c in columns for name, f in _STATS.items()]
        aggs.append(F.count(F.when(inside, 1)).alias(f"count{end}"))
        for c in columns:
            cases.append(F.struct(F.lit(len(medians)).alias("case"), F.when(inside, F.col(c).cast("double")).alias("x")))
            medians.append(f"median_{c}{end}")
    long = dated.select(parent, F.inline(F.array(*cases)))
    found = grouped_quantiles(long, [parent, "case"], "x", [0.5], ["median"])
    wide = found.groupBy(parent).agg(*[F.max(F.when(F.col("case") == n, F.col("median"))).alias(name) for n, name in enumerate(medians)])
    made = dated.groupBy(parent).agg(*aggs)
    keep = [c for c in made.columns if c != parent]
    return made.join(wide.withColumnRenamed(parent, "_parent"), F.col(parent).eqNullSafe(F.col("_parent")), "left").select(parent, *keep, *medians)


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """group, low, q1, mid, q3, high: the five numbers of a box plot, exact, with a bounded number of a group's values at a time."""
    ends = df.where(F.col(column).isNotNull()).groupBy(group).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    inner = grouped_quantiles(df, [group], column, [0.25, 0.5, 0.75], ["q1", "mid", "q3"]).withColumnRenamed(group, "_group")
    return ends.join(inner, F.col(group).eqNullSafe(F.col("_group"))).select(group, "low", "q1", "mid", "q3", "high")


def width(df: DataFrame, vector: str) -> int:
    """The length of the longest vector."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def mean_vector(df: DataFrame, key: str, vector: str, name: str = "mean_vector", width: int | None = None) -> DataFrame:
    """Elementwise mean, one row a key and task in the shuffle; vectors may differ in length. width: of the longest, if known."""
    some = df.where(F.size(vector) > 0)
    n = width or some.agg(F.max(F.size(vector))).first()[0] or 0
    means = some.groupBy(key).agg(F.max(F.size(vector)).alias("_n"), *[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(n)])
    every = F.array(*[F.col(f"_m{i}") for i in range(n)]) if n else F.array().cast("array<double>")
    return means.select(key, F.slice(every, 1, F.col("_n")).alias(name))


def profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row per column: count, nulls, distinct, min, max, mean, std from one pass, and the quartiles q1, q2, q3."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        quarters = quantiles(df.select(x.alias(c)), c, [0.25, 0.5, 0.75]) or [None] * 3
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), distinct(F.col(c)).alias("n_distinct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), *[F.lit(q).cast("double").alias(f"q{n + 1}") for n, q in enumerate(quarters)]).alias(c))
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*columns)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def head_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def top_lists(df: DataFrame, group: str, item: str, score: str, k: int | None, name: str = "prediction") -> DataFrame:
    """group and its k best items (None: all) as a list, ties to the smaller item. Null groups are dropped."""
    top = df.where(F.col(group).isNotNull()).withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), item)))
    top = top if k is None else top.where(F.col("_rank") <= k)
    listed = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rank", item))).alias("_l"))
    return listed.select(group, F.transform("_l", lambda s: s[item]).alias(name))


def average_gap(df: DataFrame, user: str, date_col: str, name: str = "average_gap") -> DataFrame:
    """Mean days between distinct dates of a user, rounded down; one date gives null."""
    days = df.select(user, date_col).distinct()
    gap = days_between(date_col, F.lag(date_col).over(W.partitionBy(user).orderBy(date_col)))
    return days.withColumn("gap", gap).groupBy(user).agg(F.floor(F.avg("gap")).alias(name))


def order_index(df: DataFrame, user: str, item: str, time: str, tie: str) -> DataFrame:
    """Place of a row among its user's and its item's, from 0, by time. One key's rows are numbered by ranges of time."""
    cell = ranges(df.select(time).where(F.col(time).isNotNull()).distinct(), time)
    cell = F.when(F.col(time).isNull(), -1).otherwise(cell)
    placed = running_within(df, [user], [time, tie], cell, F.lit(1), "order")
    placed = running_within(placed, [item], [time, tie], cell, F.lit(1), "u_order")
    return placed.select(*df.columns, "order", "u_order")


HOT_ROWS = 1_000_000


def refine_times(df: DataFrame, user: str, time: str, tie: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Make a user's times strictly increasing: walking in order, a time not above the one before gets a growing bump. Null
    times stay.

    A user's rows stream through one task in order, which holds a time and a bump and no list; users of more than hot_rows
    rows are cut into ranges of time instead (see _refine_hot).
    """
    counts = df.groupBy(user).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    path = io.scratch(df.sparkSession, "hot-users")
    io.write_parquet(counts.select(F.col(user).alias("_hot")), path)
    hot = df.sparkSession.read.parquet(path)
    if hot.isEmpty():
        return _walk_times(df, user, time, tie)
    same = F.col(user).eqNullSafe(F.col("_hot"))
    return _walk_times(df.join(hot, same, "left_anti"), user, time, tie).unionByName(_refine_hot(df.join(hot, same, "left_semi"), user, time, tie))


def _walk_times(df: DataFrame, user: str, time: str, tie: str) -> DataFrame:
    at, who = df.columns.index(time), df.columns.index(user)

    def walk(batches):
        current, last, gap = object(), None, 1
        for b in batches:
            out = []
            for u, t in zip(b.column(who).to_pylist(), b.column(at).to_pylist(), strict=True):
                if u != current:
                    current, last, gap = u, t, 1
                elif t is not None and last is not None and t <= last:
                    last, gap = t + gap, gap + 1
                elif t is not None:
                    last = t
                out.append(None if t is None else last)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return df.repartition(user).sortWithinPartitions(user, time, tie).mapInArrow(walk, df.schema)


def _refine_hot(df: DataFrame, user: str, time: str, tie: str, rounds: int = 50) -> DataFrame:
    """The same times from scans over ranges of time, whose carried states are counts and last places.

    A row is bumped if its time equals the one before, or if the one before was bumped at least as far as the step between them;
    how far is one more than the bumps so far. From the equal times alone the bumps are counted, then the rows these reach,
    and again until nothing changes: bumps only add, so this ends at the walk's own result.
    """
    spark, kept = df.sparkSession, df.columns

    def stored(made: DataFrame) -> DataFrame:
        path = io.scratch(spark, "refined")
        io.write_parquet(made, path)
        return spark.read.schema(made.schema).parquet(path)

    known = df.where(F.col(time).isNotNull())
    cell = ranges(known.select(time).distinct(), time)
    order = [time, tie, "_row"]
    row = running_within(stored(known.withColumn("_row", F.monotonically_increasing_id())), [user], order, cell, F.lit(1), "_at").withColumn("_cell", cell)
    inside = W.partitionBy(user, "_cell").orderBy("_at")
    lasts = row.groupBy(user, "_cell").agg(F.max(time).alias("_t"))
    before = lasts.select(user, "_cell", F.max("_t").over(W.partitionBy(user).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)).alias("_t"))  # a row a range
    timed = row.join(before.select(F.col(user).alias("_u"), F.col("_cell").alias("_c"), "_t"), F.col(user).eqNullSafe(F.col("_u")) & (F.col("_cell") == F.col("_c")))
    step = F.col(time) - F.coalesce(F.lag(time).over(inside), F.col("_t"))
    now = stored(timed.withColumn("_step", step).select(*kept, "_at", "_cell", "_step").withColumn("_bump", F.coalesce(F.col("_step") == 0, F.lit(False))))
    total = now.where("_bump").count()
    for _ in range(rounds):
        counted = running_within(now, [user], ["_at"], F.col("_cell"), F.col("_bump").cast("long"), "_bumps")
        breaks = (F.col("_step") > F.col("_bumps")) | F.col("_step").isNull()
        marked = counted.withColumns({"_tie": F.when(F.col("_step") == 0, F.col("_at")), "_break": F.when(breaks, F.col("_at"))})
        ends = marked.groupBy(user, "_cell").agg(F.max("_tie").alias("_tie0"), F.max("_break").alias("_break0"))
        earlier = W.partitionBy(user).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(F.col(user).alias("_u"), F.col("_cell").alias("_c"), F.max("_tie0").over(earlier).alias("_tie0"), F.max("_break0").over(earlier).alias("_break0"))
        joined = marked.join(carried, F.col(user).eqNullSafe(F.col("_u")) & (F.col("_cell") == F.col("_c")))
        upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
        last = lambda c: F.coalesce(F.max(c).over(upto), F.col(f"{c}0"), F.lit(-1))  # noqa: E731, B023
        now = stored(joined.withColumn("_bump", last("_tie") > last("_break")).select(*kept, "_at", "_cell", "_step", "_bump", "_bumps"))
        found = now.where("_bump").count()
        if found == total:
            moved = F.when(F.col("_bump"), F.col(time) + 1 + F.col("_bumps")).otherwise(F.col(time)).cast(df.schema[time].dataType)
            return now.withColumn(time, moved).select(*kept).unionByName(df.where(F.col(time).isNull()))
        total, now = found, now.drop("_bumps")
    return _walk_times(df, user, time, tie)


def recency_rank(df: DataFrame, group: str, time: str, tie: str, name: str = "recency") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(F.desc(time), F.desc(tie))) - 1)


def prefixes(df: DataFrame, user: str, item: str, order: list[str], length: int = 50) -> DataFrame:
    """Every prefix of two or more items of a user's sequence that has a next item, cut to its last `length` items."""
    w = W.partitionBy(user).orderBy(*order)
    seq = F.collect_list(item).over(w.rowsBetween(-(length - 1), 0))
    out = df.select(user, seq.alias("sequence"), F.lead(item).over(w).alias("target"), F.row_number().over(w).alias("n_items"))
    return out.where((F.col("n_items") >= 2) & F.col("target").isNotNull())


def most_sold(df: DataFrame, item: str, k: int) -> DataFrame:
    return df.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(k)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def except_items(users: DataFrame, items: DataFrame, seen: DataFrame, user: str, item: str) -> DataFrame:
    """All items that a user has not seen: users x items by nature, for callers that want them all."""
    return users.select(user).distinct().join(items.select(item).distinct()).join(seen.select(user, item), [user, item], "left_anti")
