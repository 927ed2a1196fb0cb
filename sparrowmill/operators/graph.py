"""Interaction graphs as edge tables: ids, ordered edges, time slices, k-hop neighbourhoods, negatives, consensus.

Neighbourhoods of k hops are walked in memory, a range of time and what its roots can meet before it at once (walks.py).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import concat_key, dot, epoch_seconds, hash_key
from ..sources import io
from . import walks
from .ranks import dense_ids, ranges, running_within
from .tables import order_index, prefixes, refine_times


def extract_transactions(events: DataFrame) -> DataFrame:
    return events.select(F.col("session").alias("customer_id"), concat_key("aid", "type").alias("article_id"), F.col("ts").alias("timestamp"))


def entities(tx: DataFrame, column: str) -> DataFrame:
    return tx.select(column).distinct()


def preprocess(*subsets: DataFrame | None) -> DataFrame:
    """Union of the subsets there are; a column named date becomes epoch seconds."""
    given = [s for s in subsets if s is not None]
    if not given:
        raise ValueError("no transactions")
    both = reduce(lambda a, b: a.unionByName(b), given)
    time = epoch_seconds("date") if "date" in both.columns else F.col("timestamp")
    return both.select(F.col("customer_id").alias("user_id"), F.col("article_id").alias("item_id"), time.alias("time"))


def map_ids(tx: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tx with dense ids, and the two mappings."""
    users, items = dense_ids(tx, "user_id"), dense_ids(tx, "item_id")
    mapped = tx.join(users.withColumnRenamed("idx", "u"), "user_id").join(items.withColumnRenamed("idx", "i"), "item_id")
    return mapped.select(F.col("u").alias("user_id"), F.col("i").alias("item_id"), "time"), users, items


def build_edges(tx: DataFrame, tie: str) -> DataFrame:
    """user, item, time (strictly increasing for each user), order, u_order. Both directions are the same rows."""
    refined = refine_times(tx, "user_id", "time", tie)
    return order_index(refined, "user_id", "item_id", "time", tie)


def time_slice(edges: DataFrame, start: int, end: int, closed: bool = False) -> DataFrame:
    """start <= time < end, or <= end to predict."""
    t = F.col("time")
    return edges.where((t >= start) & ((t <= end) if closed else (t < end)))


def _latest(df: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def counted_edges(edges: DataFrame) -> DataFrame:
    """user_id, item_id, time, _copies: each edge once, with the number of its copies. Edges without a time are before nothing."""
    return edges.where(F.col("time").isNotNull()).groupBy("user_id", "item_id", "time").agg(F.count("*").alias("_copies"))


def _number(edges: DataFrame, by: str, other: str, cell, name: str) -> DataFrame:
    """counted_edges with the number of each by time within `by`: that of its last copy, from 0."""
    before = running_within(edges, [by], ["time", other], cell("time"), F.col("_copies"), name)
    return before.withColumn(name, F.col(name) + F.col("_copies") - 1)


def adjacency(edges: DataFrame, by: str, other: str, width: int, cell) -> DataFrame:
    """counted_edges with _pos, their number by time within `by`, and _cell, the cell of `width` numbers that it falls into.

    The last k edges up to any time are a run of numbers, so they are found by (by, _cell) however many edges `by` has.
    """
    return _number(edges, by, other, cell, "_pos").withColumn("_cell", F.floor(F.col("_pos") / width))


def _in_cells(reached: DataFrame, k: int) -> DataFrame:
    """A row for each cell of k numbers that an ask's edges fall into."""
    return reached.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_first") / k), F.floor((F.col("_upto") - 1) / k))))


#: Edges of a range of time, about: a task holds them, and what its roots meet before them.
RANGE_EDGES = 1_000_000
#: Roots that a task walks from side by side.
STEP = 1000


def _differences(pairs: DataFrame, ends: DataFrame, numbered: DataFrame, by: str, k: int) -> DataFrame:
    """_range and an edge: what a root of the range can meet at each pair (_range, by), that is the last k edges of `by` before the
    range and those in it up to its last root (ends), each once. Counts go by ranges, so a popular `by` spreads over tasks."""
    counts = numbered.groupBy(by, "_range").agg(F.sum("_copies").alias("_n")).withColumn("_asks", F.lit(0))
    asks = pairs.select(by, "_range", F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_asks"))
    line = counts.unionByName(asks).where(F.col(by).isNotNull()).groupBy(by, "_range").agg(F.sum("_n").alias("_n"), F.max("_asks").alias("_asks"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = line.withColumn("_before", before).where("_asks = 1").select(by, "_range", F.greatest(F.col("_before") - k, F.lit(0)).alias("_first"), (F.col("_before") + F.col("_n")).alias("_upto")).where("_upto > 0")
    number = "_in_user" if by == "user_id" else "_in_item"
    placed = numbered.select("user_id", "item_id", "time", "_in_user", "_in_item", F.floor(F.col(number) / k).alias("_cell"))
    met = _in_cells(asked, k).join(placed, [by, "_cell"]).where((F.col(number) >= F.col("_first")) & (F.col(number) < F.col("_upto")))
    return met.join(F.broadcast(ends), "_range").where("time <= _end").select("_range", "user_id", "item_id", "time", "_in_user", "_in_item")


def _ranged(edges: DataFrame) -> tuple[DataFrame, int, Callable[[str], Column]]:
    """counted_edges, stored, with their numbers within users and items and the _range of their time; the number of ranges; the
    range of another column of times."""
    e = counted_edges(edges)
    times = e.select("time").distinct()
    cell = ranges(times, "time")
    numbered = io.stored(_number(_number(e, "item_id", "user_id", lambda c: cell, "_in_item"), "user_id", "item_id", lambda c: cell, "_in_user"), "numbered")
    parts = max(1, math.ceil(numbered.count() / RANGE_EDGES))
    found = numbered.select("time").distinct()
    return numbered.withColumn("_range", ranges(found, "time", parts)), parts, lambda c: ranges(found, "time", parts, of=c)


def _surroundings(numbered: DataFrame, roots: DataFrame, hops: int, item_max: int, user_max: int) -> DataFrame:
    """_range and edges, stored: all that walks of the range's roots (_range, user_id, until) can meet, each once for a range."""
    ends = roots.groupBy("_range").agg(F.max("until").alias("_end"))  # a row for each range
    users, met = roots.select("_range", "user_id"), None
    for _ in range(1, hops):
        items = _differences(users, ends, numbered, "user_id", item_max).select("_range", "item_id").distinct()
        met = io.stored(_differences(items, ends, numbered, "item_id", user_max), "met")
        users = users.union(met.select("_range", "user_id")).distinct()
    own = _differences(users, ends, numbered, "user_id", item_max)
    return io.stored(own if met is None else own.union(met).distinct(), "surroundings")


def _walked(around: DataFrame, roots: DataFrame, deal: list[str], order: list[str], parts: int, run, schema) -> list[DataFrame]:
    """What run (see walks) makes of each range's edges and roots. Roots are dealt by `deal` to several tasks for each range, each
    of which gets the range's edges: the fewer, the more ranges there are. Each has a number of partitions of its own, for Spark
    puts those of equal parts of a union into one task."""
    tasks = max(2, min(8, math.ceil(4 * around.sparkSession.sparkContext.defaultParallelism / parts)))
    held = around.withColumn("_kind", F.lit(0))
    asked = roots.withColumn("_kind", F.lit(1)).withColumn("_deal", F.pmod(F.xxhash64(*deal), F.lit(tasks)))
    made = []
    for n in range(tasks):
        rows = held.unionByName(asked.where(F.col("_deal") == n).drop("_deal", "user_id"), allowMissingColumns=True)
        made.append(rows.repartitionById(parts + n, F.col("_range").cast("int")).sortWithinPartitions("_range", "_kind", *order).mapInArrow(run, schema))
    return made


def khop(edges: DataFrame, roots: DataFrame, key: list[str], hops: int, item_max: int = 50, user_max: int = 50) -> DataFrame:
    """key, user_id, item_id, time: edges around each root (key columns, user_id, until): its latest items, then for each
    of hops - 1 rounds the latest users of the items met, at most user_max new ones by largest id, and their items.

    Only edges up to the root's time count; a key has one time. Edges are numbered by time within users and within items once. Time is
    cut into ranges of about RANGE_EDGES edges; a range's edges, with the latest before it of the users and items that its roots
    meet, go to a few tasks, which walk from the roots of that range in memory. So what is shuffled grows with the edges and not
    with what roots find, and what they find is not shuffled. Edges are written to the shared folder.
    """
    numbered, parts, at = _ranged(edges)
    asked = roots.where(F.col("user_id").isNotNull() & F.col("until").isNotNull()).select(*key, "user_id", "until").withColumn("_range", at("until"))
    whole = asked.groupBy(*key).agg(F.first("until").alias("until"), F.first("_range").alias("_range"), F.collect_set("user_id").alias("_users"))
    around = _surroundings(numbered, asked.select("_range", "user_id", "until"), hops, item_max, user_max)
    types = dict(asked.dtypes) | {c: t for c, t in edges.dtypes if c in ("user_id", "item_id", "time")}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*key, "user_id", "item_id", "time"])
    return reduce(lambda a, b: a.union(b), _walked(around, whole, key, key, parts, walks.around(key, hops, item_max, user_max, STEP), schema))


def user_samples(edges: DataFrame, length: int = 50, predict: bool = False) -> DataFrame:
    """user, sequence, target, n_items of every prefix of two or more items; to predict: of all items, with target 0."""
    if not predict:
        return prefixes(edges, "user_id", "item_id", ["time", "item_id"], length)
    last = _latest(edges, ["user_id"], length, F.desc("time"), F.desc("item_id"))
    listed = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("time", "item_id"))).alias("_l"))
    counts = edges.groupBy("user_id").agg(F.count("*").cast("int").alias("n_items"))
    return listed.join(counts, "user_id").select("user_id", F.transform("_l", lambda s: s["item_id"]).alias("sequence"), F.lit(0).cast(edges.schema["item_id"].dataType).alias("target"), "n_items")


def _prefix_roots(edges: DataFrame) -> DataFrame:
    """root, n_items, until: the last time of every prefix of two or more items that an item follows."""
    at = W.partitionBy("user_id").orderBy("time", "item_id")
    steps = edges.select(F.col("user_id").alias("root"), F.col("time").alias("until"), F.row_number().over(at).alias("n_items"), F.lead("item_id").over(at).alias("target"))
    return steps.where("n_items >= 2 and target is not null").select("root", "n_items", "until")


def sample_graphs(edges: DataFrame, hops: int, item_max: int = 50, user_max: int = 50) -> DataFrame:
    """root, n_items, user_id, item_id, time: the k-hop neighbourhood of every prefix that user_samples has, up to its last time."""
    roots = _prefix_roots(edges).withColumn("user_id", F.col("root"))
    return khop(edges, roots, ["root", "n_items"], hops, item_max, user_max)


def _merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last: spans of the same keys that overlap or touch as one."""
    line = W.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(line.rowsBetween(W.unboundedPreceding, -1))
    begins = spans.withColumn("_new", F.when(F.col("first") <= reached + 1, 0).otherwise(1))
    return begins.withColumn("_run", F.sum("_new").over(line)).groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def prefix_changes(edges: DataFrame, hops: int, item_max: int = 50, user_max: int = 50) -> DataFrame:
    """root, user_id, item_id, time, first, last: the neighbourhoods of sample_graphs as spans of prefixes that hold an edge.

    Prefixes are walked where the edges of their range of time are, as in khop, and a range's spans are made there. Only those that
    reach a root's first or last prefix of a range, and may go on in another, are shuffled to become one. A span is as long as it
    can be. Numbered edges, prefixes and what each range can meet are written to the shared folder.
    """
    numbered, parts, at = _ranged(edges)
    line = W.partitionBy("root").orderBy("n_items")
    steps = _prefix_roots(edges).where(F.col("root").isNotNull() & F.col("until").isNotNull()).withColumn("_range", at("until"))
    n, beside = F.col("n_items"), lambda f, step: F.when(f("n_items").over(line) == n + step, f("_range").over(line))
    back = F.coalesce(beside(F.lag, -1) != F.col("_range"), F.lit(False))
    after = beside(F.lead, 1)
    on = F.when(after.isNull(), 0).when(after == F.col("_range"), 1).otherwise(2)
    roots = io.stored(steps.withColumn("_back", back).withColumn("_on", on).withColumn("_users", F.array("root")), "prefixes")
    around = _surroundings(numbered, roots.select("_range", F.col("root").alias("user_id"), "until"), hops, item_max, user_max)
    types = dict(edges.dtypes)
    schema = ", ".join(f"{c} {t}" for c, t in [("root", types["user_id"]), *((c, types[c]) for c in ("user_id", "item_id", "time")), ("first", "int"), ("last", "int")])
    made = lambda of, open_: reduce(lambda a, b: a.union(b), _walked(around, of, ["root"], ["root", "n_items"], parts, walks.spans(hops, item_max, user_max, STEP, open_), schema))
    closed = made(roots, False)
    if parts == 1:
        return closed
    across = F.max(F.col("_back") | (F.col("_on") == 2)).over(W.partitionBy("root", "_range"))
    return closed.union(_merged(made(roots.withColumn("_across", across).where("_across").drop("_across"), True), ["root", "user_id", "item_id", "time"]))


def graphs_at(changes: DataFrame) -> DataFrame:
    """root, n_items, user_id, item_id, time: the neighbourhoods that prefix_changes holds, written out for each prefix."""
    return changes.select("root", F.explode(F.sequence("first", "last")).alias("n_items"), "user_id", "item_id", "time")


def split(edges: DataFrame, predict: bool, test: bool, val: bool) -> DataFrame:
    """Rows with a split: the last is for prediction, the next last for test, the next for validation, as switched on;
    validation only if something is left to train on."""
    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("time"), F.desc("item_id")))
    total = F.count("*").over(W.partitionBy("user_id"))
    flags = [n for n, on in (("predict", predict), ("test", test)) if on]
    label = F.lit("train")
    if val:
        place = len(flags) + 1
        label = F.when((F.col("back") == place) & (F.col("total") > place), "val").otherwise(label)
    for n, name in enumerate(flags):
        label = F.when(F.col("back") == n + 1, name).otherwise(label)
    return edges.withColumn("back", back).withColumn("total", total).withColumn("split", label).drop("back", "total")


def negatives(edges: DataFrame) -> DataFrame:
    """user, item of all items that a user has not met: users x items rows by definition, so only for small catalogues;
    sample_negatives draws a few for each user of a large one."""
    users, items = edges.select("user_id").distinct(), edges.select("item_id").distinct()
    return users.join(items).join(edges.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def sample_negatives(edges: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """user, item: n items each that a user has not met, the next ones on a ring of hashed items from the user's place.

    The ring is cut into arcs that hold about 4 n items each, so a user meets a few arcs, never all items. A visit to an arc is
    one row with what the user has met there, and leaves with at most n items.
    """
    items = edges.select("item_id").distinct()
    total = items.count()
    arcs = max(1, total // max(1, 4 * n))
    place = lambda c: F.conv(F.substring(hash_key(c, seed=seed), 1, 8), 16, 10).cast("long")
    ring = items.withColumn("h", place("item_id")).withColumn("arc", F.shiftright(F.col("h") * arcs, 32))
    met = edges.select("user_id", "item_id").distinct()
    need = met.groupBy("user_id").agg(F.count("*").alias("seen")).withColumn("at", F.shiftright(place("user_id") * arcs, 32))
    span = F.least(F.lit(arcs - 1), F.ceil((F.col("seen") + n) / F.lit(2.0 * n)).cast("long"))
    visits = need.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), span)).alias("k"), "at").select("user_id", "k", F.pmod(F.col("at") + F.col("k"), F.lit(arcs)).alias("arc"))
    known = met.join(ring.select("item_id", "arc"), "item_id").groupBy("user_id", "arc").agg(F.collect_list("item_id").alias("known"))
    copies = max(1, 512 // arcs)  # few arcs are dealt out several times, so that each serves many tasks
    asked = visits.join(known, ["user_id", "arc"], "left").withColumn("copy", F.pmod(F.xxhash64("user_id"), F.lit(copies)))
    arc_items = ring.groupBy("arc").agg(F.collect_list("item_id").alias("items"))  # about 4 n
    arc_items = arc_items.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    fresh = lambda x: ~F.coalesce(F.array_contains("known", x), F.lit(False))
    keyed = F.transform(F.filter("items", fresh), lambda x: F.struct(hash_key(F.col("user_id"), x, seed=seed).alias("h"), x.alias("item_id")))
    offered = asked.join(arc_items, ["arc", "copy"]).select("user_id", "k", F.transform(F.slice(F.sort_array(keyed), 1, n), lambda s: s["item_id"]).alias("offers"))
    before = F.coalesce(F.sum(F.size("offers")).over(W.partitionBy("user_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = offered.withColumn("_left", (F.lit(n) - before).cast("int")).where("_left > 0")
    return left.select("user_id", F.explode(F.slice("offers", F.lit(1), F.col("_left"))).alias("item_id"))


def attention_last(neighbours: DataFrame, key: str, vector: str, time: str, width: int | None = None) -> DataFrame:
    """Softmax attention of the most recent neighbour over all: key, pooled vector. width: of the vectors, if known."""
    n = width or neighbours.agg(F.max(F.size(vector))).first()[0] or 0
    last = neighbours.groupBy(key).agg(F.max_by(vector, time).alias("last"))
    scored = neighbours.join(last, key).withColumn("s", dot("last", vector) / F.sqrt(F.size(vector).cast("double")))
    top = scored.groupBy(key).agg(F.max("s").alias("m"))
    weighted = scored.join(top, key).withColumn("w", F.exp(F.col("s") - F.col("m")))
    sums = weighted.groupBy(key).agg(F.sum("w").alias("all"), *[F.sum(F.col("w") * F.get(vector, F.lit(i))).alias(f"_x{i}") for i in range(n)])
    return sums.select(key, F.array(*[F.col(f"_x{i}") / F.col("all") for i in range(n)]).alias("pooled"))


def unmap(predictions: DataFrame, users: DataFrame, items: DataFrame, column: str = "prediction") -> DataFrame:
    """Lists of dense ids back to the original ids, order kept."""
    long = predictions.select("user_id", F.posexplode(column).alias("pos", "idx"))
    named = long.join(items.select("idx", F.col(items.columns[0]).alias("item")), "idx")
    lists = named.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("l"))
    back = lists.join(users.select(F.col("idx").alias("user_id"), F.col(users.columns[0]).alias("original")), "user_id")
    return back.select(F.col("original").alias("user_id"), F.transform("l", lambda s: s["item"]).alias(column))


def borda(rankings: DataFrame, column: str = "prediction", key: str = "user_id") -> DataFrame:
    """item, score in consensus order: the sum over rankings of the distance from the end; ties by first appearance."""
    long = rankings.select(F.col(key).alias("k"), F.size(column).alias("n"), F.posexplode(column).alias("pos", "item"))
    return long.groupBy("item").agg(F.sum(F.col("n") - 1 - F.col("pos")).alias("score"), F.min(F.struct("k", "pos")).alias("seen"))


def borda_list(rankings: DataFrame, column: str = "prediction", key: str = "user_id", k: int = 20) -> DataFrame:
    """One row: the k first items of the consensus as a list."""
    top = borda(rankings, column, key).orderBy(F.desc("score"), "seen").limit(k)
    ordered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "seen", "item"))).alias("l"))
    return ordered.select(F.transform("l", lambda s: s["item"]).alias(column))


def impute_missing(predictions: DataFrame, users: DataFrame, column: str = "prediction", k: int = 20) -> DataFrame:
    """Users without predictions get the consensus list, which is one row of bounded length."""
    missing = users.select("user_id").distinct().join(predictions.select("user_id"), "user_id", "left_anti")
    return predictions.select("user_id", column).union(missing.crossJoin(F.broadcast(borda_list(predictions, column, k=k))))


def submission(predictions: DataFrame, users: DataFrame, column: str = "prediction", only: DataFrame | None = None) -> DataFrame:
    full = impute_missing(predictions, users, column)
    full = full if only is None else full.join(only.select("user_id").distinct(), "user_id", "left_semi")
    return full.select("user_id", F.array_join(F.col(column).cast("array<string>"), " ").alias(column))
