"""Candidates, features and rankings of a two-stage recommender."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import dot
from ..sources import io
from .frames import fill_counts, newest
from .sampling import quantile_bin
from .tables import head_per_group, mean_vector, through_attribute, top_lists, width
from .walks import places

WINDOWS = (7, 30, None)
TOP = (100, 50, 25)


def _windowed_counts(tx: DataFrame, by: list[str], date_col: str, windows) -> DataFrame:
    """Sales of each key in every window of days, in one pass."""
    dated = tx.crossJoin(F.broadcast(newest(tx, date_col)))
    inside = lambda n: F.lit(True) if n is None else F.col(date_col) >= F.date_sub("newest", n)
    return dated.groupBy(*by).agg(*[F.count(F.when(inside(n), 1)).alias(f"w{i}") for i, n in enumerate(windows)])


def popular(tx: DataFrame, item: str = "article_id", date_col: str = "t_dat", windows=WINDOWS, tops=TOP) -> DataFrame:
    """The best sellers of any window."""
    counts = _windowed_counts(tx, [item], date_col, windows)
    tops_of = [counts.where(F.col(f"w{i}") > 0).orderBy(F.desc(f"w{i}"), item).limit(k).select(item) for i, k in enumerate(tops)]
    return reduce(lambda a, b: a.union(b), tops_of).distinct()


def popular_for_all(tx: DataFrame, customers: DataFrame, **options) -> DataFrame:
    """customer, list of the best sellers: one list of fixed size, joined to all."""
    items = popular(tx, **options).agg(F.array_sort(F.collect_list("article_id")).alias("global_articles"))
    return customers.select("customer_id").crossJoin(F.broadcast(items))


def segment_popular(tx: DataFrame, customers: DataFrame, edges: list[float], age: str = "age", windows=WINDOWS, tops=(50, 25, 15)) -> DataFrame:
    """customer, best sellers of the customer's age bin. Customers whose bin has no sales vanish."""
    binned = customers.select("customer_id", quantile_bin(age, edges).alias("bin"))
    counts = _windowed_counts(tx.join(binned, "customer_id"), ["bin", "article_id"], "t_dat", windows)
    parts = []
    for i, k in enumerate(tops):
        rank = F.row_number().over(W.partitionBy("bin").orderBy(F.desc(f"w{i}"), "article_id"))
        parts.append(counts.where(F.col(f"w{i}") > 0).withColumn("r", rank).where(F.col("r") <= k).select("bin", "article_id"))
    lists = reduce(lambda a, b: a.union(b), parts).distinct().groupBy("bin").agg(F.array_sort(F.collect_list("article_id")).alias("segment_articles"))
    return binned.join(F.broadcast(lists), "bin").select("customer_id", "segment_articles")  # a list of bounded size for each bin


def previously_bought(tx: DataFrame) -> DataFrame:
    return tx.select("customer_id", "article_id").distinct().groupBy("customer_id").agg(F.array_sort(F.collect_list("article_id")).alias("previously_bought"))


def offered_and_bought(customers: DataFrame, top: DataFrame, tx: DataFrame) -> DataFrame:
    """customer, article once each: the few articles of top for every customer, and what a customer bought.

    Pairs with top articles are once by their making, so only purchases are made distinct; of these, top articles of known
    customers are left out.
    """
    known = customers.select("customer_id").distinct()
    marks = top.select(F.col("article_id").alias("_top"), F.lit(True).alias("_is_top"))
    bought = tx.select("customer_id", "article_id").distinct().join(F.broadcast(marks), F.col("article_id").eqNullSafe(F.col("_top")), "left")
    other = bought.where("_is_top is null").select("customer_id", "article_id")
    strangers = bought.where("_is_top").join(known.withColumnRenamed("customer_id", "_known"), F.col("customer_id").eqNullSafe(F.col("_known")), "left_anti").select("customer_id", "article_id")
    return known.crossJoin(F.broadcast(top.select("article_id"))).unionByName(other).unionByName(strangers)


#: Customers that a task gives their articles, about.
BLOCK_CUSTOMERS = 20_000


def _lists_joined(most: int = 4_000_000):
    """For mapInArrow: customer_id and the articles of all its names, each once and in order. A block begins with its names and
    their articles (_kind 0); customers come next. most: articles at once, beyond one customer's."""

    def joined(names: pa.Table, customers: pa.RecordBatch):
        order = pc.sort_indices(names.column("_name"))
        ids, lists = (names.column(c).combine_chunks().take(order) for c in ("_name", "_same"))
        ids, sizes = ids.to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        articles = pc.unique(flat)
        articles = articles.take(pc.sort_indices(articles))
        code = pc.index_in(flat, articles).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        counts = pc.list_value_length(customers.column("_names")).to_numpy(zero_copy_only=False).astype(np.int64)
        which = np.searchsorted(ids, customers.column("_names").flatten().to_numpy())
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(sizes[which])])[ends]  # articles up to each customer
        lo = 0
        while lo < len(counts):
            start = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, start + most, "right")))
            part = which[ends[lo] - counts[lo] : ends[hi - 1]]
            of, place = places(begins[part], begins[part] + sizes[part])
            key = np.sort(np.repeat(np.arange(hi - lo), counts[lo:hi])[of] * len(articles) + code[place])
            key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
            row, rank = np.divmod(key, max(1, len(articles)))
            offsets = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([customers.column("customer_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), articles.take(pa.array(rank)))], ["customer_id", "previously_bought_prod_name"])
            lo = hi

    def run(batches):
        block, rows, names = None, [], None
        for b in batches:
            mark = b.column("_block").to_numpy() * 2 + b.column("_kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if mark[lo] // 2 != block:
                    block, rows, names = mark[lo] // 2, [], None
                if mark[lo] % 2 == 0:
                    rows.append(b.slice(lo, hi - lo).select(["_name", "_same"]))
                    continue
                names = pa.Table.from_batches(rows) if names is None else names
                yield from joined(names, b.slice(lo, hi - lo))

    return run


def same_product_name(tx: DataFrame, articles: DataFrame) -> DataFrame:
    """customer, all articles that share a name with a bought one. A customer's names are numbers; a task of BLOCK_CUSTOMERS
    customers gets the articles of the names that they like once, and joins the lists where the customers are, so the lists of
    customers, which grow with customers times articles, are not shuffled."""
    named = articles.where("article_id is not null and prod_name is not null").select("article_id", "prod_name").distinct()
    names = io.stored(named.groupBy("prod_name").agg(F.collect_list("article_id").alias("_same")).select(F.monotonically_increasing_id().alias("_name"), "_same"), "names")
    known = names.select("_name", F.explode("_same").alias("article_id"))
    liked = tx.select("customer_id", "article_id").join(known, "article_id").groupBy("customer_id").agg(F.collect_set("_name").alias("_names"))
    liked = io.stored(liked, "liked")
    count = liked.count()
    blocks = max(1, min(tx.sparkSession.sparkContext.defaultParallelism, count // 1000), math.ceil(count / BLOCK_CUSTOMERS))
    customers = liked.withColumn("_block", F.pmod(F.xxhash64("customer_id"), F.lit(blocks)).cast("int"))
    wanted = customers.select("_block", F.explode("_names").alias("_name")).distinct().join(names, "_name")
    rows = wanted.withColumn("_kind", F.lit(0)).unionByName(customers.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    types = dict(tx.dtypes)["customer_id"], dict(names.dtypes)["_same"]
    placed = rows.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", "_kind")
    return placed.mapInArrow(_lists_joined(), f"customer_id {types[0]}, previously_bought_prod_name {types[1]}")


def _near_in_block(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        kinds = (queries.schema.field("query").type, data.schema.field("item").type, pa.float64())
        if not queries.num_rows or not data.num_rows:
            return pa.table([pa.array([], t) for t in kinds], ["query", "item", "distance"])
        data = data.sort_by("item")
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        q, d = matrix(queries), matrix(data)
        q2, d2 = np.square(q).sum(1), np.square(d).sum(1)
        most, found = min(k, len(d)), []
        step = max(16, min(256, (1 << 22) // len(d)))  # distances at once: 32 MB
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            about = q2[part, None] + d2[None, :] - 2 * q[part] @ d.T
            reach = np.partition(about, most - 1, axis=1)[:, most - 1] + 1e-9 * (q2[part] + d2.max())  # the product rounds; near ties are taken along
            row, col = np.nonzero(about <= reach[:, None])
            exact = np.sqrt(np.square(q[at + row] - d[col]).sum(1))
            order = np.lexsort((col, exact, row))
            row, col, exact = row[order], col[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((at + row[best], col[best], exact[best]))
        row, col, exact = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([queries.column("query").take(pa.array(row)), data.column("item").take(pa.array(col)), pa.array(exact)], ["query", "item", "distance"])

    return run


BLOCKS = 16
MOST_ROWS = 65_536


def _blocks(n: int, block_rows: int) -> int:
    return max(1, -(-n // max(block_rows, min(-(-n // BLOCKS), MOST_ROWS))))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "article_id", vector: str = "embedding", block_rows: int = 4096, item_col: str | None = None) -> DataFrame:
    """query, article, distance, rank: the k nearest by Euclidean distance, the query's own vector among them.

    Both sides are cut into blocks of about block_rows rows, or BLOCKS blocks if these hold at most MOST_ROWS rows, since a row
    is sent once for each block of the other side; the nearest of every pair of blocks come from one matrix product and are
    merged. Vectors have one length; rows without a vector take no part. Ties go to the smaller id.
    item_col: the id of the vectors, if it is named otherwise than that of the queries.
    """
    item_col = item_col or id_col
    have = lambda df: df.where(F.col(vector).isNotNull())
    queries, vectors = have(queries), have(vectors)
    blocks = [_blocks(df.count(), block_rows) for df in (queries, vectors)]
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(id_col).alias("query"), F.col(vector).alias("v"), part(id_col, blocks[0]).alias("a"), every(blocks[1]).alias("b"))
    d = vectors.select(F.col(item_col).alias("item"), F.col(vector).alias("v"), part(item_col, blocks[1]).alias("b"), every(blocks[0]).alias("a"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, id_col), (vectors, item_col))]
    local = q.groupBy("a", "b").cogroup(d.groupBy("a", "b")).applyInArrow(_near_in_block(k), f"query {kinds[0]}, item {kinds[1]}, distance double")
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "item"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "item", "distance", "rank")


def similar(tx: DataFrame, vectors: DataFrame, n_last: int, k: int, name: str = "closest") -> DataFrame:
    """customer, items nearest to the last n purchases. Each distinct item is searched once; k counts the item itself."""
    recent = recent_items(tx, n_last)
    queries = vectors.join(recent.select("article_id").distinct(), "article_id", "left_semi")
    found = nearest(queries, vectors, k).where("query != item").select(F.col("query").alias("article_id"), "item")
    pairs = recent.join(found, "article_id").select("customer_id", "item").distinct()
    return pairs.groupBy("customer_id").agg(F.array_sort(F.collect_list("item")).alias(name))


def recent_items(tx: DataFrame, n: int, tie: str = "line_id") -> DataFrame:
    return head_per_group(tx, "customer_id", [F.desc("t_dat"), F.desc(tie), F.desc("article_id")], n).select("customer_id", "article_id").distinct()


def collect(base: DataFrame, *lists: DataFrame) -> DataFrame:
    """One row a customer, one list column a strategy, null where a strategy has none."""
    return reduce(lambda a, b: a.join(b, "customer_id", "left"), lists, base)


def unpack(wide: DataFrame, strategies: list[str]) -> DataFrame:
    """customer, article, strategy; found by several strategies: multiple_strategies. Customers stand in one row each.

    A customer's lists are merged where they stand, so nothing is shuffled: an article is told by the lists that hold it.
    """
    def named(s: str) -> Column:
        given = F.array_distinct(F.filter(F.coalesce(F.col(s), F.array().cast("array<bigint>")), lambda x: x.isNotNull()))
        return F.transform(given, lambda x: F.struct(x.alias("article_id"), F.lit(s).alias("strategy_name")))

    tagged = F.flatten(F.array(*[named(s) for s in strategies]))
    ordered = wide.select("customer_id", F.array_sort(tagged).alias("_all"))

    def seen(step: int, i: Column) -> Column:
        """Whether the neighbour `step` places on is the same article."""
        return F.coalesce(F.get("_all", i + step)["article_id"] == F.get("_all", i)["article_id"], F.lit(False))

    # Sorted by article, equal ones are neighbours: the first of them stays.
    marked = F.transform("_all", lambda x, i: F.when((i == 0) | ~seen(-1, i), F.struct(x["article_id"].alias("article_id"), F.when(seen(1, i), F.lit("multiple_strategies")).otherwise(x["strategy_name"]).alias("strategy_name"))))
    return ordered.select("customer_id", F.inline(F.filter(marked, lambda x: x.isNotNull())))


def recall(wide: DataFrame, strategies: list[str], validation: DataFrame) -> DataFrame:
    """strategy_name, recall over distinct validation pairs, all strategies and all_candidates in one job."""
    truth = validation.select("customer_id", "article_id").distinct()
    joined = truth.join(wide, "customer_id", "left")
    hit = {s: F.coalesce(F.array_contains(s, F.col("article_id")), F.lit(False)) for s in strategies}
    hit["all_candidates"] = reduce(lambda a, b: a | b, hit.values())
    sums = joined.agg(*[F.avg(h.cast("double")).alias(s) for s, h in hit.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(s).alias("strategy_name"), F.col(s).alias("recall")) for s in hit])))


def attribute_sets(articles: DataFrame, columns: list[str]) -> DataFrame:
    tagged = [F.concat_ws("=", F.lit(c), F.col(c).cast("string")) for c in columns]
    return articles.select("article_id", F.array_distinct(F.array(*tagged)).alias("attributes"))


def average_jaccard(candidates: DataFrame, tx: DataFrame, attributes: DataFrame, n_last: int = 5, name: str = "articles_jaccard_similarity") -> DataFrame:
    """Mean Jaccard similarity of a candidate to the customer's recent items; 0 without history.

    A customer's few recent attribute sets travel as one list, so a candidate is compared where it stands. Attributes are
    compared by 64-bit hashes made once an article, which Spark intersects as plain numbers.
    """
    numbers = attributes.select("article_id", F.transform("attributes", lambda x: F.xxhash64(x)).alias("_set"))
    history = recent_items(tx, n_last).join(numbers, "article_id", "left").groupBy("customer_id").agg(F.collect_list("_set").alias("_sets"), F.count("*").alias("_n"))
    joined = candidates.join(numbers, "article_id", "left").join(history, "customer_id", "left")

    def likeness(x: Column) -> Column:
        both = F.size(F.array_intersect("_set", x))
        return F.coalesce(F.try_divide(both.cast("double"), (F.size("_set") + F.size(x) - both).cast("double")), F.lit(0.0))

    total = F.aggregate("_sets", F.lit(0.0), lambda s, x: s + F.when(F.col("_set").isNull(), 0.0).otherwise(likeness(x)))
    return joined.select(*candidates.columns, F.coalesce(total / F.col("_n"), F.lit(0.0)).alias(name))


def customer_vectors(tx: DataFrame, vectors: DataFrame, n_last: int = 5) -> DataFrame:
    """Mean of the vectors of a customer's recent items, which are few: they move as they are, shorter than sums of each component."""
    met = recent_items(tx, n_last).join(vectors.select("article_id", "embedding"), "article_id").select("customer_id", "embedding").repartition("customer_id")
    return mean_vector(met, "customer_id", "embedding", "customer_vector", width(vectors, "embedding"))


def cosine_feature(candidates: DataFrame, customers: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """Cosine of candidate and customer vector, 0 where either is missing. Norms are taken once a customer and once an article.

    Candidates meet articles first: their vectors are the shorter ones, and those without one move on as bare pairs.
    """
    norm = lambda c: F.sqrt(dot(c, c))
    whose = customers.withColumn("_norm", norm("customer_vector"))
    what = vectors.select("article_id", "embedding", norm("embedding").alias("_norm2"))
    joined = candidates.join(what, "article_id", "left").join(whose, "customer_id", "left")
    likeness = F.try_divide(dot("embedding", "customer_vector"), F.col("_norm") * F.col("_norm2"))
    return joined.select("customer_id", "article_id", "strategy_name", F.coalesce(likeness, F.lit(0.0)).alias(f"{name}_cosine_similarity"))


def merge_similarities(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, ["customer_id", "article_id", "strategy_name"]), frames)


def article_features(tx: DataFrame) -> DataFrame:
    """Rebuy share and offline share of each article, from one aggregation by (article, customer)."""
    pair = tx.groupBy("article_id", "customer_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("sales_channel_id") == 1, 1)).alias("offline"))
    return pair.groupBy("article_id").agg(F.avg((F.col("n") > 1).cast("double")).alias("rebuy_share_manual"), (F.sum("offline") / F.sum("n")).alias("offline_share_manual"))


def customer_features(tx: DataFrame, windows=WINDOWS) -> DataFrame:
    """Counts by window, days since first and last purchase, average gap and offline share, by one shuffle on the customer."""
    dated = tx.crossJoin(F.broadcast(newest(tx, "t_dat")))
    inside = lambda n: F.lit(True) if n is None else F.col("t_dat") >= F.date_sub("newest", n)
    name = lambda n: "all" if n is None else str(n)
    counts = [F.count(F.when(inside(n), 1)).alias(f"count_articles_{name(n)}_manual") for n in windows]
    days = F.count_distinct("t_dat")
    span = F.datediff(F.max("t_dat"), F.min("t_dat"))
    return dated.groupBy("customer_id").agg(
        *counts,
        F.datediff(F.first("newest"), F.min("t_dat")).alias("days_since_first_manual"),
        F.datediff(F.first("newest"), F.max("t_dat")).alias("days_since_last_manual"),
        F.floor(F.when(days > 1, span / (days - 1))).alias("average_gap_manual"),
        F.avg((F.col("sales_channel_id") == 1).cast("double")).alias("offline_share_manual"),
    )


def customer_group_counts(tx: DataFrame, articles: DataFrame) -> DataFrame:
    return tx.join(articles.select("article_id", "product_group_name"), "article_id").groupBy("customer_id", "product_group_name").agg(F.count("*").alias("count_group"))


def add_label(candidates: DataFrame, validation: DataFrame | None) -> DataFrame:
    """label 1 for pairs bought in validation; without validation nothing changes."""
    if validation is None:
        return candidates
    bought = validation.select("customer_id", "article_id").distinct().withColumn("label", F.lit(1))
    return candidates.join(bought, ["customer_id", "article_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def add_features(candidates: DataFrame, key: str, *features: DataFrame) -> DataFrame:
    """Left-join feature tables; columns named count... become whole numbers without nulls."""
    return fill_counts(reduce(lambda a, b: a.join(b, key, "left"), features, candidates))


def add_attributes(candidates: DataFrame, articles: DataFrame, customers: DataFrame, drop: list[str], categories: list[str]) -> DataFrame:
    joined = candidates.join(articles, "article_id", "left").join(customers, "customer_id", "left").drop(*drop)
    return joined.withColumns({c: F.col(c).cast("string") for c in categories})


def blend(frames: dict[str, DataFrame], key: str, k: int, column: str = "prediction") -> DataFrame:
    """Lists of several models by the sum of 1 / rank; ties in order of first appearance (model, then place)."""
    long = reduce(lambda a, b: a.union(b), [df.select(key, F.lit(n).alias("model"), F.posexplode(column).alias("pos", "item")).select(key, "item", "model", "pos") for n, (_, df) in enumerate(sorted(frames.items()))])
    return _blended(long, key, k, column)


def _blended(long: DataFrame, key: str, k: int, column: str = "prediction") -> DataFrame:
    """key and its list of k items, from key, item, model, pos."""
    long = long.toDF(key, "item", "model", "pos")
    summed = long.groupBy(key, "item").agg(F.sum(1 / (F.col("pos") + 1)).alias("score"), F.min(F.struct("model", "pos")).alias("seen"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "seen"))
    top = summed.withColumn("r", rank).where(F.col("r") <= k)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "item"))).alias("l")).select(key, F.array_join(F.transform("l", lambda s: s["item"].cast("string")), " ").alias(column))


def rank_models(candidates: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], top: int = 12, k: int = 12) -> DataFrame:
    """Each scorer (a fitted model or any function that adds the column score) ranks its best `top` items of a customer; the
    lists are blended to k, as by blend. All scores stand on one row, so candidates are shuffled once, to their customers."""
    key, item, names = "customer_id", "article_id", sorted(scorers)
    data = candidates.where(F.col(key).isNotNull())
    for n, name in enumerate(names):
        data = scorers[name](data).withColumnRenamed("score", f"_score{n}")
    scores = [f"_score{n}" for n in range(len(names))]
    data = data.select(key, item, *scores)
    for n, score in enumerate(scores):
        data = data.withColumn(f"_r{n}", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), item)))
    places = F.filter(F.array(*[F.struct(F.lit(n).alias("model"), (F.col(f"_r{n}") - 1).alias("pos")) for n in range(len(names))]), lambda x: x["pos"] < top)
    return _blended(data.select(key, item, F.inline(places)), key, k)
