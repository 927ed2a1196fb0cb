"""Exact top-k search as a Voronoi kNN join.

Scores are integer inner products of quantised vectors. One more component, sqrt(M^2 - |x|^2) for data and 0 for
queries (M the largest norm), turns the largest inner products into the smallest distances. Pivots cut the space
into Voronoi cells. From a summary of every cell (the k + 1 smallest distances of its data to its pivot, the largest of its queries) follows, by
the triangle inequality, a distance within which the answers of all queries of a cell lie, and data go to a group of
queries only if that bound lets them be an answer. Each group of queries is a cut of a cell of bounded size, data
sent to it are dealt into shards of bounded size, shards are solved locally, and the best of the shards are merged.
Cells whose bound lets through more than POOLED of all data gain nothing from being apart: their queries share groups, so
data that cannot be pruned are copied once a group of group_queries queries and not once a cell.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as if filled
with zeros. Ties go to the smaller id. Rows with null ids take no part; ids are read as long. Rows that repeat an id are data
of their own; a query never meets rows with its own id. Empty tables and k beyond the data give what there is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

PIVOTS = 24
GROUP_QUERIES = 512
SHARD_ROWS = 8192
POOLED = 0.5
_POOL = -1


def quantised(vector: str, scale: int) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _matrix(values, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for n, v in enumerate(values):
        out[n, : len(v)] = v
    return out


def _squares(m: np.ndarray) -> np.ndarray:
    return np.square(m.astype(np.float64)).sum(1)


def _distances(m: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to lifted pivots."""
    lifted = np.column_stack([m.astype(np.float64), extra])
    d2 = np.square(lifted).sum(1)[:, None] - 2 * lifted @ pivots.T + np.square(pivots).sum(1)[None, :]
    return np.sqrt(np.maximum(d2, 0))


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row of unique keys."""
    k = min(k, keys.shape[1])
    return np.argpartition(-keys, k - 1, axis=1)[:, :k] if k < keys.shape[1] else np.tile(np.arange(k), (len(keys), 1))


def _solve(queries: pd.DataFrame, data: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    if not len(queries) or not len(data):
        return empty
    data = data.sort_values("id", kind="stable")
    unpack = lambda col: np.frombuffer(b"".join(col), "<i8").reshape(-1, width)
    q, d, ids = unpack(queries["packed"]), unpack(data["packed"]), data["id"].to_numpy()
    exact = max(1, np.abs(q).max()) * float(max(1, np.abs(d).max())) * width < 2**52
    if exact:
        q, d = q.astype(np.float64), d.astype(np.float64)
    parts = []
    for at in range(0, len(q), 64):
        scores = (q[at : at + 64] @ d.T).astype(np.int64)
        qid = queries["id"].to_numpy()[at : at + 64]
        own = ids[None, :] == qid[:, None]
        order = np.lexsort((np.broadcast_to(np.arange(len(ids)), scores.shape), -scores, own), axis=1)[:, :k] if not exact else None
        if exact:
            keys = scores.astype(np.float64) * 1.0 - np.arange(len(ids))[None, :] / (2.0 * len(ids))
            if np.abs(scores).max() * 2.0 * len(ids) >= 2**51:
                order = np.lexsort((np.broadcast_to(np.arange(len(ids)), scores.shape), -scores, own), axis=1)[:, :k]
            else:
                keys[own] = -np.inf
                order = _best(keys, k)
        rows = np.arange(len(order))[:, None]
        good = ~own[rows, order]
        parts.append(pd.DataFrame({"query_id": np.repeat(qid, order.shape[1])[good.ravel()], "vec_id": ids[order][good], "score": scores[rows, order][good]}))
    return pd.concat(parts) if parts else empty


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: int = 256, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row for which `queries` holds."""
    spark = vectors.sparkSession
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    valid = vectors.where(F.col(vector_col).isNotNull() & ~bad & F.col(id_col).isNotNull())
    valid = valid.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("q"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = valid.select(F.size("q").alias("n"), F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("n2"))
    width, longest, n_rows = sizes.agg(F.max("n"), F.max("n2"), F.count("*")).first()
    width, longest = max(1, width or 1), (longest or 0.0) * (1 + 1e-12) + 1
    picked = [r.q for r in valid.orderBy(F.xxhash64("id"), "id").limit(pivots).select("q").collect()]
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pm = _matrix(picked, width)
    points = np.column_stack([pm.astype(np.float64), np.sqrt(np.maximum(longest - _squares(pm), 0))])

    def assign(batches):
        for pdf in batches:
            m = _matrix(pdf["q"], width)
            near = _distances(m, np.sqrt(np.maximum(longest - _squares(m), 0)), points)
            asks = _distances(m, np.zeros(len(m)), points)
            yield pd.DataFrame({
                "id": pdf["id"], "asks": pdf["asks"], "packed": [r.tobytes() for r in m.astype("<i8")],
                "cell": near.argmin(1).astype("int32"), "d": near.min(1), "dists": list(near),
                "ask_cell": asks.argmin(1).astype("int32"), "ask_d": asks.min(1),
            })

    spread = max(1, min(spark.sparkContext.defaultParallelism, n_rows // 1000))
    schema = "id long, asks boolean, packed binary, cell int, d double, dists array<double>, ask_cell int, ask_d double"
    placed = materialise(valid.repartition(spread).mapInPandas(assign, schema), "cells")
    first = W.partitionBy("cell", "salt").orderBy("d", "id")
    by_id = placed.groupBy("id").agg(F.max_by("cell", "d").alias("cell"), F.max("d").alias("d"))  # a query leaves out one id
    salted = by_id.select("cell", "d", "id", F.pmod(F.xxhash64("id", "d"), F.lit(max(1, n_rows // shard_rows))).alias("salt"))
    nearest = salted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("cell", "d")
    near = [[] for _ in points]
    for cell, ds in nearest.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k + 1)).collect():
        near[cell] = ds
    asking = {r[0]: (r[1], r[2]) for r in placed.where("asks").groupBy("ask_cell").agg(F.max("ask_d"), F.count("*")).collect()}
    between = np.sqrt(np.maximum(np.square(points).sum(1)[:, None] - 2 * points @ points.T + np.square(points).sum(1)[None, :], 0))
    groups = []
    for cell, (radius, n) in sorted(asking.items()):
        upper = np.sort(np.concatenate([radius + between[cell, j] + np.array(ds) for j, ds in enumerate(near) if ds]))
        bound = (upper[k] if len(upper) > k else np.inf) * (1 + 1e-9) + 1e-3
        groups.append((int(cell), float(radius + bound), int(n)))
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent = placed.agg(*[F.count(F.when(F.element_at("dists", c + 1) <= r, 1)) for c, r, _ in groups]).first()
    pooled = [c for (c, _, _), rows in zip(groups, sent, strict=True) if rows > POOLED * n_rows]
    in_pool = sum(n for c, _, n in groups if c in pooled)
    groups = [(c, r, -(-n // group_queries)) for c, r, n in groups if c not in pooled] + ([(_POOL, 0.0, -(-in_pool // group_queries))] if pooled else [])
    shards = max(1, -(-n_rows // shard_rows))
    # A datum goes to a group if its distance to the group's pivot is at most radius + bound; cells far off never are.
    reached = F.filter(F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(r).alias("r"), F.lit(b).alias("blocks")) for c, r, b in groups]), lambda g: F.coalesce(F.get("dists", g["cell"]) <= g["r"], F.lit(True)))  # the pool has no distance
    shard = F.pmod(F.xxhash64("id", "packed"), F.lit(shards)).cast("int")
    data = placed.select("id", "packed", shard.alias("shard"), F.explode(reached).alias("g"))
    data = data.select("id", "packed", "shard", F.col("g.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("g.blocks") - 1)).alias("block"))
    home = F.when(F.col("ask_cell").isin(pooled), _POOL).otherwise(F.col("ask_cell"))
    blocks = F.element_at(F.map_from_arrays(F.array(*[F.lit(c) for c, _, _ in groups]), F.array(*[F.lit(b) for _, _, b in groups])), home)
    asks = placed.where("asks").select("id", "packed", home.alias("cell"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    asks = asks.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    keys = ["cell", "block", "shard"]
    local = asks.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(lambda q, d: _solve(q, d, width, k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
