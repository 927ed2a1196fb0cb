"""MinHash near-dedup by DartMinHash.

A text is a weighted set: its shingles of five words, each weighing as often as it occurs. Over every unit of weight
of an element lies an endless region of ranks, on which a hash throws darts of density one: a region's darts are
the same in all texts. A text takes the darts in its elements' regions with rank up to a level that gives about
t ln t + 2 t darts whatever the text's length; each dart belongs to one of t coordinates, and the dart of lowest rank of
each coordinate is the signature. (Level too low for some coordinate: it is doubled.) Two texts agree in a coordinate
with the probability of their weighted Jaccard similarity.

Equal word sequences collapse first: a node stands for one. Bands of the signature deal nodes into buckets. In a bucket
nobody is paired with everybody: the members meet a centre, the member whose bands are the most crowded, as the
original among its edited copies is. Pairs are then verified exactly on their shingles, and verified links give classes by
hooking and shortcutting of labels, in tables.

That leaves links between members of one bucket in different classes. No such link can be if 1 - similarity, a metric,
forbids it: the members' similarities to the centre differ by more than 1 - the threshold; or if what a member shares
with other classes is too little: its shingles that no other class has bound the weight of every partner. Buckets that
still hold several classes are solved in blocks of bounded bytes: members outside the largest class meet the members
of other classes, each pair in the first band that it shares, and exact similarities join classes as they are found, so a
block returns fewer links than it has classes. So each pair of a bucket is verified, in one class already, or ruled out.

Cases: null texts count as empty; equal texts, also empty ones, share a class. A text of fewer than five words is one
shingle. A row with a null id is in the class of its equal texts, if any has an id, else its class id is null. Repeated
rows each get a row. `keep_one` keeps all columns and never drops a row whose id is null; of rows that share an id but
not the text it judges each alone. Ids are read as long. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, nonnull_text
from .textkit import U, arrow_rows, batches, mix, pack, shingles, words

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 28
_BATCH_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
_ODD = U(0x9E3779B97F4A7C15)


def weighted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, element) with their counts."""
    if not len(h):
        return owner, h, np.zeros(0, np.int64)
    order = np.lexsort((h, owner))
    o, e = owner[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (e[1:] != e[:-1])]))
    return o[first], e[first], np.diff(np.append(first, len(o)))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t signatures of n weighted sets; rows without elements stay 0. Weights may be fractions."""
    out = np.zeros((n, t), U)
    total = np.bincount(owner, weight, n)
    todo = np.flatnonzero(total > 0)
    level = np.zeros(n)
    level[todo] = (t * math.log(t) + 2 * t) / total[todo]
    while len(todo):
        live = np.isin(owner, todo)
        o, e, x = owner[live], element[live], weight[live]
        units = np.ceil(x).astype(np.int64)
        at = np.repeat(np.arange(len(o)), units)
        unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
        region = mix(e[at] + unit.astype(U) * _ODD + U(1))
        whose, share, rank = o[at], np.minimum(1.0, x[at] - unit), np.zeros(len(at))
        coords, ranks, darts = [], [], []
        nth = np.zeros(1, U)
        while len(region):
            nth = nth + U(1)
            dart = mix(region + nth * _ODD)
            rank = rank - np.log(((dart >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)  # gaps of a Poisson process
            more = rank < level[whose]
            region, whose, share, rank, dart = region[more], whose[more], share[more], rank[more], dart[more]
            spot = mix(dart + U(2))
            inside = (spot >> U(11)).astype(np.float64) * 2.0**-53 < share
            where = mix(dart + U(3)) % U(t)
            coords.append((whose * t + where.astype(np.int64))[inside])
            ranks.append(rank[inside])
            darts.append(dart[inside])
        coord, r, d = np.concatenate(coords), np.concatenate(ranks), np.concatenate(darts)
        order = np.lexsort((r, coord))
        coord, d = coord[order], d[order]
        first = np.concatenate([[True], coord[1:] != coord[:-1]]) if len(coord) else np.zeros(0, bool)
        full = np.bincount(coord[first] // t, minlength=n) == t
        good = first & full[coord // t]
        out.reshape(-1)[coord[good]] = d[good]
        todo = todo[~full[todo]]
        level[todo] *= 2
    return out


def _nodes(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """16 bytes that stand for each text's word sequence."""
    count = np.bincount(owner, minlength=n)
    last = np.cumsum(count)
    place = (np.arange(len(h)) - np.repeat(last - count, count)).astype(U)
    out = np.zeros((n, 2), U)
    for c, odd in enumerate((_ODD, U(0xC2B2AE3D27D4EB4F))):
        sums = np.concatenate([[U(0)], np.cumsum(mix(h + (place + U(1)) * odd), dtype=U)])
        out[:, c] = mix(sums[last] - sums[last - count] + count.astype(U))
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int, rows: int, bands: int) -> DataFrame:
    def run(record_batches):
        for held in batches(arrow_rows(record_batches, "id", "text", "code"), lambda r: len(r[1]), _BATCH_BYTES):
            owner, h, _ = words(*pack([t.encode("utf-8") for _, t, _ in held]))
            sig = dart_signatures(*weighted(*shingles(owner, h, n)), len(held), rows * bands).reshape(len(held), bands, rows)
            acc = np.zeros((len(held), bands), U)
            for r in range(rows):
                acc = mix(acc + sig[:, :, r] * _ODD + U(r))
            some = np.bincount(owner, minlength=len(held)) > 0
            nodes = _nodes(owner, h, len(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in held], pa.int64()), pa.array([c for _, _, c in held], pa.int64()), pa.array([x.tobytes() for x in nodes], pa.binary()), pa.array([x.tolist() if ok else [] for x, ok in zip(acc.view(np.int64), some, strict=True)], pa.list_(pa.int64()))],
                ["id", "code", "node", "bands"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), nonnull_text(text_col).alias("text"), F.xxhash64(nonnull_text(text_col)).alias("code"))
    return texts.mapInArrow(run, "id long, code long, node binary, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """node, elements, weights, size (their sum) of texts: what exact verification needs."""

    def run(record_batches):
        for held in batches(arrow_rows(record_batches, "text"), lambda r: len(r[0]), _BATCH_BYTES):
            owner, h, _ = words(*pack([t.encode("utf-8") for (t,) in held]))
            o, e, x = weighted(*shingles(owner, h, n))
            edge = pa.array(np.searchsorted(o, np.arange(len(held) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in _nodes(owner, h, len(held))], pa.binary()), pa.ListArray.from_arrays(edge, pa.array(e.view(np.int64))), pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))), pa.array(np.bincount(o, x, len(held)).astype(np.int64))],
                ["node", "elements", "weights", "size"],
            )

    return docs.select("text").mapInArrow(run, "node binary, elements array<long>, weights array<int>, size long")


def weighted_jaccard(a: pd.Series, wa: pd.Series, b: pd.Series, wb: pd.Series) -> pd.Series:
    out = np.zeros(len(a))
    for n, (x, wx, y, wy) in enumerate(zip(a, wa, b, wb, strict=True)):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        common = np.minimum(wx[i], wy[j]).sum()
        whole = wx.sum() + wy.sum() - common
        out[n] = common / whole if whole else 1.0
    return pd.Series(out)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root for all nodes of edges (a, b): the smallest node that links lead to."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = materialise(nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", F.col("node").alias("root")), "roots")
    while True:
        offers = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        hooked = materialise(roots.join(offers, "node", "left").select("node", "root", F.least("root", F.coalesce("offer", "root")).alias("next")), "hooked")
        if not hooked.where("next < root").limit(1).count():
            return roots
        far = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        roots = materialise(hooked.join(far, "next", "left").select("node", F.coalesce("far", "next").alias("root")), "roots")


def _parts(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and where each list starts (one more at the end)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _meet(similarity: float):
    """Links between classes in a block: members that ask, and members of all classes."""

    def run(asks: pa.Table, data: pa.Table) -> pa.Table:
        found: list[tuple[bytes, bytes]] = []
        if not asks.num_rows or not data.num_rows:
            return pa.table([pa.array([], pa.binary())] * 2, ["a", "b"])
        roots = sorted({*asks.column("root").to_pylist(), *data.column("root").to_pylist()})
        number = {r: n for n, r in enumerate(roots)}
        parent = np.arange(len(roots))
        side = []
        for t in (asks, data):
            column = lambda c, t=t: t.column(c).to_numpy()
            side.append({"class": np.array([number[r] for r in t.column("root").to_pylist()], np.int64), "bands": _parts(t.column("bands"))[0].reshape(t.num_rows, -1), **{c: column(c) for c in ("size", "most", "near")}, "e": _parts(t.column("elements")), "w": _parts(t.column("weights"))[0]})
        x, y = side
        band = asks.column("band")[0].as_py()
        names, place = np.unique(np.concatenate([x["e"][0], y["e"][0]]), return_inverse=True)
        of_x, of_y = place[: len(x["e"][0])], place[len(x["e"][0]) :]
        mark, edge = np.zeros(len(names), np.int64), y["e"][1]
        for n in range(asks.num_rows):
            mine = slice(x["e"][1][n], x["e"][1][n + 1])
            fit = (parent[y["class"]] != parent[x["class"][n]]) & (y["size"] <= x["most"][n]) & (x["size"][n] <= y["most"]) & (np.abs(y["near"] - x["near"][n]) <= 1 - similarity + 1e-9)
            fit[fit] = ~(y["bands"][fit, :band] == x["bands"][n, :band]).any(1)  # met in an earlier band
            open_ = np.flatnonzero(fit)
            open_ = open_[np.argsort(-y["near"][open_], kind="stable")]
            mark[of_x[mine]] = x["w"][mine]
            while len(open_):
                now, open_ = open_[:64], open_[64:]
                at = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in now])
                ends = np.cumsum(edge[now + 1] - edge[now])
                sums = np.concatenate([[0], np.cumsum(np.minimum(mark[of_y[at]], y["w"][at]))])
                common = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
                for k in now[common >= similarity * (x["size"][n] + y["size"][now] - common) - 1e-9]:
                    mine_now, other = parent[x["class"][n]], parent[y["class"][k]]
                    if mine_now != other:
                        found.append((roots[x["class"][n]], roots[y["class"][k]]))
                        parent[parent == other] = mine_now
                open_ = open_[parent[y["class"][open_]] != parent[x["class"][n]]]
            mark[of_x[mine]] = 0
        return pa.table([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], ["a", "b"])

    return run


def _spread(record_batches):
    """A row for each element of each member."""
    for b in record_batches:
        elements, edge = _parts(b.column("elements"))
        at = pa.array(np.repeat(np.arange(b.num_rows), np.diff(edge)))
        yield pa.RecordBatch.from_arrays([b.column("node").take(at), b.column("class").take(at), pa.array(elements), pa.array(_parts(b.column("weights"))[0])], ["node", "class", "element", "weight"])


def _divided(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes."""
    low_high = members.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return members.join(low_high.where("low < high").select("band", "value"), ["band", "value"], "left_semi")


def _cross_links(members: DataFrame, sets: DataFrame, bands: DataFrame, similarity: float, block_bytes: int) -> DataFrame:
    """a, b: roots of classes that a link between members of one bucket joins. members: band, value, node, root, near."""
    members = materialise(_divided(members), "divided")
    nodes = members.select("node", "root", F.xxhash64("root").alias("class")).distinct()
    nodes = materialise(nodes.join(sets, "node"), "open-sets")
    elements = nodes.select("node", "class", "elements", "weights").mapInArrow(_spread, "node binary, class long, element long, weight int")
    shared = elements.groupBy("element").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("element")
    common = elements.join(shared, "element", "left_semi").groupBy("node").agg(F.sum("weight").alias("common"))
    # a partner shares at most `common`, so it weighs at most `most`
    most = F.least(F.col("size") / similarity, F.col("common") * ((1 + similarity) / similarity) - F.col("size")) + 1e-6
    able = nodes.select("node", "size", (F.col("size") * 12 + 400).alias("bytes")).join(common, "node").withColumn("most", most).where(F.col("most") >= similarity * F.col("size"))
    able = materialise(able.drop("common"), "able")
    members = materialise(_divided(members.join(able, "node")), "open")
    classes = members.groupBy("band", "value", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    buckets = classes.groupBy("band", "value").agg(F.max(F.struct("n", "root", "bytes")).alias("largest"), F.sum("bytes").alias("bytes"))
    buckets = buckets.select("band", "value", F.col("largest.root").alias("largest"), F.ceil(F.col("bytes") / block_bytes).alias("blocks"), F.ceil((F.col("bytes") - F.col("largest.bytes")) / block_bytes).alias("asking"))
    members = members.join(buckets, ["band", "value"])
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    kept = ["band", "value", "node", "root", "size", "most", "near"]
    asks = members.where("root != largest").select(*kept, part("asking").alias("p"), every("blocks").alias("q"))
    data = members.select(*kept, part("blocks").alias("q"), every("asking").alias("p"))
    full = nodes.select("node", "elements", "weights").join(bands, "node")
    keys = ["band", "value", "p", "q"]
    renewed = lambda t: t.join(full, "node").select(*[F.col(c).alias(c) for c in (*kept, "p", "q", "elements", "weights", "bands")])
    return renewed(asks).groupBy(*keys).cogroup(renewed(data).groupBy(*keys)).applyInArrow(_meet(similarity), "a binary, b binary").distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, n: int, similarity: float, block_bytes: int) -> DataFrame:
    """node, root of all nodes that verified links lead to or from."""
    rows = reps.where("id is not null").select("node", "id", F.posexplode("bands").alias("band", "value"))
    crowded = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(rows.join(crowded, ["band", "value"]).select("band", "value", "node", "id", "n"), "members")
    typical = members.groupBy("node", "id").agg(F.sum(F.log2("n")).alias("crowd"))
    ranked = materialise(typical.select("node", "id", F.struct("crowd", (-F.col("id")).alias("early"), "node").alias("rank")), "ranked")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), nonnull_text(text_col).alias("text")).join(ranked.select("id").distinct().hint("merge"), "id", "left_semi")
    sets = materialise(_sets(texts, n).dropDuplicates(["node"]), "sets")
    placed = members.select("band", "value", "node").join(ranked, "node")
    first = placed.groupBy("band", "value").agg(F.max("rank").alias("top")).select("band", "value", F.col("top.node").alias("centre"))
    meets = materialise(members.select("band", "value", "node").join(first, ["band", "value"]).where("node != centre"), "meets")

    side = lambda c, e, w: sets.select(F.col("node").alias(c), F.col("elements").alias(e), F.col("weights").alias(w))
    pairs = meets.select("node", "centre").distinct().join(side("node", "e", "w"), "node").join(side("centre", "ec", "wc"), "centre")
    scored = materialise(pairs.select("node", "centre", F.pandas_udf(weighted_jaccard, "double")("e", "w", "ec", "wc").alias("near")), "scored")
    good = scored.where(F.col("near") >= similarity).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    linked = components(reps.select("node"), materialise(good, "verified"))
    roots = materialise(ranked.select("node").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")

    left = meets.join(roots, "node").join(scored, ["node", "centre"]).select("band", "value", "node", "root", "near")
    links = materialise(_cross_links(left, sets, reps.select("node", "bands"), similarity, block_bytes), "crossed")
    if not links.limit(1).count():
        return roots
    joined = components(roots.select("node"), links).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    return roots.join(joined, "root", "left").select("node", F.coalesce("joined", "root").alias("root"))


def _classes(docs: DataFrame, id_col: str, text_col: str, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, code (of the text), class_id, kept of every row."""
    signed = materialise(_signed(docs, id_col, text_col, shingle, rows, bands), "signed")
    reps = materialise(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "reps")
    roots = _linked(docs, id_col, text_col, reps, shingle, similarity, block_bytes)
    linked = roots.join(reps.select("node", "id"), "node")
    least = linked.groupBy("root").agg(F.min("id").alias("class_id"))
    of_node = linked.join(least, "root").select("node", "class_id")
    table = materialise(reps.select("node", "id").join(of_node, "node", "left").select("node", F.coalesce("class_id", "id").alias("class_id")), "classes")
    out = signed.select("id", "code", "node").join(table, "node", "left")
    return out.select("id", "code", "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, class_id (smallest id of the class), kept (is it that id)."""
    return _classes(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), "class_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: one document of each class."""
    gone = _classes(docs, id_col, text_col, **options).where("not kept and id is not null").select(F.col("id").alias("gone"), F.col("code").alias("gone_code")).distinct()
    same = (docs[id_col].cast("long") == gone["gone"]) & (F.xxhash64(nonnull_text(docs[text_col])) == gone["gone_code"])
    return docs.join(gone.hint("merge"), same, "left_anti")
