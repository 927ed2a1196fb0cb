"""Latent vectors of texts, and next-item vectors of sequences: small matrices fitted by passes over all rows.

Both models keep matrices whose size is a parameter (hash slots times width), whatever the data; passes add up, task by task,
what the rows say about them, and only such sums travel.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import io

_WORD = re.compile(r"\w+")
_BLOCK = 1024  # slots of a row of sums


def _sum_blocks(sums: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of matrices that tasks sent in blocks (block, values) of _BLOCK rows: rows x width numbers on the driver."""
    added = sums.groupBy("block").applyInPandas(_added, "block int, values binary")
    out = np.zeros((rows, width))
    for r in added.collect():
        part = np.frombuffer(r["values"]).reshape(-1, width)
        out[r["block"] * _BLOCK : r["block"] * _BLOCK + len(part)] = part
    return out


def _added(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(b["values"].iloc[0]) // 8)
    for x in b["values"]:
        total += np.frombuffer(x)
    return pd.DataFrame({"block": [key[0]], "values": [total.tobytes()]})


def _blocks(matrix: np.ndarray) -> pd.DataFrame:
    """A task's matrix as rows; blocks of zeros stay at home."""
    parts = [(n // _BLOCK, matrix[n : n + _BLOCK]) for n in range(0, len(matrix), _BLOCK)]
    kept = [(n, np.ascontiguousarray(p, float).tobytes()) for n, p in parts if p.any()]
    return pd.DataFrame({"block": pd.Series([n for n, _ in kept], dtype="int32"), "values": [v for _, v in kept]})


# Texts


def _counted(texts: pa.Array, slots: int, known: dict[str, int]) -> tuple[pa.Array, pa.Array]:
    """The slots of each text's words in order, and how often each comes. known: words' slots, kept for the next batch."""
    edge, slot, count = [0], [], []
    for text in texts.to_pylist():
        counts: dict[int, int] = {}
        for w, n in Counter(_WORD.findall(text.lower())).items():
            s = known.get(w)
            if s is None:
                s = zlib.crc32(w.encode()) % slots
                if len(known) < _KNOWN:
                    known[w] = s
            counts[s] = counts.get(s, 0) + n
        slot.extend(counts)
        count.extend(counts.values())
        edge.append(len(slot))
    edges = pa.array(edge, pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(slot, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(count, pa.int32()))


_KNOWN = 200_000  # words whose slot a task remembers


def _terms(batches, size: int = 256):
    """(texts, place of text, slot, count) of runs of rows with the columns slots and counts."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            slots, counts = (b.column(c).slice(at, size) for c in ("slots", "counts"))
            lengths = slots.value_lengths().to_numpy(zero_copy_only=False)
            yield len(slots), np.repeat(np.arange(len(slots)), lengths), slots.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(float)


def _projected(terms: tuple, idf: np.ndarray, basis: np.ndarray):
    """Rows of (texts x slots) times the basis, with the texts' weights: counts damped, weighted and scaled to length one a text."""
    n, place, slot, count = terms
    out, weight = np.zeros((n, basis.shape[1])), np.zeros(0)
    if len(place):
        weight = np.log1p(count) * idf[slot]
        length = np.sqrt(np.bincount(place, weight * weight, n))
        weight = weight / np.where(length == 0, 1.0, length)[place]
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        out[place[begin]] = np.add.reduceat(basis[slot] * weight[:, None].astype(np.float32), begin)
    return out, place, slot, weight


def _add_back(out: np.ndarray, y: np.ndarray, place: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> None:
    """Adds (texts x slots) transposed times y to out."""
    if len(slot):
        order = np.argsort(slot, kind="stable")
        begin = np.flatnonzero(np.diff(slot[order], prepend=-1))
        out[slot[order][begin]] += np.add.reduceat(y[place[order]] * weight[order, None], begin)


def latent_vectors(df: DataFrame, id_col: str, text_col: str, size: int = 64, slots: int = 1 << 16, rounds: int = 1, spare: int = 8, seed: int = 7, name: str = "embedding") -> DataFrame:
    """id and a unit vector of `size` numbers: the text's place along the main directions of all texts' term weights.

    The directions are those of a randomised range finder over hashed terms: slots are mixed at random into size + spare
    columns, and each round multiplies these by the texts and back, which turns them towards the main directions. A task sends
    at most slots x (size + spare) sums a round; the driver holds one such matrix. Texts are cut into words once and stored as
    slots and counts, which every round reads. Null text reads "nan"; texts without a
    word get zeros.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("nan")).alias("text"))
    texts = rows.select("text")

    def count(batches):
        known: dict[str, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), *_counted(part.column("text"), slots, known)], ["id", "slots", "counts"])

    kind = rows.schema["id"].dataType.simpleString()
    terms = io.stored(rows.mapInArrow(count, f"id {kind}, slots array<int>, counts array<int>"), "terms")  # texts are cut into words once
    texts = terms.select("slots", "counts")

    def sums(made) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(made["block"].tolist(), pa.int32()), pa.array(made["values"].tolist(), pa.binary())], ["block", "values"])

    def frequencies(batches):
        seen, n = np.zeros((slots, 1)), 0
        for rows_of, _, slot, _ in _terms(batches):
            seen[:, 0] += np.bincount(slot, minlength=slots)
            n += rows_of
        yield sums(_blocks(seen))
        yield sums(pd.DataFrame({"block": pd.Series([-1], dtype="int32"), "values": [np.array([float(n)]).tobytes()]}))

    counted = texts.mapInArrow(frequencies, "block int, values binary")
    path = io.scratch(spark, "term-counts")
    counted.write.parquet(path)
    counted = spark.read.parquet(path)
    total = sum(np.frombuffer(r["values"])[0] for r in counted.where("block = -1").collect())  # one row a task
    found = _sum_blocks(counted.where("block >= 0"), slots, 1)[:, 0]
    idf = np.log((total + 1) / (found + 1)) + 1
    basis = np.random.default_rng(seed).standard_normal((slots, size + spare)).astype(np.float32)
    for _ in range(1 + rounds):
        shared = spark.sparkContext.broadcast((idf, basis))

        def turn(batches, shared=shared):
            weights, own = shared.value
            out = np.zeros(own.shape)
            for part in _terms(batches):
                _add_back(out, *_projected(part, weights, own))
            yield sums(_blocks(out))

        turned = _sum_blocks(texts.mapInArrow(turn, "block int, values binary"), slots, size + spare)
        basis = np.linalg.qr(turned)[0].astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, basis))

    def gram(batches):
        weights, own = shared.value
        out = np.zeros((own.shape[1], own.shape[1]))
        for part in _terms(batches):
            y = _projected(part, weights, own)[0]
            out += y.T @ y
        yield sums(_blocks(out))

    values, vectors = np.linalg.eigh(_sum_blocks(texts.mapInArrow(gram, "block int, values binary"), size + spare, size + spare))
    final = spark.sparkContext.broadcast((idf, (basis @ vectors[:, np.argsort(-values)[:size]]).astype(np.float32)))

    def place_texts(batches):
        weights, own = final.value
        for b in batches:
            y = np.concatenate([_projected(p, weights, own)[0] for p in _terms([b])] or [np.zeros((0, size))])
            y /= np.maximum(np.sqrt((y**2).sum(1)), 1e-12)[:, None]
            flat = pa.array(y.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), flat)], ["id", name])

    return terms.mapInArrow(place_texts, f"id {kind}, {name} array<float>").withColumnRenamed("id", id_col)


# Sequences


def sequences(events: DataFrame, user: str, item: str, order: list[str], last: int = 50) -> DataFrame:
    """user, items: the last items of each user in order, and one more row of every earlier `last` items, overlapping by one."""
    w = W.partitionBy(user).orderBy(*order)
    numbered = events.select(user, F.col(item).alias("item"), (F.row_number().over(w) - 1).alias("n"))
    step = F.floor(F.col("n") / last)
    twice = F.when((F.col("n") % last == 0) & (F.col("n") > 0), F.array(step, step - 1)).otherwise(F.array(step))
    parts = numbered.select(user, "item", "n", F.explode(twice).alias("part"))
    listed = parts.groupBy(user, "part").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("l"))
    return listed.select(user, "part", F.transform("l", lambda s: s["item"]).alias("items"))


class Transitions:
    """Factors of items as they come before (`past`) and as they come next (`ahead`), by hash slot, with what follows anyway (`base`)."""

    def __init__(self, past: np.ndarray, ahead: np.ndarray, base: np.ndarray, decay: float):
        self.past, self.ahead, self.base, self.decay = past, ahead, base, decay

    def slot(self, items) -> np.ndarray:
        return np.array([zlib.crc32(str(i).encode()) % len(self.base) for i in items], np.int64)

    def history(self, slots: np.ndarray, window: int) -> np.ndarray:
        """What the last items, the latest most, say about the next."""
        recent = slots[-window:][::-1]
        return (self.past[recent] * (self.decay ** np.arange(len(recent)))[:, None]).sum(0)


def _train_part(lists: list[np.ndarray], model: Transitions, window: int, rate: float, keep: float, drawn: np.ndarray, rng: np.random.Generator) -> Transitions:
    """One pass of pairwise steps over a task's sequences, on copies of the matrices: the next item against a drawn one.

    Sequences step side by side, fewer than there are slots in use, so that few of them meet on one slot; their steps add up.
    """
    past, ahead, base = model.past.copy(), model.ahead.copy(), model.base.copy()
    weights = model.decay ** np.arange(window)
    together = int(min(512, max(1, len(np.unique(drawn)) // 4)))
    lists = [lists[k] for k in rng.permutation(len(lists))]
    for at in range(0, len(lists), together):
        group = sorted(lists[at : at + together], key=len, reverse=True)
        length = np.array([len(s) for s in group])
        table = np.zeros((len(group), window + length[0]), np.int64)  # `window` empty places before the first item
        for n, s in enumerate(group):
            table[n, window : window + len(s)] = s
        others = drawn[rng.integers(0, len(drawn), (len(group), length[0]))]
        for t in range(1, length[0]):
            active = int(np.searchsorted(-length, -t))
            right, wrong = table[:active, window + t], others[:active, t]
            differ = right != wrong
            w = weights[None, :] * (np.arange(window) < t)
            before = table[:active, t : window + t][:, ::-1][differ]
            right, wrong = right[differ], wrong[differ]
            if not len(right):
                continue
            h = np.einsum("nw,nwr->nr", np.broadcast_to(w, before.shape), past[before])
            gap = ahead[right] - ahead[wrong]
            pull = rate / (1 + np.exp(np.minimum(50.0, (h * gap).sum(1) + base[right] - base[wrong])))
            used = before[:, : min(window, t)]
            _shrink(past, used.ravel(), keep)
            np.add.at(past, used.ravel(), ((pull[:, None] * w[:, : used.shape[1]])[:, :, None] * gap[:, None, :]).reshape(-1, past.shape[1]))
            step = pull[:, None] * h
            _shrink(ahead, np.concatenate([right, wrong]), keep)
            np.add.at(ahead, right, step)
            np.add.at(ahead, wrong, -step)
            np.add.at(base, right, pull)
            np.add.at(base, wrong, -pull)
    return Transitions(past, ahead, base, model.decay)


def _shrink(matrix: np.ndarray, rows: np.ndarray, keep: float) -> None:
    """Rows are shrunk once for each time they come."""
    own, times = np.unique(rows, return_counts=True)
    matrix[own] *= (keep**times)[:, None]


#: Sequences of a training task, about.
SHARD_ROWS = 25_000


def train_transitions(lists: DataFrame, rank: int = 16, slots: int = 1 << 14, epochs: int = 6, shards: int | None = None, window: int = 3, decay: float = 0.5, rate: float = 0.1, keep: float = 0.9995, seed: int = 42) -> Transitions:
    """Factorised transitions in the order of events, from sequences (items: array).

    Each epoch `shards` tasks make pairwise gradient steps over their sequences, starting from the same matrices, which are
    then averaged. Matrices are slots x rank, whatever the number of items; items of one slot share factors. shards: by default
    one for every SHARD_ROWS sequences, four at least, so that a task's work does not grow with the table.
    """
    spark = lists.sparkSession
    shards = shards or max(4, -(-lists.where(F.size("items") > 1).count() // SHARD_ROWS))
    rng = np.random.default_rng(seed)
    model = Transitions(rng.normal(0, 0.1, (slots, rank)), rng.normal(0, 0.1, (slots, rank)), np.zeros(slots), decay)
    path = io.scratch(spark, "sequences")
    place = F.pmod(F.xxhash64("items"), F.lit(shards)).cast("int")
    lists.where(F.size("items") > 1).select(place.alias("shard"), F.col("items").cast("array<string>").alias("items")).repartition(shards, "shard").write.parquet(path)
    dealt = spark.read.parquet(path)
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast(model)

        def step(batches, shared=shared, epoch=epoch):
            start = shared.value
            own, n = start, 0
            for b in batches:
                found = [start.slot(x) for x in b["items"]]
                if found:
                    drawn = np.concatenate(found)  # as often as items come
                    own = _train_part(found, own, window, rate, keep, drawn, np.random.default_rng([seed, epoch, len(drawn)]))
                    n += len(drawn)
            if n:
                yield _blocks(np.column_stack([own.past, own.ahead, own.base, np.ones(slots)]) * n)

        total = _sum_blocks(dealt.mapInPandas(step, "block int, values binary"), slots, 2 * rank + 2)
        if not total[:, -1].any():
            break
        mean = total / np.maximum(total[:, -1:], 1)
        model = Transitions(mean[:, :rank], mean[:, rank : 2 * rank], mean[:, 2 * rank], decay)
    return model


def transition_vectors(model: Transitions, lists: DataFrame, user: str, items: DataFrame, item: str, window: int = 3) -> tuple[DataFrame, DataFrame]:
    """(user, v) and (item, v): the greater the inner product, the likelier the item is next.

    Both get one more number, so that the nearest item of a user is the one with the greatest product.
    """
    spark = lists.sparkSession
    shared = spark.sparkContext.broadcast(model)
    longest = float(np.sqrt((model.ahead**2).sum(1) + model.base**2).max())

    def users(batches):
        m = shared.value
        for b in batches:
            made = [[*m.history(m.slot(x), window), 1.0, 0.0] for x in b["items"]]
            yield pd.DataFrame({"id": b["id"], "v": made})

    def things(batches):
        m = shared.value
        for b in batches:
            s = m.slot(b["id"].astype(str))
            own = np.column_stack([m.ahead[s], m.base[s]])
            rest = np.sqrt(np.maximum(longest**2 - (own**2).sum(1), 0))
            yield pd.DataFrame({"id": b["id"], "v": list(np.column_stack([own, rest]))})

    newest = lists.withColumn("_r", F.row_number().over(W.partitionBy(user).orderBy(F.desc("part")))).where("_r = 1")
    kind = lists.schema[user].dataType.simpleString()
    mine = newest.select(F.col(user).alias("id"), F.col("items").cast("array<string>").alias("items")).mapInPandas(users, f"id {kind}, v array<double>")
    every = items.select(F.col(item).alias("id")).distinct()
    of_items = every.mapInPandas(things, f"id {every.schema['id'].dataType.simpleString()}, v array<double>")
    return mine.withColumnRenamed("id", user), of_items.withColumnRenamed("id", item)
