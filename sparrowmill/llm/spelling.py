"""Spelling variants: words of a corpus one edit apart, found by range searches in k-d trees over letter counts.

A word is a point: how often it holds each letter. One letter replaced moves the point by one up and one down, one letter
inserted by one up. So the neighbours of a word of length n lie among words of length n at one up and one down, and of
length n + 1 at one up; a search of a tree keeps what it still may move up and down, and leaves out boxes farther away.
The points found tell which letters changed; that the rest stands in order is verified on the letters.

The upper levels of the trees, one tree a length, come from a bounded sample of the words and only deal the work: a word
goes to its own cell, and asks every cell whose box its budget reaches. In a cell the tree goes on over all its words.
Cells that hold more words than MOST, or are asked more often, are cut into parts, each of which meets each.

Words are maximal runs of the letters a-z (A-Z are lower-cased, no others) and U+00C0 to U+00FF. Cases: null and empty texts
have none; a null id reads as an empty one; repeated rows count; extra columns are not read; no words give no rows. Of
near words of equal count the smallest in code-point order is the form.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, nonnull_text
from .textkit import arrow_rows

SAMPLE = 16_384
CELL = 8_192  # words of a cell, about
MOST = 65_536
LEAF = 64
_COUNTED = 200_000
_ASKED = 4_096
_LETTERS = 90  # a-z, then U+00C0 to U+00FF

def count_words(docs: DataFrame, shortest: int = 7, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words of at least `shortest` letters.

    With `noise`, a run whose crc32 of "id:run" it divides loses the letter at that number modulo its length first; with 0 none.
    """
    longer = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}").findall

    def run(record_batches):
        held: Counter = Counter()
        for key, text in arrow_rows(record_batches, "id", "text"):
            runs = Counter(longer(text.encode("utf-8").lower().decode("utf-8")))
            if noise:
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word in list(runs):
                    h = zlib.crc32(word.encode("utf-8"), prefix)
                    if h % noise == 0:
                        at, n = h % len(word), runs.pop(word)
                        if len(word) > shortest:
                            held[word[:at] + word[at + 1 :]] += n
            held.update(runs)
            if len(held) > _COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), nonnull_text(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letters (Latin-1)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def points(rows: np.ndarray) -> np.ndarray:
    """How often each word holds each letter."""
    kind = np.uint8 if rows.shape[1] < 256 else np.int32
    out = np.zeros((len(rows), _LETTERS), kind)
    place, at = np.where(rows < 128, rows - 97, rows - 166).astype(np.int64), np.arange(len(rows))
    for j in range(rows.shape[1]):
        out[at, place[:, j]] += 1
    return out


def _split(data: np.ndarray) -> tuple[int, int] | None:
    """The letter whose counts differ most, and the count that at most goes left; None if all points are one."""
    low, high = data.min(0), data.max(0)
    if (low == high).all():
        return None
    some = data if len(data) <= 1024 else data[:: len(data) // 1024]
    spread = some.astype(np.float32).var(0)
    d = int(np.where(low < high, spread + 1e-6, -1).argmax())
    return d, min(max(int(np.median(some[:, d])), int(low[d])), int(high[d]) - 1)


def _deal(split: tuple[int, int], x: np.ndarray, box: tuple[dict, dict], up: np.ndarray, down: np.ndarray):
    """For each half: its box (smallest and largest counts by letter) and what the asking points could still move there.

    x: the asking points' counts of the letter that the halves are split by.
    """
    (d, c), (low, high) = split, box
    x = x.astype(np.int32)
    at_least, at_most = low.get(d, 0), high.get(d, 1 << 30)
    down_left = down - (np.maximum(x - c, 0) - np.maximum(x - at_most, 0))
    up_right = up - (np.maximum(c + 1 - x, 0) - np.maximum(at_least - x, 0))
    return ((low, high | {d: c}), up, down_left), ((low | {d: c + 1}, high), up_right, down)


class TopTree:
    """The upper levels of one length's tree: cells by number."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cells = 0
        self.root = self._grow(sample, cells)

    def _grow(self, data: np.ndarray, cells: int):
        split = _split(data) if cells > 1 and len(data) > 1 else None
        if split is None:
            self.cells += 1
            return self.cells - 1
        left = data[:, split[0]] <= split[1]
        share = min(cells - 1, max(1, round(cells * left.mean())))
        return split, self._grow(data[left], share), self._grow(data[~left], cells - share)

    def reach(self, asked: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of all cells that a point reaches by moving at most so much up and down."""
        out, n = [], len(asked)
        todo = [(self.root, np.arange(n), ({}, {}), np.full(n, up), np.full(n, down))]
        while todo:
            node, who, box, ups, downs = todo.pop()
            if isinstance(node, int):
                out.append((who, np.full(len(who), node)))
                continue
            for half, (inner, u, d) in zip(node[1:], _deal(node[0], asked[who, node[0][0]], box, ups, downs), strict=True):
                ok = (u >= 0) & (d >= 0)
                if ok.any():
                    todo.append((half, who[ok], inner, u[ok], d[ok]))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _bits(data: np.ndarray) -> np.ndarray:
    """Two words of bits a point, as many apart as the points or fewer: a letter's count in unary as far as there is room."""
    room = [data >= 1, data[:, :26] >= 2, data[:, :12] >= 3]
    packed = np.packbits(np.concatenate(room, axis=1), axis=1)
    return np.ascontiguousarray(packed.view(np.uint64).T)


def near_points(data: np.ndarray, asked: np.ndarray, up: int, down: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(asked, data, one point) index pairs that are `up` up and `down` down, leaf by leaf of a tree over data.

    Leaves of one point with more than LEAF words are not paired off: they come as (asking, all of the leaf, True).
    """
    out, n = [], len(asked)
    data_bits, asked_bits = _bits(data), _bits(asked)
    todo = [(np.arange(len(data)), np.arange(n), ({}, {}), np.full(n, up, np.int32), np.full(n, down, np.int32))]
    while todo:
        have, who, box, ups, downs = todo.pop()
        split = _split(data[have]) if len(have) > LEAF else None
        if split is not None:
            left = data[have, split[0]] <= split[1]
            for half, (inner, u, d) in zip((have[left], have[~left]), _deal(split, asked[who, split[0]], box, ups, downs), strict=True):
                ok = (u >= 0) & (d >= 0)
                if ok.any():
                    todo.append((half, who[ok], inner, u[ok], d[ok]))
            continue
        one = len(have) > LEAF
        there = have[:1] if one else have
        for at in range(0, len(who), _ASKED):
            some = who[at : at + _ASKED]
            apart = sum(np.bitwise_count(asked_bits[w][some][:, None] ^ data_bits[w][there]) for w in (0, 1))
            q, k = np.nonzero(apart <= up + down)
            q, k = some[q], there[k]
            moved = data[k].astype(np.int32) - asked[q]
            ok = (np.maximum(moved, 0).sum(1) == up) & (np.maximum(-moved, 0).sum(1) == down)
            if ok.any():
                out.append((q[ok], have if one else k[ok], one))
    return out


def _ordered(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of `short` are those of `long` with one letter replaced (same length) or left out (one longer)."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    n = short.shape[1]
    head, tail = short == long[:, :n], short == long[:, 1:]
    heads = np.where(head.all(1), n, head.argmin(1))
    tails = np.where(tail.all(1), n, tail[:, ::-1].argmin(1))
    return heads + tails >= n


def near_words(data: list[str], asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(asked, data) index pairs one edit apart; all of data have one length, all asked that or one less."""
    have, ask = letters(data), letters(asked)
    same = have.shape[1] == ask.shape[1]
    out_q, out_k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, k, one in near_points(points(have), points(ask), 1, int(same)):
        if one:  # too many words of the same letters to compare each: ask for those that an edit makes
            place = {data[i]: i for i in k.tolist()}
            alphabet = sorted(set(data[k[0]]))
            for i in q.tolist():
                word = asked[i]
                new = [c for c in alphabet if data[k[0]].count(c) > word.count(c)][0]
                cuts = range(len(word)) if same else range(len(word) + 1)
                made = {word[:j] + new + word[j + same :] for j in cuts if not same or word[j] != new}
                hits = [place[m] for m in made if m in place]
                out_q.append(np.full(len(hits), i))
                out_k.append(np.array(hits, np.int64))
            continue
        for at in range(0, len(q), 1 << 16):
            a, b = q[at : at + (1 << 16)], k[at : at + (1 << 16)]
            ok = _ordered(ask[a], have[b])
            out_q.append(a[ok])
            out_k.append(b[ok])
    return np.concatenate(out_q), np.concatenate(out_k)


def _top_trees(words: DataFrame) -> dict[int, TopTree]:
    """Trees by length from SAMPLE words by hash, with cells for about CELL words each. Lengths without sample have one cell."""
    total = words.count()
    picked = [r[0] for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    by_length: dict[int, list[str]] = {}
    for w in picked:
        by_length.setdefault(len(w), []).append(w)
    return {n: TopTree(points(letters(some)), math.ceil(total * len(some) / len(picked) / CELL)) for n, some in by_length.items()}


def _dealt(words: DataFrame, trees) -> DataFrame:
    """length, cell, role (0: stands there, 1: asks there), word, n: a row for each cell that a word has to do with."""

    def run(record_batches):
        for b in record_batches:
            by_length: dict[int, list[tuple[str, int]]] = {}
            for word, n in arrow_rows([b], "word", "n"):
                by_length.setdefault(len(word), []).append((word, n))
            for length, some in by_length.items():
                names, counts = pa.array([w for w, _ in some]), pa.array([n for _, n in some], pa.int64())
                at = points(letters([w for w, _ in some]))
                for goal, role, up, down in ((length, 0, 0, 0), (length, 1, 1, 1), (length + 1, 1, 1, 0)):
                    tree = trees.value.get(goal)
                    who, cell = tree.reach(at, up, down) if tree else (np.arange(len(some)), np.zeros(len(some), np.int64))
                    columns = [np.full(len(who), goal, np.int32), cell.astype(np.int32), np.full(len(who), role, np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), names.take(pa.array(who)), counts.take(pa.array(who))], ["length", "cell", "role", "word", "n"])

    return words.mapInArrow(run, "length int, cell int, role int, word string, n long")


def _parts(dealt: DataFrame) -> DataFrame:
    """dealt with the part of its cell: cells of more than MOST words, or asked by more than 8 * MOST, are cut on both sides."""
    per = lambda rows, most: F.greatest(F.ceil(F.sum(rows) / most), F.lit(1)).cast("int")
    size = dealt.groupBy("length", "cell").agg(per(1 - F.col("role"), MOST).alias("_stand"), per(F.col("role"), 8 * MOST).alias("_ask"))
    cut = dealt.join(size.where("_stand > 1 OR _ask > 1"), ["length", "cell"], "left").fillna(1, ["_stand", "_ask"])
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    stands = F.transform(numbers("_ask"), lambda other: mine("_stand") * F.col("_ask") + other)
    asks = F.transform(numbers("_stand"), lambda other: other * F.col("_ask") + mine("_ask"))
    return cut.withColumn("_part", F.explode(F.when(F.col("role") == 0, stands).otherwise(asks))).drop("_stand", "_ask")


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, form, form_n: what the near words found in one part of a cell add up to, on both sides."""
    stands, asks = group[group["role"] == 0], group[group["role"] == 1]
    found = []
    if len(stands):
        data, data_n = stands["word"].tolist(), stands["n"].to_numpy()
        for length, some in asks.groupby(asks["word"].str.len()):
            asked, asked_n = some["word"].tolist(), some["n"].to_numpy()
            q, k = near_words(data, asked)
            both = [(np.array(asked, object)[q], np.array(data, object)[k], data_n[k])]
            if length < len(data[0]):
                both.append((np.array(data, object)[k], np.array(asked, object)[q], asked_n[q]))
            found += [pd.DataFrame({"word": w, "form": f, "form_n": n}) for w, f, n in both]
    if not found:
        return pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype="int64"), "form": pd.Series(dtype=str), "form_n": pd.Series(dtype="int64")})
    pairs = pd.concat(found).sort_values(["word", "form_n", "form"], ascending=[True, False, True])
    first = pairs.drop_duplicates("word")
    return first.assign(n_near=first["word"].map(pairs["word"].value_counts()))[["word", "n_near", "form", "form_n"]]


def near_counts(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of words (word, n; each word once) with a near word: their number and the most frequent."""
    trees = words.sparkSession.sparkContext.broadcast(_top_trees(words))
    parts = _parts(materialise(_dealt(words, trees), "spelling-cells"))
    met = parts.groupBy("length", "cell", "_part").applyInPandas(_meet, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", F.col("_best.form").alias("form"), (-F.col("_best.n")).alias("form_n"))


def variants(docs: DataFrame, shortest: int = 7, fewest: int = 2, factor: int = 10, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words with at least `fewest` occurrences.

    The form is the most frequent near word if it is `factor` times as frequent; the root is the last of the forms. Counts
    grow by the factor along the chain, so its length has a bound, and half as many joins each time follow it.
    """
    words = materialise(count_words(docs, shortest, noise, id_col, text_col).where(F.col("n") >= fewest), "spelling-words")
    near = near_counts(words)
    ok = F.col("form_n") >= factor * F.col("n")
    rows = words.join(near, "word", "left").select("word", F.when(ok, F.col("form")).alias("form"), F.when(ok, F.col("form_n")).alias("form_n"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"))
    rows = materialise(rows, "spelling-forms")
    step = materialise(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-steps")
    most = words.agg(F.max("n")).first()[0] or 1
    reach, goal = 1, math.ceil(math.log(most, factor)) + 1
    while reach < goal:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = step.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        reach *= 2
    return rows.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

