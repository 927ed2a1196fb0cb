"""Runs of a text's words: stretches that repeat with a period three times or more, found as maximal pairs.

A pair of places (i, i + d) whose words agree for l words, and neither before nor after, is maximal. A stretch with period
d that no neighbouring word extends is exactly such a pair with l = length - d. So the pairs with l >= 2 * d and
l + d >= `least` are the runs, and nothing has to be extended; a run also shows with multiples of its period, of which the
smallest stays.

Maximal pairs come bottom-up from the tree of common-prefix intervals of the suffix array: places of an interval share l
words and differ behind them if they come from different children; they differ before them if they are of different classes
by the word on their left. An interval holds the lists of all classes as one list in order of place, each place labelled by
its left word: the two places of a run are neighbours in that list when their children meet (a place between would give a
smaller period), so each place of the smaller child meets two neighbours only, and the work is n log n.

Texts of an Arrow batch share a suffix array, sorted by prefix doubling in numpy; words of different texts never match, so
no pair leaves its text. Texts in which no `least * 2 / 3` words repeat have no run and are left out before that.

Words are what lies between ASCII white space. Cases: null and empty texts have no words and no runs; null ids and repeated
rows are kept as they are; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, nonnull_text
from .textkit import arrow_rows, batches

LEAST = 24
_BATCH_BYTES = 1 << 20


def _gram_repeats(ids: np.ndarray, n: int) -> np.ndarray:
    """Places whose n words (n a power of two) stand at another place, too."""
    rank = ids.copy()
    at = np.flatnonzero(np.bincount(rank)[rank] > 1)
    k = 1
    while k < n and len(at):
        alive = np.zeros(len(ids) + n, bool)
        alive[at] = True
        at = at[alive[at + k]]
        _, inverse, count = np.unique(rank[at] * len(ids) + rank[at + k], return_inverse=True, return_counts=True)
        rank[at] = inverse
        at = at[count[inverse] > 1]
        k *= 2
    return at


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and how many words each shares with the one before it."""
    n, levels, rank, k = len(ids), [], ids, 1
    while True:
        levels.append(rank)
        key = rank * (n + 1)
        key[: max(0, n - k)] += rank[k:] + 1
        values, rank = np.unique(key, return_inverse=True)
        if len(values) == n:
            break
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    i, j = order[:-1].copy(), order[1:].copy()
    for power in range(len(levels) - 1, -1, -1):
        step = 1 << power
        inside = np.flatnonzero(np.maximum(i, j) + step <= n)
        same = inside[levels[power][i[inside]] == levels[power][j[inside]]]
        i[same] += step
        j[same] += step
    return order, np.concatenate([[0], i - order[:-1]])


def maximal_runs(order: np.ndarray, shared: np.ndarray, left: list[int], least: int) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period, of all runs; `left` is the word before each place, -1 if none."""
    found: dict[tuple[int, int], int] = {}
    floor = least - least // 3  # a run of period d and l + d >= max(least, 3 * d) shares so many words at least

    def meet(l: int, a: list[int], b: list[int]) -> list[int]:
        """One list of two children's places; pairs across them."""
        if len(a) < len(b):
            a, b = b, a
        for p in b:
            at = bisect_left(a, p)
            for q in a[max(0, at - 1) : at + 1]:
                d = abs(p - q)
                if 2 * d <= l and l + d >= least and (left[p] != left[q] or left[p] < 0):
                    key = (min(p, q), max(p, q) + l)
                    if d < found.get(key, d + 1):
                        found[key] = d
        if b[0] > a[-1]:
            a += b
        elif b[-1] < a[0]:
            a[:0] = b
        elif len(b) * 16 < len(a):
            for p in b:
                a.insert(bisect_left(a, p), p)
        else:
            a += b
            a.sort()
        return a

    deep = np.flatnonzero(shared >= floor)
    if not len(deep):
        return found
    for part in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        places = order[part[0] - 1 : part[-1] + 1].tolist()
        depths, held = [], []  # open intervals: shared words, places
        for place, l in zip(places, [*shared[part].tolist(), 0], strict=True):
            here = [place]
            while depths and depths[-1] > l:
                here = meet(depths.pop(), held.pop(), here)
            if depths and depths[-1] == l:
                held[-1] = meet(l, held[-1], here)
            else:
                depths.append(l)
                held.append(here)
    return found


def find_runs(texts: list[list], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period."""
    ids, base, starts = [], 0, [0]
    for words in texts:
        known: dict = {}
        ids += [known.setdefault(w, base + len(known)) for w in words]
        base += len(known)
        starts.append(len(ids))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    all_ids, bounds = np.array(ids, np.int64), np.array(starts)
    floor = least - least // 3
    repeats = _gram_repeats(all_ids, 1 << (floor.bit_length() - 1)) if len(ids) >= least else []
    if not len(repeats):
        return out
    chosen = np.unique(np.searchsorted(bounds, repeats, side="right") - 1)
    rows = [(int(t), int(bounds[t]), int(bounds[t + 1])) for t in chosen]
    some = np.concatenate([all_ids[a:b] for _, a, b in rows])
    left, offset = np.concatenate([[-1], some[:-1]]), 0
    offsets = []
    for _, a, b in rows:
        left[offset] = -1
        offsets.append(offset)
        offset += b - a
    order, shared = suffix_order(np.unique(some, return_inverse=True)[1])
    for (start, end), period in maximal_runs(order, shared, left.tolist(), least).items():
        t = int(np.searchsorted(offsets, start, side="right")) - 1
        out[rows[t][0]].append((start - offsets[t], end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def scan(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs array<struct<start, length, period>>, collapsed: the text whose runs keep their first period."""

    def run(record_batches):
        for b in record_batches:
            n, runs, texts = [], [], []
            for part in batches((t for (t,) in arrow_rows([b], "text")), len, _BATCH_BYTES):
                cut = [t.encode("utf-8").split() for t in part]
                for words, found in zip(cut, find_runs(cut, least), strict=True):
                    n.append(len(words))
                    runs.append([{"start": s, "length": l, "period": p} for s, l, p in found])
                    texts.append(b" ".join(collapse(words, found)).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), nonnull_text(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def strongest(runs: Column | str) -> Column:
    """The run with the greatest length / period; ties: smallest start, then period. Null without runs."""
    runs = F.col(runs) if isinstance(runs, str) else runs

    def order(a: Column, b: Column) -> Column:
        first, second = a["length"] * b["period"], b["length"] * a["period"]
        tie = F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])
        return F.when(first > second, -1).when(first < second, 1).when(tie, -1).otherwise(1)

    return F.get(F.array_sort(runs, order), F.lit(0))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    best = scanned.withColumn("_best", strongest("runs"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return best.select(
        id_col,
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text: a tenth of the texts, by crc32 of the id, repeat themselves from some word on; rows without an id stay."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(nonnull_text(text_col), F.lit(f"[^{SPACES}]+"), F.lit(0))
    g, n = F.floor(h / 10).cast("long"), F.size("_words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    repeated = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    cut = docs.select(id_col, nonnull_text(text_col).alias("_text"), F.when(chosen, words).alias("_words"))
    placed = cut.withColumns({"_a": F.when(n > 0, a).cast("int"), "_p": F.when(n > 0, p).cast("int")})
    return placed.select(F.col(id_col), F.when(F.col("_p").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("_text")).alias(text_col))
