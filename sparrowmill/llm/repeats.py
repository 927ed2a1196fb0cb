"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

The suffix array is sparse and distributed. Only suffixes at anchors enter it: in every 50-byte window the 24-byte
string with the smallest hash, at all places where it is smallest. Equal windows have equal anchors at equal places,
so two occurrences of a string of 50 bytes or more always meet at a common anchor.

1. Documents are gathered, as they lie, into chunks of a few MB in a table bucketed by chunk. Later steps read it
   bucket by bucket, so texts are never shuffled again.
2. Each chunk sends the sorted distinct hashes of its anchors to owners of hash ranges, which answer with one bit a
   hash: does another document hold it? A hash that a third of all documents hold is sent once a chunk.
3. Around the anchors that are held, chunks send the distinct contexts (26 bytes to the left, 50 from the anchor on)
   with the smallest id that has each. An owner sorts the contexts of an anchor by what follows: an enhanced suffix
   array with common-prefix lengths. A stack scan yields its common-prefix intervals. In each, the diversity of the left
   extensions tells maximal repeat groups apart, with all their occurrences: those that agree on the a bytes to the left
   and the 50 - a from the anchor on. The smallest id of a group goes back to its members as a bit for each a.
4. Chunks mark the windows that were found, remove the bytes they cover, and keep the rest.

Bytes decide everywhere; hashes only choose where to compare. Steps 2 and 3 hold a bounded range of hashes or
contexts; a chunk is a few MB, or one text if that is longer.

Cases: null and empty texts are zero bytes. Null ids are larger than all others and equal to each other. Rows that
repeat an id are one document: they never remove from each other. Ids are read as long. Texts below 50 bytes lose nothing. Extra
columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import io
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _TABLES, _WRITTEN, materialise, nonnull_text, shared_folder
from .textkit import U, arrow_rows, batches, mix

WINDOW, GRAM = 50, 24
SIDE = WINDOW - GRAM  # bytes to the left of an anchor that a window can hold
CONTEXT = SIDE + WINDOW
CHUNK_BYTES = 2 << 20
OWNER_BYTES = 3 << 20  # of text whose anchors an owner gets
NO_ID = np.iinfo(np.int64).max
_STEP = 1 << 18
_BITS = np.arange(SIDE + 1)


def _pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    data = io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))
    return [np.load(data, allow_pickle=False) for _ in range(n)]


def _planes(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as the byte planes of their differences, which compress well."""
    return np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _from_planes(p: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(p.T).view(U).ravel(), dtype=U)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of `width` elements."""
    size = 1
    while size * 2 <= width:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: -(width - size)], x[width - size :]) if size < width else x


class Chunk:
    """Documents in one buffer, with their anchors."""

    def __init__(self, blob: bytes):
        self.ids, lengths, text = _unpack(blob, 3)
        self.n = len(text)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.padded = np.concatenate([np.zeros(SIDE, np.uint8), text, np.zeros(WINDOW + 32, np.uint8)])
        self.text = self.padded[SIDE:]
        ok = np.zeros(self.n + 1, np.int32)
        long = lengths >= WINDOW
        np.add.at(ok, self.starts[long], 1)
        np.add.at(ok, self.ends[long] - WINDOW + 1, -1)
        self.valid = np.cumsum(ok)[:-1] > 0
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        every = np.ndarray((len(self.text) - 7,), "<u8", np.ascontiguousarray(self.text), strides=(1,))
        span = SIDE + 1
        for a in range(0, self.n, _STEP):
            valid = self.valid[a : a + _STEP]
            if not valid.any():
                continue
            m = len(valid) + SIDE
            w = every[a : a + m + 16].astype(U)
            h = mix(w[:m] * U(0x9E3779B97F4A7C15) + (w[8 : 8 + m] ^ U(0xC2B2AE3D27D4EB4F)) * U(0x165667B19E3779F9) + mix(w[16 : 16 + m] + U(1)))
            low = np.where(valid, _slide(h, span, np.minimum), U(0))
            edge = np.zeros(SIDE, U)
            high = _slide(np.concatenate([edge, low, edge]), span, np.maximum)
            at = np.flatnonzero((high == h) & (high != 0))
            places.append(at + a)
            hashes.append(h[at])
        self.at, first = np.unique(np.concatenate(places), return_index=True)
        self.h = np.concatenate(hashes)[first] >> U(16)
        self.doc = np.searchsorted(self.ends, self.at, side="right")

    def census(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes; whether several documents of this chunk hold each."""
        order = np.argsort(self.h, kind="stable")
        h, ids = self.h[order], self.ids[self.doc[order]]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(first):
            return h, np.zeros(0, bool)
        return h[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)

    def contexts(self, shared: np.ndarray) -> dict:
        """Of the anchors whose distinct hash is shared: their contexts, and the distinct ones in order of hash."""
        distinct = np.unique(self.h)
        use = np.flatnonzero(shared[np.searchsorted(distinct, self.h)]) if len(self.h) else np.zeros(0, np.int64)
        at, doc = self.at[use], self.doc[use]
        left, right = np.minimum(SIDE, at - self.starts[doc]), np.minimum(WINDOW, self.ends[doc] - at)
        rows = np.zeros((len(at), CONTEXT + 4), np.uint8)
        rows[:, :CONTEXT] = np.lib.stride_tricks.sliding_window_view(self.padded, CONTEXT)[at]
        cut = np.flatnonzero((left < SIDE) | (right < WINDOW))
        column = np.arange(CONTEXT)[None, :]
        rows[cut, :CONTEXT] *= (column >= SIDE - left[cut, None]) & (column < SIDE + right[cut, None])
        rows[:, CONTEXT], rows[:, CONTEXT + 1] = left, right
        order, first = _distinct(rows, self.h[use])
        group = np.zeros(len(at), np.int64)
        group[order] = np.cumsum(first) - 1
        ids = self.ids[doc]
        begin = np.flatnonzero(first)
        least = np.minimum.reduceat(ids[order], begin) if len(begin) else np.zeros(0, np.int64)
        return {"at": at, "ids": ids, "left": left, "right": right, "group": group, "rows": rows[order[begin]], "least": least, "h": self.h[use][order[begin]]}


def _row_hash(rows: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(rows), U)
    for word in np.ascontiguousarray(rows).view("<u8").reshape(len(rows), -1).T if len(rows) else []:
        acc = mix(acc + word * U(0x9E3779B97F4A7C15) + U(1))
    return acc


def _distinct(rows: np.ndarray, major: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, by `major` first, and where a new row begins in it."""
    order = np.lexsort((_row_hash(rows), major))
    if not len(order):
        return order, np.zeros(0, bool)
    sorted_rows = rows[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_rows[1:] != sorted_rows[:-1]).any(1) | (major[order][1:] != major[order][:-1])
    return order, new


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> U(16)) * U(n)) >> U(32)).astype(np.int64)


def _split(key: np.ndarray) -> list[tuple[int, slice]]:
    """Runs of equal keys in a sorted array."""
    if not len(key):
        return []
    edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return [(int(key[a]), slice(a, b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _same_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def _shared_bits(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner of a range of anchor hashes: which do several documents hold?"""
    parts = [_unpack(x, 2) for x in pdf["payload"]]
    hashes = [_from_planes(p) for p, _ in parts]
    sizes = [len(h) for h in hashes]
    h, inside = np.concatenate(hashes), np.concatenate([np.unpackbits(f)[:n].astype(bool) for (_, f), n in zip(parts, sizes, strict=True)])
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    count = np.diff(np.append(first, len(h)))
    held = (count > 1) | np.logical_or.reduceat(inside[order], first)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(held, count)
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": 1, "bucket": pdf["bucket"], "payload": [_pack(np.packbits(x), np.array([len(x)])) for x in np.split(out, np.cumsum(sizes)[:-1])]})


def prefix_intervals(lcp: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Stack scan of an enhanced suffix array: (first, last, common prefix, that of the parent) of every interval
    whose suffixes share `least` or more. lcp[i] is the common prefix of suffixes i - 1 and i; lcp[0] is 0."""
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        begin = i - 1
        while stack[-1][0] > now:
            depth, begin = stack.pop()
            if depth >= least:
                out.append((begin, i - 1, depth, max(stack[-1][0], now)))
        if stack[-1][0] < now:
            stack.append((now, begin))
    return out


def _group_ids(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For distinct contexts and every a: the smallest id that has the same a bytes to the left and 50 - a from the anchor on."""
    left, right = rows[:, CONTEXT].astype(np.int64), rows[:, CONTEXT + 1].astype(np.int64)
    valid = (left[:, None] >= _BITS) & (right[:, None] >= WINDOW - _BITS)
    found = np.where(valid, least[:, None], NO_ID)
    ahead, back = rows[:, SIDE:CONTEXT], rows[:, SIDE - 1 :: -1] if SIDE else rows[:, :0]
    gram = _row_hash(np.ascontiguousarray(ahead[:, :GRAM]))
    order = np.argsort(gram, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
    count = np.diff(np.append(first, len(order)))
    two = first[count == 2]
    if len(two):
        i, j = order[two], order[two + 1]
        r, b = _same_prefix(ahead[i], ahead[j]), _same_prefix(back[i], back[j])
        both = (_BITS <= b[:, None]) & (WINDOW - _BITS <= r[:, None]) & valid[i] & valid[j]
        low = np.minimum(least[i], least[j])[:, None]
        found[i] = np.where(both, np.minimum(found[i], low), found[i])
        found[j] = np.where(both, np.minimum(found[j], low), found[j])
    many = order[np.repeat(count > 2, count)]
    if not len(many):
        return found
    words = np.zeros((len(many), 56), np.uint8)
    words[:, :WINDOW] = ahead[many]
    keys = words.view(">u8").astype(U)
    many = many[np.lexsort(tuple(keys[:, c] for c in range(6, -1, -1)))]
    lcp = [0, *_same_prefix(ahead[many][:-1], ahead[many][1:]).tolist()]
    before = [x.tobytes() for x in np.ascontiguousarray(back[many])]
    extension = [SIDE, *_same_prefix(back[many][:-1], back[many][1:]).tolist()]
    ids, ok, res = least[many], valid[many], found[many]
    for a, b, depth, above in prefix_intervals(lcp, GRAM):
        low, high = WINDOW - depth, min(SIDE, WINDOW - max(above, GRAM - 1) - 1)
        if low > high:
            continue
        common = min(extension[a + 1 : b + 1])  # the left extensions agree so far
        for k in range(low, high + 1):
            if k <= common:
                here = ok[a : b + 1, k]
                if here.any():
                    res[a : b + 1, k] = np.where(here, np.minimum(res[a : b + 1, k], ids[a : b + 1][here].min()), res[a : b + 1, k])
                continue
            groups: dict[bytes, list[int]] = {}
            for x in range(a, b + 1):
                if ok[x, k]:
                    groups.setdefault(before[x][:k], []).append(x)
            for members in groups.values():
                if len(members) > 1:
                    res[members, k] = np.minimum(res[members, k], ids[members].min())
    found[many] = res
    return found


def _masks(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner of a range of anchors: for each context sent, the windows that a document with a smaller id has."""
    parts = [_unpack(x, 2) for x in pdf["payload"]]
    sizes = [len(x[1]) for x in parts]
    rows, ids = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    order, new = _distinct(rows, np.zeros(len(rows), U))
    begin = np.flatnonzero(new)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    found = _group_ids(rows[order[begin]], np.minimum.reduceat(ids[order], begin))
    mask = ((found[which] < ids[:, None]).astype(np.uint32) << _BITS.astype(np.uint32)).sum(1, dtype=np.uint32)
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": 2, "bucket": pdf["bucket"], "payload": [_pack(x) for x in np.split(mask, np.cumsum(sizes)[:-1])]})


def _shared(answers: pd.DataFrame) -> np.ndarray:
    mine = answers[answers["kind"] == 1].sort_values("bucket")
    parts = [np.unpackbits(b)[: n[0]].astype(bool) for b, n in (_unpack(x, 2) for x in mine["payload"])]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _covered(chunk: Chunk, answers: pd.DataFrame) -> np.ndarray:
    found = chunk.contexts(_shared(answers))
    mine = answers[answers["kind"] == 2].sort_values("bucket")
    masks = np.concatenate([np.zeros(0, np.uint32), *[_unpack(x, 1)[0] for x in mine["payload"]]])
    start = np.zeros(chunk.n + 1, bool)
    if len(found["at"]):
        mask, later = masks[found["group"]], found["ids"] > found["least"][found["group"]]
        for a in range(SIDE + 1):
            hit = (((mask >> np.uint32(a)) & np.uint32(1)).astype(bool) | later) & (found["left"] >= a) & (found["right"] >= WINDOW - a)
            start[found["at"][hit] - a] = True
    sums = np.concatenate([[0], np.cumsum(start[:-1])])
    return sums[1:] > np.concatenate([np.zeros(min(WINDOW, chunk.n), np.int64), sums[1 : chunk.n - WINDOW + 1]])[: chunk.n]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_bytes: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the removed runs, kept (bytes).

    With keep_bytes False the last three are null, for callers that want figures only.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def gather(record_batches):
        rows = ((NO_ID if i is None else i, t.encode("utf-8")) for i, t in arrow_rows(record_batches, "id", "text"))
        for held in batches(rows, lambda r: len(r[1]) + 8, chunk_bytes):
            lengths = np.array([len(t) for _, t in held], np.int64)
            blob = _pack(np.array([i for i, _ in held], np.int64), lengths, np.frombuffer(b"".join(t for _, t in held), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "n", "blob"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), nonnull_text(text_col).alias("text"))
    table = f"chunks_{uuid.uuid4().hex}"
    _TABLES.append(table)
    _WRITTEN.append(f"{shared_folder(spark)}/{table}")
    rows.mapInArrow(gather, "chunk long, n long, blob binary").write.format("parquet").option("compression", "none").option("path", f"{shared_folder(spark)}/{table}").bucketBy(n, "chunk").saveAsTable(table)
    chunks = spark.table(table)
    total = chunks.agg(F.sum("n")).first()[0] or 0
    owners = int(min(2**31 - 1, max(n, total // OWNER_BYTES)))

    def ask(record_batches):
        for number, blob in arrow_rows(record_batches, "chunk", "blob"):
            h, inside = Chunk(blob).census()
            parts = [(b, _pack(_planes(h[s]), np.packbits(inside[s]))) for b, s in _split(_bucket(h, owners))]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(parts), pa.int64()), pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["chunk", "bucket", "payload"])

    sent, answer = "chunk long, bucket int, payload binary", "chunk long, kind int, bucket int, payload binary"
    asked = chunks.select("chunk", "blob").mapInArrow(ask, sent)
    shared = materialise(asked.groupBy("bucket").applyInPandas(_shared_bits, answer), "shared")

    def contexts(held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for number, blob in zip(held["chunk"], held["blob"], strict=True):
            found = Chunk(blob).contexts(_shared(answers))
            parts += [(number, b, _pack(found["rows"][s], found["least"][s])) for b, s in _split(_bucket(found["h"], owners))]
        return pd.DataFrame(parts, columns=["chunk", "bucket", "payload"])

    offered = chunks.select("chunk", "blob").groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(contexts, sent)
    masks = materialise(offered.groupBy("bucket").applyInPandas(_masks, answer), "masks")

    def finish(held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in held["blob"]:
            chunk = Chunk(blob)
            gone = _covered(chunk, answers)
            text = chunk.text[: chunk.n]
            for i, a, b in zip(chunk.ids, chunk.starts, chunk.ends, strict=True):
                part = gone[a:b]
                kept = text[a:b][~part].tobytes()
                edge = np.diff(part.astype(np.int8), prepend=0, append=0)
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                row = (None if i == NO_ID else int(i), int(b - a), int(part.sum()), len(begin), hashlib.sha256(kept).hexdigest())
                out.append((*row, begin.tolist(), end.tolist(), kept) if keep_bytes else (*row, None, None, None))
        frame = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept"])
        return frame.astype({"id": "Int64"})

    answers = shared.unionByName(masks)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, kept binary"
    done = chunks.select("chunk", "blob").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(finish, schema)
    return done.withColumnRenamed("id", id_col)
