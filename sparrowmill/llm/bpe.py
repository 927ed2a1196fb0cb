"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; every piece is merged alone. For a piece, the leaves of a segment tree hold
the rank of the pair that starts at each live byte position (no pair: the largest number); an inner node holds the
smallest rank below it, and descending to the left on ties finds the leftmost minimum. A merge joins two live
neighbours and updates the leaves of the two pairs that changed, in logarithmic time each. A piece of n bytes so takes
O(n log n), however long. The short pieces of a batch of texts grow their trees side by side in arrays, long ones alone;
pieces met before come from a bounded table of the worker, with their ids and what the ids decode to.

The vocabulary (base64 token, rank a line) is read on the driver from the path given, checked to be of bounded size, and
broadcast, so executors need no file of their own.

Cases: null texts count as empty and have no tokens; null ids and repeated rows are kept as they are; extra columns
are not read. decode of null ids gives null; ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nonnull_text
from .textkit import arrow_rows, batches

MOST_VOCABULARY_BYTES = 64 << 20
MOST_PIECES = 100_000
_NONE = 1 << 60
_NO_PAIR = np.iinfo(np.int32).max
_TOGETHER = 64  # longer pieces, in bytes, are merged alone
_GROUP = 1 << 14
_BATCH_BYTES = 1 << 20


def load_ranks(blob: bytes) -> dict[bytes, int]:
    ranks = {}
    for line in blob.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one piece."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    if n < 2:
        raise KeyError(f"the vocabulary lacks the byte {piece!r}")
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))  # the live position after i, n at the end: also where i's token ends
    before = list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while (low := tree[1]) < _NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        i -= size
        j = after[i]
        k = after[i] = after[j]
        put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, get(piece[i : after[k]], _NONE))
        else:
            put(i, _NONE)
        if (h := before[i]) >= 0:
            put(h, get(piece[h:k], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


class Pairs:
    """rank of what two tokens join to, by their ids; a table of open addresses in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys, values = _pair(np.array(left, np.int64), np.array(right, np.int64)), np.array(rank, np.int32)
        self.bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NO_PAIR, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = _pair(left.astype(np.int64), right.astype(np.int64))
        slot, out, at = self._slot(keys), np.full(len(keys), _NO_PAIR, np.int32), np.arange(len(keys))
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            keys, slot, at = keys[more], (slot[more] + 1) & ((1 << self.bits) - 1), at[more]
        return out


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << 32) | right


def merge_pieces(pieces: list[bytes], of_byte: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces of two bytes or more, behind each other, and how many each has.

    The same segment trees as merge_piece's, one a piece and all of one size: in a round each piece that still has
    a pair makes its next merge.
    """
    n = np.array([len(p) for p in pieces])
    size = 1 << int(n.max() - 1).bit_length()
    rows = np.arange(len(pieces))
    place = np.arange(size)
    inside = place < n[:, None]
    ids = np.zeros((len(pieces), size), np.int32)
    ids[inside] = of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    live = inside.copy()
    after, before = np.tile(np.arange(1, size + 2), (len(pieces), 1)), np.tile(np.arange(-1, size), (len(pieces), 1))
    tree = np.full((len(pieces), 2 * size), _NO_PAIR, np.int32)
    joined = place[:-1] + 1 < n[:, None]
    tree[:, size:-1][joined] = pairs.find(ids[:, :-1][joined], ids[:, 1:][joined])
    for i in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])

    def put(r: np.ndarray, i: np.ndarray, rank: np.ndarray) -> None:
        i = i + size
        tree[r, i] = rank
        while size > 1 and i[0] > 1:
            i = i >> 1
            tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

    def rank_of(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The rank of live neighbours i and j; none if either lies outside the piece."""
        out, ok = np.full(len(r), _NO_PAIR, np.int32), (i >= 0) & (j < n[r])
        out[ok] = pairs.find(ids[r[ok], i[ok]], ids[r[ok], j[ok]])
        return out

    while len(rows := rows[tree[rows, 1] < _NO_PAIR]):
        low, i = tree[rows, 1], np.ones(len(rows), np.int64)
        while i[0] < size:
            i = 2 * i
            i += tree[rows, i] != low
        i -= size
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i], live[rows, j] = low, False
        after[rows, i], before[rows, k] = k, i
        put(rows, j, _NO_PAIR)
        put(rows, i, rank_of(rows, i, k))
        h = before[rows, i]
        some = h >= 0
        if some.any():
            put(rows[some], h[some], rank_of(rows[some], h[some], i[some]))
    return ids[live], live.sum(1)


class Tokenizer:
    """Encodes and decodes by ranks; keeps up to MOST_PIECES pieces: their ids as text and what they decode to."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.pieces: dict[str, tuple[str, bytes]] = {}
        whole = all(bytes([b]) in ranks for b in range(256))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32) if whole else None
        self.pairs = Pairs(ranks) if whole else None

    def _entry(self, ids) -> tuple[str, bytes]:
        return ",".join([self.names[i] for i in ids]), self.decode(ids)

    def _learn(self, new: set[str]) -> None:
        """Entries of pieces that are not kept yet; short ones are merged together."""
        of_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            data = piece.encode("utf-8")
            if self.pairs is None or data in self.ranks or len(data) > _TOGETHER:
                self.pieces[piece] = self._entry(merge_piece(data, self.ranks))
            else:
                of_size.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
        for group in of_size.values():
            for at in range(0, len(group), _GROUP):
                part = group[at : at + _GROUP]
                ids, n = merge_pieces([d for _, d in part], self.of_byte, self.pairs)
                ids, ends = ids.tolist(), np.cumsum(n).tolist()
                for (piece, _), a, b in zip(part, [0, *ends], ends, strict=False):
                    self.pieces[piece] = self._entry(ids[a:b])

    def entries(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """The ids as text, and the bytes they decode to, of every piece of every text."""
        cut = list(map(self.find, texts))
        distinct = set(itertools.chain.from_iterable(cut))
        if len(self.pieces) + len(distinct) > MOST_PIECES:
            self.pieces.clear()
        self._learn(distinct.difference(self.pieces))
        out = [list(map(self.pieces.__getitem__, c)) for c in cut]
        for piece in distinct:
            if len(piece) > _TOGETHER:
                del self.pieces[piece]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for e in found for i in e[0].split(",")] for found in self.entries(texts)]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_LOADED: dict[tuple[str, str], Tokenizer] = {}


def _tokenizer(shared, pattern: str) -> Tokenizer:
    digest, blob = shared.value
    if (digest, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[digest, pattern] = Tokenizer(load_ranks(blob), pattern)
    return _LOADED[digest, pattern]


def _share(spark, path: str):
    with open(path, "rb") as f:
        blob = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(blob) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast((hashlib.sha256(blob).hexdigest(), blob))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of every text."""
    shared = _share(docs.sparkSession, path)

    def run(record_batches):
        tokenizer = _tokenizer(shared, pattern)
        for b in record_batches:
            texts = (t for (t,) in arrow_rows([b], "text"))
            ids = [i for part in batches(texts, len, _BATCH_BYTES) for i in tokenizer.encode(part)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), nonnull_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes: the bytes that the ids stand for."""
    shared = _share(tokens.sparkSession, path)

    def run(record_batches):
        tokenizer = _tokenizer(shared, pattern)
        for b in record_batches:
            out = [None if ids is None else tokenizer.decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "bytes"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, in one pass that keeps only digests."""
    shared = _share(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType

    def run(record_batches):
        tokenizer = _tokenizer(shared, pattern)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for b in record_batches:
            n, of_ids, of_bytes = [], [], []
            for part in batches((t for (t,) in arrow_rows([b], "text")), len, _BATCH_BYTES):
                for found in tokenizer.entries(part):
                    ids = ",".join([e[0] for e in found])
                    n.append(ids.count(",") + 1 if found else 0)
                    of_ids.append(digest(ids.encode()))
                    of_bytes.append(digest(b"".join([e[1] for e in found])))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), nonnull_text(text_col).alias("text"))
    schema = f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
