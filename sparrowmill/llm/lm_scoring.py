"""LM scoring by cross-entropy difference.

Two word bigram models, of a target corpus and of the whole collection, share one vocabulary (every word of the
collection, or with `size` the most frequent ones and one unknown word), one order and one smoothing. Every token gets
the loss of each model, -ln P(word | previous word); a document's score is the mean of the differences target -
background, so low scores are target-like. Words are runs of letters, digits and non-ASCII characters, ASCII in lower case.

All counts are taken over all documents and the models grow with them, so no table goes through the driver. Documents are
dealt to chunks by id. A chunk sends its distinct bigrams and words, sorted by their 64-bit hashes, to the buckets of
hash ranges; a bucket adds up what all chunks sent and answers each in the order it asked; the chunk, counted again, scores
its documents from the answers. A frequent bigram is sent once a chunk however often it occurs. More than FAN chunks exchange
in levels: FAN chunks meet in FAN wide ranges, whose sums go on to narrower ranges that more chunks share, and answers come
back the same way. So no sender has more than FAN receivers at a level, and messages grow with chunks, not with their square. One level
serves some 68 GB of text, two 560 TB.

P(w | h) = (c(h, w) + mu * P(w)) / (c(h) + mu),  P(w) = (c(w) + 1) / (N + V).

Cases: null and empty texts, and texts without words, have 0 tokens and null losses. Repeated rows count as often as
they stand and each is scored. Null ids are never targets. With no target rows the target model is the uniform one.
Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, nonnull_text
from .textkit import U, mix, pack
from .textkit import batches as batched
from .textkit import words as hashed

MU = 50.0
FAN = 8192  # a chunk's messages are then some 1 KB each; every further level moves the counts once more
_CHUNK_BYTES = 8 << 20
_BATCH_BYTES = 2 << 20
_START, _UNKNOWN = U(0), U(1)  # hashes of no word
_ODD = U(0x9E3779B97F4A7C15)
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_COUNTS = ("pairs_n", "pairs_t", "words_n", "words_t", "before_n", "before_t")


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_CLEAN).split()


def _counted(batches):
    """word, n of a task; flushed when the table grows large."""
    table: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.binary()), pa.array(list(table.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for text in b.column("text").to_pylist():
            table.update(tokens(text))
            if len(table) > 500_000:
                yield flush()
                table.clear()
    yield flush()


def vocabulary(docs: DataFrame, text_col: str, size: int) -> list[bytes]:
    """The size - 1 most frequent words (ties by the word); all others are one unknown word."""
    rows = docs.select(nonnull_text(text_col).alias("text"))
    counts = rows.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(size - 1).collect()]


def losses(counts: np.ndarray, mu: float = MU) -> np.ndarray:
    """-ln P(w | h) of a (V + 1) x V table of counts."""
    v = counts.shape[1]
    c_w = counts.sum(0)
    p_w = (c_w + 1.0) / (c_w.sum() + v)
    out = counts + mu * p_w[None, :]
    out /= counts.sum(1, keepdims=True) + mu
    np.log(out, out=out)
    return np.negative(out, out=out)


def _put(a: np.ndarray) -> bytes:
    """Numbers from 0 as byte planes, without the planes that are all 0."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _got(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<u8").reshape(-1)


class _Chunk:
    """The distinct words and bigrams of texts, sorted by hash, and where each token finds its own."""

    def __init__(self, texts: list[str], kept: np.ndarray | None):
        owners, hashes, first = [], [], 0
        for held in batched([t.encode("utf-8").translate(_CLEAN) for t in texts], len, _BATCH_BYTES):
            owner, h, _ = hashed(*pack(held))
            owners.append(owner + first)
            hashes.append(h)
            first += len(held)
        self.owner = np.concatenate([np.zeros(0, np.int64), *owners])
        h = np.concatenate([np.zeros(0, U), *hashes])
        if kept is not None:
            h = np.where(np.isin(h, kept), h, _UNKNOWN)
        before = np.concatenate([[_START], h[:-1]])[: len(h)]
        before[np.flatnonzero(np.diff(self.owner, prepend=-1))] = _START
        self.words, place = np.unique(np.append(h, _START), return_inverse=True)
        self.word, self.before = place[:-1], np.searchsorted(self.words, before)
        self.pairs, at, self.pair = np.unique(mix(mix(before + _ODD) + h * _ODD), return_index=True, return_inverse=True)
        self.pair_word, self.pair_before = self.word[at], self.before[at]

    def counts(self, target: np.ndarray) -> dict[str, np.ndarray]:
        of_target = target[self.owner]
        out = {}
        for name, place, n in (("pairs", self.pair, len(self.pairs)), ("words", self.word, len(self.words)), ("before", self.before, len(self.words))):
            out[f"{name}_n"] = np.bincount(place, minlength=n)
            out[f"{name}_t"] = np.bincount(place[of_target], minlength=n)
        return out


def _levels(chunks: int, fan: int) -> list[int]:
    """How many hash ranges each level of the exchange has; the last one's are the buckets, which see all chunks."""
    buckets, depth = (chunks + 1) // 2, 1
    while fan**depth < chunks:
        depth += 1
    return [min(fan**level, buckets) for level in range(1, depth)] + [buckets]


def _place(h: np.ndarray, ranges: int, buckets: int) -> np.ndarray:
    """The range of each hash, in whole buckets, so that ranges of a level lie within those of the level before."""
    return ((h >> U(32)) * U(buckets) >> U(32)) * U(ranges) // U(buckets)


_SETS = (("pairs", _COUNTS[:2]), ("words", _COUNTS[2:]))
_ASKED = [("chunk", pa.int32()), ("origin", pa.int32()), ("bucket", pa.int32()), ("pairs", pa.binary()), ("words", pa.binary()), *[(k, pa.binary()) for k in _COUNTS]]
_ASKED_SQL = "chunk int, origin int, bucket int, pairs binary, words binary, " + ", ".join(f"{k} binary" for k in _COUNTS)
_PASSED_SQL = "chunk int, origin int, bucket int, " + ", ".join(f"{k} binary" for k in _COUNTS)
_ANSWERED_SQL = _PASSED_SQL + ", distinct long, n long, n_target long"


def _messages(sender: int, origin: int, hashes: dict[str, np.ndarray], counts: dict[str, np.ndarray], ranges: int, buckets: int) -> pa.Table:
    """A sender's sorted hashes and their counts, cut into the ranges of the level above."""
    places = {k: _place(h, ranges, buckets) for k, h in hashes.items()}
    rows = []
    for b in np.union1d(places["pairs"], places["words"]):
        cut = {k: slice(*np.searchsorted(x, [b, b + U(1)])) for k, x in places.items()}
        put = [_put(np.diff(hashes[k][cut[k]], prepend=U(0))) for k in hashes]
        rows.append((sender, origin, int(b), *put, *[_put(counts[name][cut[k]]) for k, names in _SETS for name in names]))
    return pa.table([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), _ASKED, strict=True)], [k for k, _ in _ASKED])


def _asked(ranges: int, buckets: int, kept):
    def run(docs: pa.Table, ids: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _ASKED})
        hit = set(ids.column("id").to_pylist())
        c = _Chunk(docs.column("text").to_pylist(), kept and kept.value)
        counts = c.counts(np.array([i in hit for i in docs.column("id").to_pylist()], bool))
        return _messages(docs.column("chunk")[0].as_py(), 0, {"pairs": c.pairs, "words": c.words}, counts, ranges, buckets)

    return run


def _united(asked: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of messages, where each hash of each message stands among them, where messages end."""
    hashes = [np.cumsum(_got(b), dtype=U) for b in asked.column(key).to_pylist()]
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    return distinct, place, np.cumsum([len(h) for h in hashes])[:-1]


def _sums(asked: pa.Table, name: str, place: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(place, np.concatenate([_got(b) for b in asked.column(name).to_pylist()]), n).astype(np.int64)


def _forwarded(fan: int, ranges: int, buckets: int):
    """A range of one level adds up what its senders sent, and sends the sums to the ranges of the next."""

    def run(asked: pa.Table) -> pa.Table:
        hashes, counts = {}, {}
        for key, names in _SETS:
            hashes[key], place, _ = _united(asked, key)
            counts |= {name: _sums(asked, name, place, len(hashes[key])) for name in names}
        return _messages(asked.column("chunk")[0].as_py() // fan, asked.column("bucket")[0].as_py(), hashes, counts, ranges, buckets)

    return run


def _addressed(asked: pa.Table, columns: dict[str, list]) -> pa.Table:
    columns = {k: asked.column(k) for k in ("chunk", "origin", "bucket")} | columns
    kinds = [pa.int64() if k in ("distinct", "n", "n_target") else pa.int32() if k in ("chunk", "origin", "bucket") else pa.binary() for k in columns]
    return pa.table([x.cast(t) if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for x, t in zip(columns.values(), kinds, strict=True)], list(columns))


def _answered(asked: pa.Table) -> pa.Table:
    """The sums of a bucket for each sender that asked; its own totals stand in one row."""
    columns: dict[str, list] = {}
    totals = [0, 0, 0]
    for key, names in _SETS:
        distinct, place, ends = _united(asked, key)
        for name in names:
            sums = _sums(asked, name, place, len(distinct))
            columns[name] = [_put(x) for x in np.split(sums[place], ends)]
            if name == "words_n":
                totals[0], totals[1] = int((sums > 0).sum()), int(sums.sum())
            elif name == "words_t":
                totals[2] = int(sums.sum())
    for name, total in zip(("distinct", "n", "n_target"), totals, strict=True):
        columns[name] = [total] + [0] * (asked.num_rows - 1)
    return _addressed(asked, columns)


def _passed(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers that a range got, for each sender in the order that it asked."""
    answers = answers.sort_by("bucket")
    columns: dict[str, list] = {}
    for key, names in _SETS:
        _, place, ends = _united(asked, key)
        for name in names:
            got = np.concatenate([_got(b) for b in answers.column(name).to_pylist()])
            columns[name] = [_put(x) for x in np.split(got[place], ends)]
    return _addressed(asked, columns)


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int | None = None, mu: float = MU, fan: int = FAN) -> DataFrame:
    """id, n_tokens, target_loss, background_loss, score for every row of docs; targets: one column of ids.

    size: only so many words, the unknown one included; None: all words. fan: senders and receivers of a range of hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), nonnull_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    chunks = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / _CHUNK_BYTES))
    buckets = (chunks + 1) // 2
    kept = None
    if size is not None:
        words = vocabulary(docs, text_col, size)
        kept = docs.sparkSession.sparkContext.broadcast(hashed(*pack(words))[1])
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int").alias("chunk")
    dealt = rows.select(deal(F.coalesce(F.col("id").cast("string"), F.col("text"))), "id", "text").groupBy("chunk")
    ids = targets.select(F.col(targets.columns[0]).cast(kind).alias("id")).where("id is not null").distinct()
    levels = _levels(chunks, fan)
    asks = [dealt.cogroup(ids.select(deal(F.col("id").cast("string")), "id").groupBy("chunk")).applyInArrow(_asked(levels[0], buckets, kept), _ASKED_SQL)]
    group = F.floor(F.col("chunk") / fan).cast("int")
    for ranges in levels[1:]:
        asks[-1] = materialise(asks[-1], "asked")
        asks.append(asks[-1].groupBy(group, "bucket").applyInArrow(_forwarded(fan, ranges, buckets), _ASKED_SQL))
    answers = materialise(asks.pop().groupBy("bucket").applyInArrow(_answered, _ANSWERED_SQL), "answers")
    totals = answers.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("distinct", "n", "n_target")]).first()
    while asks:
        back = answers.select("chunk", "origin", "bucket", *_COUNTS).groupBy("chunk", "origin")
        answers = materialise(asks.pop().groupBy(group, "bucket").cogroup(back).applyInArrow(_passed, _PASSED_SQL), "answers")
    v = totals.distinct + 1 if size is None else len(words) + 1

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(docs.column("text").to_pylist(), kept and kept.value)
        answers = answers.sort_by("bucket")
        got = {k: np.concatenate([np.zeros(0, U), *[_got(b) for b in answers.column(k).to_pylist()]]).astype(np.float64) for k in _COUNTS}
        n = np.bincount(c.owner, minlength=docs.num_rows)
        means = []
        for k, total in (("t", totals.n_target), ("n", totals.n)):
            p_w = (got[f"words_{k}"][c.pair_word] + 1.0) / (total + v)
            loss = -np.log((got[f"pairs_{k}"] + mu * p_w) / (got[f"before_{k}"][c.pair_before] + mu))
            means.append(np.bincount(c.owner, loss[c.pair], docs.num_rows) / np.maximum(n, 1))
        t, g = means
        return pa.table([docs.column("id"), pa.array(n, pa.int64()), *[pa.array(x, pa.float64(), mask=n == 0) for x in (t, g, t - g)]], ["id", "n_tokens", "target_loss", "background_loss", "score"])

    schema = f"id {kind.simpleString()}, n_tokens long, target_loss double, background_loss double, score double"
    return dealt.cogroup(answers.select("chunk", "bucket", *_COUNTS).groupBy("chunk")).applyInArrow(run, schema).withColumnRenamed("id", id_col)


def good_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that every label calls good and none toxic."""
    return labels.groupBy(id_col).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select(id_col)
