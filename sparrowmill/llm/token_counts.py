"""Exact token counts of a piece vocabulary (BPE by scores, bytes for unknown characters) at every prefix of a text.

Merging by scores leaves the encoding of s[:i] unchanged up to any token border of s, and a row of tokens is the
encoding of its text if and only if every two neighbours are the encoding of theirs. So the encoding of s[:i] ends with
the one piece that fits the last piece before it: from the counts of the shorter prefixes follows the next. One pass over
a text stores the count at each of its prefixes, and questions about cuts and budgets are looked up; nothing is encoded
again. Whether two pieces fit is found by merging their letters once, and kept.

The marker of a space only begins pieces, so a text falls into units, each a run of markers with the word behind it, whose
counts add up; characters that no piece holds stand alone. Counts of short units come from a bounded table of the worker.

Pieces and scores are read on the driver from the path given, checked to be of bounded size and to need no
normalisation, and broadcast.

Cases: null texts count as empty and have no tokens; null ids and repeated rows are kept as they are; extra columns are
not read. Counts may fall as a prefix grows, since a longer word can be one piece; the longest prefix within a budget is
the longest of all that hold no more tokens. Questions about prefixes longer than the text get null.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nonnull_text
from .textkit import arrow_rows

MARK = "▁"
MOST_VOCABULARY_BYTES = 64 << 20
MOST_UNITS = 200_000
MOST_PAIRS = 1_000_000
MOST_STEMS = 50_000
STEM = 5  # units that begin alike share the counts of so many characters
SHORT = 48  # longer units are not kept
BLOCK = 1 << 16


def load_scores(path: str) -> dict[str, float]:
    """Scores of the pieces that texts can match. Models that normalise, or leave out bytes, are refused."""
    import sentencepiece

    with open(path, "rb") as f:
        blob = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(blob) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    model = sentencepiece.SentencePieceProcessor(model_proto=blob)
    ids = range(model.get_piece_size())
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    probe = "  a \t ﬁ é Ⅷ "
    plain = model.decode(model.encode(probe)) == probe and model.encode(" a", out_type=str) != model.encode("a", out_type=str)
    if not plain or sum(model.is_byte(i) for i in ids) != 256 or any(model.is_unused(i) for i in ids):
        raise ValueError(f"{path} normalises texts, lacks bytes or holds unused pieces")
    if any(MARK in p.lstrip(MARK) for p in scores):
        raise ValueError(f"{path} holds pieces that go on behind a space")
    return scores


class Counter:
    """Counts at every prefix, by scores of pieces.

    follow[piece] is the table of what may stand behind a piece: a piece that fits gives the table of its own, one that
    doesn't, or that is only the end of pieces, gives None. follow[""] belongs to the start and to unknown characters.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        letters = {c for p in scores for c in p}
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in letters and chr(c) != " ")
        self.cut = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|[{lone}]" if lone else "")).findall
        self.ends = {p[i:] for p in scores for i in range(len(p))}
        self.units: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.follow: dict[str, dict] = {}
        self.stems: dict[str, tuple[list, list, list]] = {}
        self.known = 0

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text: of all neighbours that make a piece, the leftmost of the highest score join first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _learn(self, before: str, piece: str) -> dict | None:
        """Whether `piece` can stand behind `before`, so that they stay two pieces: then its own table."""
        fits = piece in self.scores and self.merge(before + piece) == ([before, piece] if before else [piece])
        self.known += 1
        return self.follow.setdefault(piece, {}) if fits else None

    def unit(self, unit: str) -> list[int]:
        """The number of tokens of unit[:1], unit[:2], ..., unit."""
        if self.known > MOST_PAIRS:
            self._forget()
        start, stem = self.follow.setdefault("", {}), unit[:STEM]
        tables, last, count = map(list.copy, self.stems.get(stem, ([start], [""], [0])))
        for end in range(len(count), len(unit) + 1):
            begin = end
            while begin:
                begin -= 1
                piece, table = unit[begin:end], tables[begin]
                try:
                    found = table[piece]
                except KeyError:
                    if piece not in self.ends:
                        begin = 0
                        found = None
                    else:
                        found = table[piece] = self._learn(last[begin], piece)
                if found is not None:
                    tables.append(found)
                    last.append(piece)
                    count.append(count[begin] + 1)
                    break
            else:  # a character outside the vocabulary: a token a byte, and it joins nothing
                tables.append(start)
                last.append("")
                count.append(count[-1] + len(unit[end - 1].encode("utf-8")))
        if stem not in self.stems and len(stem) == STEM:
            if len(self.stems) >= MOST_STEMS:
                self.stems.clear()
            self.stems[stem] = tables[: STEM + 1], last[: STEM + 1], count[: STEM + 1]
        return count[1:]

    def units_of(self, text: str) -> list[bytes | list[int]]:
        """The counts inside each unit of a text; the first unit begins with a marker that is no character of the text."""
        if not text:
            return []
        out, kept = [], self.units
        for unit in self.cut(MARK + text.replace(" ", MARK)):
            counts = kept.get(unit)
            if counts is None:
                counts = self.unit(unit)
                if len(unit) <= SHORT and counts[-1] < 256 and max(counts) < 256:
                    if len(kept) >= MOST_UNITS:
                        kept.clear()
                    counts = kept[unit] = bytes(counts)
            out.append(counts)
        return out

    def total(self, units) -> int:
        return sum([u[-1] for u in units])

    def prefixes(self, units) -> array:
        """Counts at text[:1], text[:2], ..., text."""
        out, base = array("i"), 0
        for u in units:
            out.extend([base + c for c in u])
            base += u[-1]
        return out[1:]

    def within(self, units, budget: int) -> int:
        """Length of the longest prefix of at most `budget` tokens."""
        found, at, base = 0, -1, 0
        for u in units:
            if base > budget:
                break
            room = budget - base
            if u[-1] <= room:
                found = at + len(u)
            else:
                found = max([at + i + 1 for i, c in enumerate(u) if c <= room], default=found)
            at += len(u)
            base += u[-1]
        return max(found, 0)


_LOADED: dict[str, Counter] = {}


def _share(spark, path: str):
    scores = load_scores(path)
    digest = hashlib.sha256(repr(sorted(scores.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((digest, scores))


def _counter(shared) -> Counter:
    digest, scores = shared.value
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Counter(scores)
    return _LOADED[digest]


def count(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, limit_chars: the longest prefix (code points) of at most `limit` tokens."""
    shared = _share(docs.sparkSession, path)

    def run(record_batches):
        counter = _counter(shared)
        for b in record_batches:
            n_bytes, n, chars = [], [], []
            for (text,) in arrow_rows([b], "text"):
                units = counter.units_of(text)
                n.append(counter.total(units))
                n_bytes.append(len(text.encode("utf-8")))
                chars.append(len(text) if n[-1] <= limit else counter.within(units, limit))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(chars, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    rows = docs.select(F.col(id_col).alias("id"), nonnull_text(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def prefix_table(docs: DataFrame, path: str, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, block, counts: the tokens of text[:block * size + 1], text[:block * size + 2], ...; `block` counts a row at most.

    Texts without characters have one row without counts. Store it, and ask it with tokens_at and longest_within.
    """
    shared = _share(docs.sparkSession, path)

    def run(record_batches):
        counter = _counter(shared)
        for key, text in arrow_rows(record_batches, "id", "text"):
            counts = counter.prefixes(counter.units_of(text))
            for at in range(0, max(1, len(counts)), block):
                yield pa.RecordBatch.from_pylist([{"id": key, "block": at // block, "counts": counts[at : at + block].tolist()}], schema=wanted)

    rows = docs.select(F.col(id_col).alias("id"), nonnull_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    wanted = pa.schema([("id", to_arrow_type(kind)), ("block", pa.int32()), ("counts", pa.list_(pa.int32()))])
    return rows.mapInArrow(run, f"id {kind.simpleString()}, block int, counts array<int>").withColumnRenamed("id", id_col)


def tokens_at(table: DataFrame, questions: DataFrame, block: int = BLOCK, id_col: str = "doc_id") -> DataFrame:
    """questions (id, n_chars) with n_tokens of the text's first n_chars code points; null where the text is shorter."""
    at = questions.withColumn("block", F.floor((F.greatest("n_chars", F.lit(1)) - 1) / block).cast("int"))
    place = ((F.col("n_chars") - 1) % block).cast("int")
    n = F.when(F.col("n_chars") <= 0, F.lit(0)).otherwise(F.get("counts", place))
    return at.join(table, [id_col, "block"], "left").withColumn("n_tokens", n.cast("long")).select(*questions.columns, "n_tokens")


def longest_within(table: DataFrame, budgets: DataFrame, block: int = BLOCK, id_col: str = "doc_id") -> DataFrame:
    """budgets (id, budget) with n_chars, the length of the text's longest prefix of at most so many tokens."""
    fitting = F.array_max(F.transform("counts", lambda c, i: F.when(c <= F.col("budget"), F.col("block").cast("long") * block + i + 1)))
    found = budgets.distinct().join(table, id_col).groupBy(id_col, "budget").agg(F.coalesce(F.max(fitting), F.lit(0)).alias("n_chars"))
    return budgets.join(found, [id_col, "budget"], "left").select(*budgets.columns, "n_chars")
