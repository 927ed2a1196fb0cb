"""Mixing sources to target weights. DataFrame functions only.

Documents get a hash-random key and are range-sorted by it within their source. Prefix sums of sizes are
distributed: the key range is cut into coarse bins of fine bins, sums are taken of rows, of fine bins and of coarse
bins, and each level's running sum starts where the level above says. No source is ever in one task. A source is
cut at its exact budget: the document there gives only the words that remain. Where the budget is beyond the source,
whole epochs are taken first.

Cases: null text has size 0, a null source is a source of its own and comes last, a null id is a document like any
other, repeated rows are documents of their own (equal ones get shares in any order), sources without words get
target 0, and empty tables give empty results. Extra columns are ignored by `plan_mix` and kept by `mix_rows`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, materialise, nonnull_text, whole_row

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
BIN_ROWS = 1000


def n_words(text: str) -> Column:
    return F.regexp_count(nonnull_text(text), F.lit(f"[^{SPACES}]+")).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """src, source_size, target: targets by weight, none above `most` times its source, the excess reshared by weight.

    The shares end where every source has min(cap, level * weight); with sources in order of cap / weight the level
    is that of the first source whose cap it does not pass.
    """
    by_source = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy("src")) - 1  # a row a source, not a row a document
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    caps = by_source.select("src", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    filled = W.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    levels = caps.select(
        "*",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))).alias("left_over"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))).alias("open_weight"),
    ).withColumn("level", F.when(F.col("left_over") / F.col("open_weight") * F.col("weight") <= F.col("cap"), F.col("left_over") / F.col("open_weight")))
    first = F.min(F.when(F.col("level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(everything)["level"]
    return levels.select("src", "source_size", F.when(first.isNull(), F.col("cap")).otherwise(F.least("cap", first * F.col("weight"))).alias("target"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, payload: list) -> DataFrame:
    src = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}")))
    return docs.select(*payload, src.alias("src"), n_words(text_col).alias("size"), key.alias("key"), F.col(id_col).alias("id"))


def _binned(df: DataFrame, coarse: int) -> DataFrame:
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(coarse * coarse)
    fine = F.shiftright(at, 32)
    return df.withColumn("fine", fine).withColumn("coarse", (F.col("fine") / F.lit(coarse)).cast("long"))


def _shares(docs, id_col, text_col, source_col, seed, payload, weights, share, most) -> DataFrame:
    """payload, size, source_size, target, epochs (whole ones), part (words of the last, cut epoch)."""
    sized = materialise(_placed(docs, id_col, text_col, source_col, seed, []), "sizes")
    coarse = max(1, math.isqrt(sized.count() // BIN_ROWS) + 1)
    fine = _binned(sized, coarse).groupBy("src", "coarse", "fine").agg(F.sum("size").alias("n"))
    fine = materialise(fine, "bins")
    above = fine.groupBy("src", "coarse").agg(F.sum("n").alias("n"))
    before = lambda *by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    above = above.select("src", "coarse", F.coalesce(F.sum("n").over(before("src", order="coarse")), F.lit(0)).alias("base"))
    starts = (
        fine.withColumn("inner", F.coalesce(F.sum("n").over(before("src", "coarse", order="fine")), F.lit(0)))
        .join(above, ["src", "coarse"])
        .join(source_targets(fine.select("src", F.col("n").alias("size")), weights, share, most), "src")
        .select("src", "coarse", "fine", (F.col("base") + F.col("inner")).alias("start"), "source_size", "target")
    )
    rows = _binned(_placed(docs, id_col, text_col, source_col, seed, payload), coarse) if payload else _binned(sized, coarse)
    order = W.partitionBy("src", "coarse", "fine").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(starts, ["src", "coarse", "fine"]).withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    return placed.withColumn("epochs", epochs).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begin"))).cast("long"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 1, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per document: id, size, source_size, target of its source, taken (words the mix takes)."""
    shares = _shares(docs, id_col, text_col, source_col, seed, [], weights, share, most)
    return shares.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def first_words(text: str | Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(nonnull_text(text), f"(?<=[^{SPACES}])(?=[{SPACES}])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 1, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """The mixed rows: a document as often as it is taken, the one at a source's budget cut to the words that remain."""
    row = whole_row(docs).alias("row")
    shares = _shares(docs, id_col, text_col, source_col, seed, [row], weights, share, most)
    whole = (F.col("epochs") + (F.col("part") == F.col("size")).cast("long") * (F.col("part") > 0).cast("long")).cast("int")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.concat(F.array_repeat(F.lit(False), whole), F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = shares.select("row", "part", F.explode(copies).alias("is_cut"))
    texts = F.when(F.col("is_cut"), first_words(F.col("row")[text_col], F.col("part"))).otherwise(F.col("row")[text_col])
    return rows.select(*[texts.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
