"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space has become one space.

* Every text gets a key of `key_bits` bits. The directory starts at depth 0. A bucket with more than `capacity` keys is
  split on its next key bit, and the directory doubles when a bucket's local depth passes the global one. `split_buckets`
  finds the buckets at which this ends; they follow from key counts alone, so the splits are one aggregation, not a loop.
* Texts are routed by the directory: key to slot, slot to bucket. First equal texts are merged within SALTS parts of the rows, so
  a group that holds a third of all rows reaches its owner as so many records at most. An owner task holds a range of
  buckets; it compares the whole texts of a key byte by byte, merges the equal ones and numbers the others as the key's chain.
* The index lies on shared files. Every row is looked up in it: its slot gives the bucket, its key the chain, and, in
  a chain of several texts, SHA-256 the link.

Cases: null text counts as empty. A null id is larger than any other. Rows that repeat one id belong to one
document: if it is the one that stays, all its rows do. Empty tables give empty results. Extra columns, whatever
their names, are not read by `classes` and are kept by `drop_copies`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, materialise, nonnull_text, whole_row

CAPACITY = 4096
SALTS = 16


def normalised(text: str | Column) -> Column:
    """Each run of white space as one space; single spaces are not touched, which gives the same."""
    return F.regexp_replace(nonnull_text(text), f"[{SPACES}]{{2,}}|[\\x09-\\x0D]", " ")


def _key(text: Column, key_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits)


def split_buckets(keys: DataFrame, key_bits: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory (slot, bucket, local_depth, n_keys) over distinct keys, and its global depth."""
    keys = keys.select("key").distinct()
    n = keys.count()
    deepest = min(key_bits, max(1, math.ceil(math.log2(max(1, n) / capacity)) + 6) if n > capacity else 1)
    while True:
        cells = keys.groupBy(F.shiftrightunsigned("key", key_bits - deepest).alias("cell")).agg(F.count("*").alias("n"))
        nodes = (
            cells.select(F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"), "cell", "n")
            .groupBy("depth", F.expr(f"shiftrightunsigned(cell, {deepest} - depth)").alias("prefix"))
            .agg(F.sum("n").alias("n"))
        )
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("n").alias("above"))
        buckets = (
            nodes.withColumn("up", F.shiftright("prefix", 1))
            .join(parents, ["depth", "up"], "left")
            .where(((F.col("n") <= capacity) | (F.col("depth") == deepest)) & (F.col("above").isNull() | (F.col("above") > capacity)))
            .select("depth", "prefix", "n")
        )
        buckets = materialise(buckets, "buckets")
        depth, fullest = buckets.agg(F.max("depth"), F.max("n")).first()
        if deepest == key_bits or (fullest or 0) <= capacity:
            break
        deepest = min(key_bits, deepest + 8)  # keys unlike a hash's: look further down
    depth = depth or 0
    slots = F.sequence(F.expr(f"shiftleft(prefix, {depth} - depth)"), F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1"))
    directory = buckets.select(F.explode(slots).alias("slot"), F.expr(f"shiftleft(prefix, {depth} - depth)").alias("bucket"), F.col("depth").alias("local_depth"), F.col("n").alias("n_keys"))
    return directory, depth


@dataclass
class ExactIndex:
    """entries: bucket, key, chain (texts of the key), link (place among them), sha, head (smallest id), size.

    One row a distinct text.
    """

    entries: DataFrame
    directory: DataFrame
    depth: int
    key_bits: int

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows, which have a key, with the bucket that the directory gives."""
        slot = F.shiftrightunsigned("key", self.key_bits - self.depth) if self.depth else F.lit(0).cast("long")
        return rows.withColumn("slot", slot).join(self.directory.select("slot", "bucket"), "slot").drop("slot")

    def look_up(self, rows: DataFrame) -> DataFrame:
        """rows (key, sha and others) with head and size of their text; both null where no other row has the text."""
        r, e = self.routed(rows).alias("r"), self.entries.where("size > 1").alias("e")
        same = (F.col("r.bucket") == F.col("e.bucket")) & (F.col("r.key") == F.col("e.key")) & ((F.col("e.chain") == 1) | (F.col("e.sha") == F.col("r.sha")))
        return r.join(e, same, "left").select(*[f"r.{c}" for c in rows.columns], "e.head", "e.size")


def _rows(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    text = normalised(text_col)
    return docs.select(F.col(id_col).alias("id"), _key(text, key_bits).alias("key"), F.sha2(text, 256).alias("sha"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key_bits: int = 62, capacity: int = CAPACITY, keys: DataFrame | None = None) -> ExactIndex:
    """Index every row of docs; key_bits below 62 only makes collisions likelier, for tests. keys: those of docs, if known."""
    text = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"), _key(text, key_bits).alias("key"))
    directory, depth = split_buckets(rows if keys is None else keys, key_bits, capacity)
    index = ExactIndex(rows, materialise(directory, "directory"), depth, key_bits)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    merged = rows.groupBy("key", "body", salt.alias("salt")).agg(F.min("id").alias("head"), F.count("*").alias("size"))
    owned = index.routed(merged).repartitionByRange("bucket", "key")
    texts = owned.groupBy("bucket", "key", "body").agg(F.min("head").alias("head"), F.sum("size").alias("size"))
    chain = W.partitionBy("bucket", "key")
    named = texts.select("bucket", "key", "head", "size", F.sha2("body", 256).alias("sha"))
    linked = named.withColumn("chain", F.count("*").over(chain)).withColumn("link", F.row_number().over(chain.orderBy("head", "sha")))
    index.entries = materialise(linked, "index")
    return index


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: ExactIndex | None = None, **options) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    key_bits = index.key_bits if index else options.get("key_bits", 62)
    rows = materialise(_rows(docs, id_col, text_col, key_bits), "keys")
    index = index or build_index(docs, id_col, text_col, keys=rows, **options)
    alone = F.col("size").isNull()
    return index.look_up(rows).select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("head")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("head"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose text no document with a smaller id has, with all their columns."""
    index = build_index(docs, id_col, text_col, **options)
    text = normalised(text_col)
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"), _key(text, index.key_bits).alias("key"), F.sha2(text, 256).alias("sha"))
    return index.look_up(rows).where(F.col("size").isNull() | F.col("id").eqNullSafe(F.col("head"))).select("row.*")
