"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.staging import shared_dir, stage

__all__ = ["ASCII_SPACE", "WORD", "hash_sample", "held_out", "join_spread", "labelled_rows", "labelled_sample", "shared_dir", "stage", "with_broadcast_if_small"]

#: A word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = r"[\x20\x09-\x0D]"


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only where the counted rows stay within a stated bound."""
    return F.broadcast(df) if rows <= most else df


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], rows: str, hot: int = 100_000, most: int = 500_000) -> DataFrame:
    """Inner join with a staged table of one row a key, of which `rows` tells how many rows of `left` it has.

    Keys of more than `hot` rows don't go to one task: they are few, no more than
    rows of `left` over `hot`, and are broadcast while they stay below `most`.
    """
    heavy = right.where(F.col(rows) > hot)
    n = heavy.count()
    if not 0 < n <= most:
        return left.join(right, keys)
    light = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(right.where(F.col(rows) <= hot), keys)
    return light.unionByName(left.join(F.broadcast(heavy), keys))


def hash_sample(df: DataFrame, most: int, *keys: str, seed: int = 17) -> DataFrame:
    """The `most` rows of the smallest hash of their keys.

    A cut on the hash, from the number of rows, comes first, so that tasks don't
    each send `most` rows to be merged; it leaves half as many again.
    """
    rows = df.count()
    h = F.xxhash64(F.lit(seed), *map(F.col, keys))
    if rows > 2 * most:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 1.5 * (most + 100) / rows))
    return df.withColumn("_h", F.pmod(h, F.lit(1 << 40))).orderBy("_h", *keys).limit(most).drop("_h")


def labelled_sample(labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` labelled ids, those of the smallest hash: (doc_id, label), one row an id.

    Null ids or labels are left out; of several labels for one id the largest counts.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return hash_sample(ids, most, "doc_id")


def labelled_rows(rows: DataFrame, marked: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows (with doc_id) of the labelled ids, with their label.

    Where repeated ids make them more than `most`, a share of them by the hash of
    doc_id and `keys`, that many on average; equal rows stay or go together.
    """
    found = rows.join(F.broadcast(marked), "doc_id")
    n = rows.select("doc_id").join(F.broadcast(marked), "doc_id").count()
    return found if n <= most else found.where(F.pmod(F.xxhash64(F.lit(23), "doc_id", *keys), F.lit(1 << 40)) < int((1 << 40) * most / n))
