"""Exact deduplication by progressive refinement.

Documents are told apart by the cheapest property first: the length of the
normalised text, then a hash of its first characters, then a hash of all of it.
Only documents that share their length with another have their prefix hashed,
and only those that share both are hashed in full (the digest of a caller who
wants one of every text aside).

No text is shuffled. Which lengths, and then which (length, prefix) groups,
survive goes back to the next scan as a bitmap of fixed size; when it fills up at
large scale it lets more documents through, never fewer. Everything is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join, text_of

#: Bits in a bitmap of survivors: 65,536 rows of one long each.
BITMAP_BITS = 22
PREFIX_CHARS = 64


def normalised(col: str | Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed and return becomes one space."""
    return F.regexp_replace(text_of(col), "[\\x20\\x09-\\x0D]+", " ")


def _prefix(text: str) -> Column:
    return F.xxhash64(F.substring(text, 1, PREFIX_CHARS))


def _slot(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << BITMAP_BITS))


def _bit(slot: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")


def _alive(rows: DataFrame, survivors: DataFrame, cols: list[str], out: str) -> DataFrame:
    """``rows`` with a flag ``out``: whether the bitmap of the survivors has their slot. Its at most 65,536 rows are broadcast."""
    bits = survivors.select(_slot(*map(F.col, cols)).alias("s")).groupBy(F.expr("s >> 6").alias("w")).agg(F.bit_or(_bit("s")).alias("b"))
    some = rows.withColumn("s", _slot(*map(F.col, cols))).withColumn("w", F.expr("s >> 6")).join(F.broadcast(bits), "w", "left")
    return some.withColumn(out, F.coalesce(F.col("b").bitwiseAND(_bit("s")) != 0, F.lit(False))).drop("s", "w", "b")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept and, with ``digest``, text_sha256.

    Of equal normalised texts the smallest id stays. A null text is empty; empty
    texts are equal to each other. Rows that repeat an id with the same text all
    count in group_size and are all kept. A null id is never kept unless its
    whole group has null ids, when keep_id is null. Other columns, whatever
    their names, are not read. An empty table gives an empty table.
    """
    return _decided(docs, id_col, text_col, digest).drop("__h")


def _decided(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """As exact_dedup, and __h: the digest of the normalised text where another text may equal it."""
    narrow = docs.select(F.col(id_col).alias("i"), normalised(text_col).alias("t")).select("i", "t", F.length("t").cast("long").alias("n"))
    lengths = narrow.groupBy("n").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    some = _alive(narrow, lengths, ["n"], "same_length").where("same_length").withColumn("p", _prefix("t"))
    prefixes = some.groupBy("n", "p").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    seen = _alive(narrow.withColumn("p", _prefix("t")), prefixes, ["n", "p"], "alive")
    cols = [F.col("i"), F.when(F.col("alive"), F.sha2("t", 256)).alias("h")]
    rows = materialise(seen.select(*cols, *([F.sha2("t", 256).alias("d")] if digest else [])))
    groups = rows.where("h is not null").groupBy("h").agg(F.min("i").alias("k"), F.count(F.lit(1)).alias("c")).where("c > 1")
    out = spread_join(rows, materialise(groups), "h", "c", rows.count())
    keep = F.when(F.col("c").isNull(), F.col("i")).otherwise(F.col("k"))
    return out.select(
        F.col("i").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("c", F.lit(1).cast("long")).alias("group_size"),
        F.col("i").eqNullSafe(keep).alias("kept"),
        F.col("h").alias("__h"),
        *([F.col("d").alias("text_sha256")] if digest else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Decisions hold for an id and a text together: a row that repeats an id with
    another text stands or falls by its own text, and rows without an id go only
    where their text has a row with one. Rows that repeat both id and text all stay.
    """
    gone = _decided(docs, id_col, text_col, False).where("__h is not null and not kept").select(F.col(id_col).alias("__i"), "__h").distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__i"]) & (F.sha2(normalised(docs[text_col]), 256) == gone["__h"]), "left_anti")
