"""Filter interaction audit: what every order of five filters keeps and loses.

Native expressions turn each document into a five-bit mask of the filters it
fails. Only the digest of a text travels, to find the smallest doc_id of equal
texts. The documents of a part then fall into 32 cells, one a mask, and whatever
an order of filters does follows from the cells alone: after the filters of a set
S the cells without a bit of S are left. So 32 counts a part answer all 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join, text_of

#: The filters' letters in the order of their bits, and what each removes.
LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"
BETWEEN_WORDS = "[\\x20\\x09-\\x0D]+"


def text_mask(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with __mask, the bits of the filters that a text fails by itself (A to D), and __digest of the text."""
    text = text_of(docs[text_col])
    words = docs.withColumn("__text", text).withColumn("__words", F.array_remove(F.split("__text", BETWEEN_WORDS), ""))
    n, distinct = F.size("__words"), F.size(F.array_distinct("__words"))
    capitals = F.length(F.regexp_replace("__text", "[^A-Z]+", ""))
    fails = [
        n < LEAST_WORDS,
        F.lit(100).cast("long") * distinct < F.lit(LEAST_DISTINCT_PERCENT).cast("long") * n,
        F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITALS_PERCENT).cast("long") * F.length("__text"),
        F.col("__text").rlike(SYMBOLS),
    ]
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))
    return words.select("*", mask.alias("__mask"), F.unhex(F.sha2("__text", 256)).alias("__digest")).drop("__text", "__words")


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, bit 0 for A to bit 4 for E.

    A null part counts as the empty string. A text of a null id is a copy of nothing,
    nor is it the one that others copy. Rows that repeat both id and text are no
    copies of each other, as no id is smaller. Where labels of one id contradict each
    other the greatest counts; rows without a label are neither good nor toxic.
    """
    own = docs.select(docs[id_col].alias("i"), docs[text_col].alias("x"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))
    rows = materialise(text_mask(own, "x").select("i", "part", F.col("__mask").alias("m"), F.col("__digest").alias("h")))
    groups = rows.where("i is not null").groupBy("h").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = spread_join(rows, materialise(groups), "h", "c", rows.count())
    marks = labels.groupBy(labels["doc_id"].alias("i")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    copy = F.when(F.col("i") > F.col("first"), F.lit(1 << 4)).otherwise(F.lit(0))
    seen = rows.select("i", "part", (F.col("m") + copy).alias("mask")).join(marks, "i", "left")
    return seen.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("good", F.lit(False))).alias("good"), F.count_if(F.coalesce("toxic", F.lit(False))).alias("toxic"))


def _orders() -> Column:
    """Every step of every order of the filters: (filter_order, step, own bit, bits of the steps before)."""
    steps = []
    for order in permutations(LETTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            steps.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return F.expr(f"array({', '.join(steps)})")


def audit_orders(cells: DataFrame) -> DataFrame:
    """600 rows for each part of ``failure_cells``: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    kept(S) sums the cells without a bit of S; one array of 32 such sums a part, for
    all, good and toxic documents, is all that the orders look up.
    """
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32

    def kept(of: str) -> Column:
        left = lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(s) == 0, c[of]).otherwise(F.lit(0)))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << len(LETTERS)) - 1)), left)

    def over(value) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + value(c))

    # a document that fails k filters is removed by each of them in 120 / k of the orders
    shares = F.array(*[F.lit(0 if k == 0 else 120 // k) for k in range(len(LETTERS) + 1)])
    shapley = lambda bit: over(lambda c: F.when(c["mask"].bitwiseAND(bit) != 0, c["n"] * F.element_at(shares, F.bit_count(c["mask"]) + 1)).otherwise(F.lit(0)))
    alone = lambda bit: over(lambda c: F.when(c["mask"] == bit, c["n"]).otherwise(F.lit(0)))
    each = lambda of: F.array(*[of(F.lit(1 << k)) for k in range(len(LETTERS))])
    parts = held.select("part", kept("n").alias("k"), kept("good").alias("g"), kept("toxic").alias("t"), each(shapley).alias("shapley"), each(alone).alias("alone"))
    steps = parts.withColumn("s", F.explode(_orders())).select("*", "s.*")
    at = lambda of, s: F.element_at(of, s + 1)
    before, after = F.col("before"), F.col("before") + F.col("bit")
    which = F.bit_count(F.col("bit") - 1) + 1
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("k", after).alias("kept"),
        (at("k", before) - at("k", after)).alias("removed"),
        (at("k", F.lit(0)) - at("k", F.col("bit")) - at("k", before) + at("k", after)).alias("redundant"),
        F.element_at("alone", which).alias("unique_fails"),
        (at("g", before) - at("g", after)).alias("good_lost"),
        (at("t", before) - at("t", after)).alias("toxic_lost"),
        F.element_at("shapley", which).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of ``docs``: one row for each part, order of the five filters and step, zeros included.

    A null or empty text has no words and fails A only (and E as a copy of other
    empty ones). Very long texts are read whole. Ids that repeat count once a row; for
    null ids, ties and labels see failure_cells. Columns of other names, also such as
    are used in here, are not read. An empty table has no parts and gives no rows.
    """
    return audit_orders(failure_cells(docs, labels, id_col, text_col, part_col))
