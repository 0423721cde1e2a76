"""Filter interaction audit: what each filter removes in every order of five filters.

A document's mask holds one bit for each filter that it fails. In an order of the filters it
leaves at the first one of its mask. All orders, sorted as words, have the ranks 0 to 119
(their Lehmer codes read as numbers), and the orders that begin with the same letters are one
interval of ranks. So the orders in which a mask leaves at step ``s`` are the intervals of
the beginnings of ``s`` letters whose last one is the first in the mask, and likewise for
the orders in which it fails a filter after it has left. Counts by part and mask are added at
the start of each interval and taken off behind its end; sums over the ranks then give the
counts of every order and step. What is added up is one number for each part, mask, step and
interval end, however many documents there are.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))

# The filters' bounds and the characters of filter D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, "#$%&*|"
_SPACES = " \t\n\x0b\x0c\r"


def lehmer_rank(letters: str, filters: str = FILTERS) -> int:
    """Rank, among all orders sorted as words, of the first one that begins with ``letters``."""
    left, rank = sorted(filters), 0
    for i, c in enumerate(letters):
        rank += left.index(c) * factorial(len(filters) - 1 - i)
        left.remove(c)
    return rank


def interval_ends(filters: str = FILTERS) -> list[tuple[int, int, int, int, int, int]]:
    """(mask, step, rank, filter, removed, redundant): changes of both counts at a rank, one document each.

    ``filter`` is the one applied at the step, as a place in ``filters``; a row for each interval
    end of each mask, ends at which nothing changes left out.
    """
    n, changes = len(filters), {}
    for step in range(1, n + 1):
        for letters in permutations(filters, step):
            begin = "".join(letters)
            low = lehmer_rank(begin, filters)
            high = low + factorial(n - step)
            at = filters.index(begin[-1])
            earlier = sum(1 << filters.index(c) for c in begin[:-1])
            for mask in range(1 << n):
                if mask >> at & 1:
                    what = 1 if mask & earlier else 0  # already gone, or removed here
                    for rank, sign in ((low, 1), (high, -1)):
                        changes.setdefault((mask, step, rank, at), [0, 0])[what] += sign
    return [(m, s, r, a, x, y) for (m, s, r, a), (x, y) in sorted(changes.items()) if x or y]


def checked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, own, same) of every row: ``own`` has the bits of filters A to D, equal texts share ``same``.

    A null text is empty; ``same`` is the text's SHA-256.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))
    spaced = F.translate("text", _SPACES, " " * len(_SPACES))
    doc = doc.withColumn("words", F.array_remove(F.split(spaced, " "), ""))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        words < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * words, 100 * capitals.cast("long") > MOST_CAPITALS * F.length("text"),
        F.length(F.translate("text", MARKS, "")) < F.length("text"),
    ]
    own = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return doc.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("same"))


def _flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) of labelled documents, one row each; any row of several may say so."""
    hit = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias({"quality": "good"}.get(c, c))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(hit("quality"), hit("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those among them with labels of good quality and of toxicity.

    Rows equal in doc_id, part and text become one with a number before anything is joined.
    Filter E then compares doc_ids of one text by its least doc_id for each part and labels, so
    a text that a third of all rows share is a few rows when they meet.
    """
    rows = checked(docs).groupBy("doc_id", "part", "own", "same").agg(F.count(F.lit(1)).alias("n"))
    # a null doc_id has no label and would only crowd one task
    named = rows.where("doc_id IS NOT NULL").join(_flags(labels), "doc_id", "left").na.fill(False, ["good", "toxic"])
    unnamed = rows.where("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    keys = ["same", "part", "own", "good", "toxic"]
    both = named.select(*keys, "doc_id", "n").unionAll(unnamed.select(*keys, "doc_id", "n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    met = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("same"))
    # rows that no smaller doc_id repeats: those of the least doc_id, and those without one
    clear = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = met.withColumn("first", first).withColumn("clear", clear)
    e = 1 << FILTERS.index("E")
    sides = F.array(F.struct(F.col("own").alias("mask"), F.col("clear").alias("m")), F.struct((F.col("own") + e).alias("mask"), (F.col("n") - F.col("clear")).alias("m")))
    each = split.select("part", "good", "toxic", F.inline(sides))
    when = lambda c: F.sum(F.when(F.col(c), F.col("m")).otherwise(0)).alias(c)
    return each.where("m > 0").groupBy("part", "mask").agg(F.sum("m").alias("n"), when("good"), when("toxic"))


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a fixed size, whatever the input


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order and step, zeros included. part: the language, an empty
    string where it is null. Filters of a whole text (null: empty): A under 100 words; B
    fewer than 80 distinct words in 100; C more than 10 capitals A to Z in 100 code points; D any of ``#$%&*|``;
    E a text that a smaller doc_id has. Rows of one doc_id don't repeat each other; a null doc_id is not
    smaller or larger than any and has no labels. A document with several label rows has
    what any of them says; null labels say nothing. Texts of any length are read whole, other columns
    are left out, and an empty table gives no rows; so does one of labels alone.
    """
    spark = docs.sparkSession
    # saved, so that the texts are read once: 32 rows a part
    counts = Scratch(spark, "audit").save(mask_counts(docs, labels), "counts")
    ends = _table(spark, interval_ends(), "mask int, step int, rank int, at int, r int, d int")
    names = [("".join(o), r) for r, o in enumerate(permutations(FILTERS))]
    places = [(r, s + 1, FILTERS.index(c), o) for o, r in names for s, c in enumerate(o)]
    steps = _table(spark, places, "rank int, step int, at int, filter_order string")
    # 1: difference arrays, changes of each count by part, step and rank
    product = lambda a, b, name: F.sum(F.col(a) * F.col(b)).alias(name)
    changes = counts.join(ends, "mask").groupBy("part", "step", "rank").agg(
        product("n", "r", "removed"), product("n", "d", "redundant"), product("good", "r", "good_lost"), product("toxic", "r", "toxic_lost")
    )
    # 2: what belongs to a part or filter in any order
    bit = lambda i: F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*[bit(i) for i in range(len(FILTERS))]).alias("unique"))
    dense = parts.select("part", "total", "unique", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    dense = dense.select("*", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank"))
    # 3: sums over the 120 ranks of each part and step, then over the steps and orders
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = ["removed", "redundant", "good_lost", "toxic_lost"]
    summed = dense.join(changes, ["part", "step", "rank"], "left").na.fill(0, sums).withColumns({c: F.sum(c).over(upto) for c in sums})
    placed = summed.join(steps, ["rank", "step"])
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    long = lambda c, name: c.cast("long").alias(name)
    return placed.select(
        "part", "filter_order", "step", long(F.col("total") - F.sum("removed").over(before), "kept"), *[long(F.col(c), c) for c in ("removed", "redundant")],
        long(F.get("unique", F.col("at")), "unique_fails"), *[long(F.col(c), c) for c in ("good_lost", "toxic_lost")],
        long(F.sum("removed").over(Window.partitionBy("part", "at")), "shapley"),
    )
