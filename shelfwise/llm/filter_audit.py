"""What each filter of a chain removes, in every order, from one table of coalition removals.

A document's failures are a bit mask. For a set S of filters, removals(S) counts the documents that fail any
filter of S; with n filters there are 2^n such counts a part, all from one count of masks. A step of an order is
a difference of two of them, and so are the documents that fail one filter alone. Shapley values are the solution
of the kernel-weighted least squares problem whose values add up to removals(all): its normal equations are solved
in rational numbers, once, for unit vectors of removals, so every value is an exact whole combination of counts.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialized

NAMES = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def shapley_weights(n: int) -> list[list[int]]:
    """n x 2^n whole numbers w: filter i's value, summed over all n! orders, is the sum of w[i][S] * removals(S)."""
    full, size = (1 << n) - 1, 1 << n
    if n == 1:
        return [[0, 1]]
    kernel = [Fraction(0)] * size
    for s in range(1, full):
        k = s.bit_count()
        kernel[s] = Fraction(n - 1, comb(n, k) * k * (n - k))
    member = [[s >> i & 1 for s in range(size)] for i in range(n)]
    # Rows: one normal equation a filter, then the efficiency constraint; columns: values, multiplier, removals.
    rows = [
        [sum((kernel[s] for s in range(size) if member[i][s] and member[j][s]), Fraction(0)) for j in range(n)]
        + [Fraction(1)]
        + [kernel[s] * member[i][s] for s in range(size)]
        for i in range(n)
    ]
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(s == full) for s in range(size)])
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    values = [[x * factorial(n) for x in row[n + 1 :]] for row in rows[:n]]
    if any(x.denominator != 1 for row in values for x in row):
        raise ArithmeticError("values summed over all orders are whole numbers")
    return [[int(x) for x in row] for row in values]


def failures(docs: DataFrame, min_words: int = 200) -> DataFrame:
    """doc_id, part (source, null: empty), digest of the text, mask of the filters A to D that the text fails.

    A: under min_words words; B: under half of the words distinct; C: over one in fifty code points in A-Z;
    D: a character of `#$%&*|`. A null text counts as empty: it fails A alone. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        text.alias("body"),
        F.array_remove(F.split(text, _SPACE), "").alias("words"),
    )
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("body", "[^A-Z]+", ""))
    failed = [n < min_words, 100 * different < 50 * n, 100 * capitals > 2 * F.length("body"), F.col("body").rlike(r"[#$%&*|]")]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.encode("body", "utf-8"), 256)).alias("digest"), mask.alias("mask"))


def with_copies(failed: DataFrame, bit: int) -> DataFrame:
    """Adds `bit` to the mask of documents whose text a smaller doc_id bears, in any part, removed or not.

    Rows that repeat the smallest id don't fail; a null id is neither smaller nor larger than another.
    """
    first = failed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    named = failed.filter("doc_id is not null").join(first.withColumn("is_first", F.lit(True)), ["digest", "doc_id"], "left")
    marked = named.withColumn("mask", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(bit)).drop("is_first")
    return marked.unionByName(failed.filter("doc_id is null").select(*marked.columns))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good (quality is 1) and toxic (toxic is 1), false without a label; of several labels any counts."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    no = F.lit(False)
    named = failed.filter("doc_id is not null").join(known, "doc_id", "left")
    named = named.select(*failed.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return named.unionByName(failed.filter("doc_id is null").select("*", no.alias("good"), no.alias("toxic")))


def coalitions(marked: DataFrame, n: int) -> DataFrame:
    """part, total, and arrays removed, good, toxic of 2^n counts: place S + 1 has the documents that fail any of S.

    Masks are counted first, with partial counts before the shuffle, so a part of any size is a few rows.
    """
    size = 1 << n
    masks = marked.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")
    )

    def hit(count: str) -> Column:
        any_of = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(count)).otherwise(F.lit(0))) for s in range(size)]
        return F.array(*any_of)

    return masks.groupBy("part").agg(
        F.sum("n").alias("total"), hit("n").alias("removed"), hit("n_good").alias("good"), hit("n_toxic").alias("toxic")
    )


def steps(table: DataFrame, names: str) -> DataFrame:
    """One row a part, order of the filters and step, from the coalition table of `coalitions`."""
    n = len(names)
    full = (1 << n) - 1
    values = [
        sum((F.lit(w) * F.element_at("removed", s + 1) for s, w in enumerate(row) if w), F.lit(0)).cast("long")
        for row in shapley_weights(n)
    ]
    orders = F.lit(",".join(map("".join, permutations(names))))
    rows = (
        table.withColumn("values", F.array(*values))
        .withColumn("filter_order", F.explode(F.split(orders, ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    )

    def mask_of(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0))

    rows = rows.withColumn("before", mask_of(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    rows = rows.withColumn("own", mask_of(F.substring("filter_order", F.col("step"), F.lit(1))))

    def at(column: str, mask: Column) -> Column:
        return F.element_at(column, mask + 1)

    before, own = F.col("before"), F.col("own")
    after = before + own
    removed = at("removed", after) - at("removed", before)
    place = F.length(F.bin(own))  # the bit's place, from 1
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("removed", after)).alias("kept"),
        removed.alias("removed"),
        (at("removed", own) - removed).alias("redundant"),
        (at("removed", F.lit(full)) - at("removed", F.lit(full) - own)).alias("unique_fails"),
        (at("good", after) - at("good", before)).alias("good_lost"),
        (at("toxic", after) - at("toxic", before)).alias("toxic_lost"),
        F.element_at("values", place).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters A to D are those of `failures`, E is a copy of a smaller doc_id's text. Null and repeated ids keep their
    rows (see `with_copies`); a null source is the part of the empty string; no documents give no rows. Texts are
    read once: what follows uses a row of some 60 bytes a document, written to the shared folder.
    """
    failed = materialized(failures(docs), "filter-failures")
    marked = with_labels(with_copies(failed, 1 << (len(NAMES) - 1)), labels)
    return steps(coalitions(marked, len(NAMES)), NAMES)
