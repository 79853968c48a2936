"""Document fingerprints of closed syncmers, in DataFrame operations only.

A document is a row of words. Of its k-word windows those are chosen whose smallest s-word window (by
hash) stands at the start or the end. Whether a window is chosen depends on its own words alone, not on
what surrounds it, so an edit moves only the anchors that touch it, and the same passage has the same
anchors in every document, at the same distances from each other. Scripts without spaces are rows of letters.
The fingerprint of a short text has anchors of its characters besides, so that an edit leaves some of them; they
bear a sign, and two texts are compared in the kinds of anchors that both have, so nothing hangs on the border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import shuffle_partitions

K, S = 5, 2
SHORT = 128  # characters; shorter texts have anchors of characters too
_UNSPACED = r"[\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}]"


def words(text: Column) -> Column:
    """Runs of characters between white space; letters of scripts without spaces, and of runs over 32, one by one."""
    text = F.coalesce(text, F.lit(""))
    spaced = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    apart = F.filter(F.split(F.regexp_replace(text, f"({_UNSPACED})", " $1 "), r"\s+"), lambda w: w != "")
    single = F.flatten(F.transform(apart, lambda w: F.when(F.length(w) > 32, F.split(w, "")).otherwise(F.array(w))))
    return F.when(text.rlike(rf"{_UNSPACED}|\S{{33}}"), F.filter(single, lambda w: w != "")).otherwise(spaced)


def short_hashes(text: Column) -> Column:
    """Hashes of the characters of a short text, white space runs as one; none of a longer one."""
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when((F.length(text) < SHORT) & (text != ""), F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.xxhash64(c))).otherwise(
        F.array().cast("array<bigint>")
    )


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def small_hashes(hashes: Column, s: int = S) -> Column:
    """A hash for each window of s words."""
    if s == 1:
        return hashes
    if s == 2:
        n = F.greatest(F.size(hashes) - 1, F.lit(0))
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    last = F.size(hashes) - s
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + d) for d in range(s)]))
    )


def anchors(hashes: Column, small: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos, hash>>, by position: the closed syncmers, `hash` of their k words.

    A text of fewer than k words has one anchor, of all its words; one without words or such a window has none
    here (a fingerprint always has one).
    """
    last, width = F.size(hashes) - k, k - s + 1

    def chosen(i: Column) -> Column:
        window = [F.get(small, i + d) for d in range(width)]
        edges = F.least(window[0], window[-1])
        return edges <= F.least(*window[1:-1], F.lit(2**63 - 1)) if width > 2 else F.lit(True)

    starts = F.filter(F.sequence(F.lit(0), last), chosen)
    found = F.transform(
        starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(hashes, i + d) for d in range(k)]).alias("hash"))
    )
    short = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(hashes).alias("hash")))
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return F.when(F.size(hashes) == 0, none).when(last < 0, short).otherwise(found)


def anchor_hashes(hashes: Column, small: Column, k: int = K, s: int = S) -> Column:
    """The distinct anchor hashes in order of their first position: a document's fingerprint."""
    last, width = F.size(hashes) - k, k - s + 1

    def chosen(i: Column) -> Column:
        window = [F.get(small, i + d) for d in range(width)]
        return F.least(window[0], window[-1]) <= F.least(*window[1:-1], F.lit(2**63 - 1)) if width > 2 else F.lit(True)

    found = F.transform(
        F.filter(F.sequence(F.lit(0), last), chosen), lambda i: F.xxhash64(*[F.get(hashes, i + d) for d in range(k)])
    )
    # Bound once by the outer array.
    some = F.transform(F.array(found), lambda f: F.when(F.size(f) == 0, F.array(F.xxhash64(hashes))).otherwise(F.array_distinct(f)))[0]
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(last < 0, F.array(F.xxhash64(hashes))).otherwise(some)


def with_print(docs: DataFrame, text: Column, into: str, k: int = K, s: int = S) -> DataFrame:
    """docs with its column `into`: distinct anchors of the words of text and, if it is short, of its characters.

    Column by column, so that windows around it keep their ranges and no hash is worked out twice.
    """
    rows = docs.withColumn("_h", word_hashes(text)).withColumn("_g", small_hashes(F.col("_h"), s))
    rows = rows.withColumn("_c", short_hashes(text)).withColumn("_d", small_hashes(F.col("_c"), s))
    of_words, of_characters = anchor_hashes(F.col("_h"), F.col("_g"), k, s), anchor_hashes(F.col("_c"), F.col("_d"), k, s)
    of_words = F.transform(of_words, lambda a: F.shiftrightunsigned(a, 1))
    signed = F.transform(of_characters, lambda a: -F.shiftrightunsigned(a, 1) - 1)
    both = F.when(F.size("_c") == 0, of_words).otherwise(F.concat(of_words, signed))
    return rows.withColumn(into, both).drop("_h", "_g", "_c", "_d")


def _shared(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    together = F.size(a) + F.size(b) - shared
    return F.when(together == 0, F.lit(1.0)).otherwise(shared / together)


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors among all anchors of both fingerprints, 0 to 1; two empty fingerprints (texts without words) are alike (1).

    A short text's anchors of characters count where the other text has such anchors too.
    """
    characters = [F.coalesce(F.array_min(x) < 0, F.lit(False)) for x in (a, b)]
    of_words = [F.filter(x, lambda h: h >= 0) for x in (a, b)]
    return F.when(characters[0] == characters[1], _shared(a, b)).otherwise(_shared(*of_words))


def printed(fingerprint: Column) -> Column:
    """A fingerprint as text: its anchors in hexadecimal, in order, between spaces."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.hex(h))), " ")


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint", k: int = K, s: int = S) -> DataFrame:
    """docs with its column `into` (array<bigint>): the anchors of the whole text. Null text is empty.

    Equal texts have equal fingerprints, on any machine. All other columns stay; one named `into` is replaced.
    """
    kept = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("_text"))
    return with_print(rows, F.col("_text"), "_print", k, s).select("row.*", F.col("_print").alias(into))


def anchor_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """doc_id, pos (word number), hash of each anchor: a positional index that equal passages meet in."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("h"))
    rows = rows.select("doc_id", "h", small_hashes(F.col("h"), s).alias("g"))
    return rows.select("doc_id", F.explode(anchors(F.col("h"), F.col("g"), k, s)).alias("a")).select("doc_id", "a.*")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by ascending doc_id (then text); the last row's is the first's.

    doc_id is cut into ranges at quantiles; the first row of a range is copied to the end of the range before
    it, so each range is ordered on its own and no task sees them all. Null ids come first, null text is empty.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("key"))
    n = buckets or shuffle_partitions(spark)
    first = rows.agg(F.min("key")).first()[0]
    # Bounds are ids of the table, one a range: few, and their number doesn't follow the rows.
    bounds = sorted({c for c in _cuts(rows, n) if first is not None and c > first})
    steps = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    bucket = F.size(F.filter(steps, lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    starts = ([first] if first is not None else []) + bounds
    is_start = F.col("key").isin(starts) if starts else F.lit(False)
    ranged = rows.withColumn("bucket", bucket)
    before = F.pmod(F.col("bucket") - 1, F.lit(len(starts) or 1))
    copies = F.when(
        is_start, F.array(F.struct("bucket", F.lit(False).alias("copy")), F.struct(before.alias("bucket"), F.lit(True).alias("copy")))
    ).otherwise(F.array(F.struct("bucket", F.lit(False).alias("copy"))))
    dealt = ranged.select("doc_id", "text", "key", F.explode(copies).alias("at")).select("doc_id", "text", "key", "at.*")
    order = Window.partitionBy("bucket").orderBy("copy", "key", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order))


def _cuts(rows: DataFrame, n: int) -> list[int]:
    found = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"] if n > 1 else []
    return [int(c) for c in found or []]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and of it with its last quarter replaced by the next document's start.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    both = rows.select(
        "bucket", "copy", "key", "text", "doc_id", n.cast("long").alias("n_chars"),
        F.when(~F.col("copy"), edited).alias("edited"),
    )
    prints = both
    for text, into in (("text", "fingerprint"), ("edited", "edited_fingerprint")):
        prints = with_print(prints, F.col(text), into)
    order = Window.partitionBy("bucket").orderBy("copy", "key", "text")
    last = prints.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter(~F.col("copy"))
    return last.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
