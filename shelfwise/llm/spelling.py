"""Spelling variants: words that differ by one inserted, deleted or replaced character, and their roots.

The words' prefixes are the nodes of a trie, their suffixes those of a reversed trie, and every node has a number.
A word with one place skipped is the pair (node before the place, node after it); two words of equal pairs differ
at that place alone. A word between two characters is the pair (node before, node after), and equals the pair of a
longer word that skips one. So near words meet in one shuffle of integer pairs, exactly and without comparing
texts, and a meeting holds at most one word a character, and one that is a character shorter.

Nodes are numbered by shards of the sorted words, each in one pass that remembers the word before. Numbers of
prefixes of the shards' bounds come from the bounds, so that a node in several shards has one number.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, materialized, ship

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BOUND = 64  # code points of a shard's bound
_PLACES = 40  # bits of a number inside its shard


def damaged(run: str, base: int) -> str:
    """The run, or where 97 divides its checksum (continued from that of `<doc_id>:`), the run without a character."""
    h = zlib.crc32(run.encode("utf-8"), base)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_batches(entries: int):
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                if not text:
                    continue
                # Bytes are lower-cased in A-Z only.
                runs = Counter(RUN.findall(text.encode("utf-8").lower().decode("utf-8")))
                base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    total[damaged(word, base)] += n
                if len(total) >= entries:
                    yield batch(out, [list(total), list(total.values())])
                    total = Counter()
        yield batch(out, [list(total), list(total.values())])

    return run


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, entries: int = 200_000) -> DataFrame:
    """word, n of the words of whole texts with at least min_length code points and min_count occurrences.

    A task counts its own words first, about `entries` different ones at a time; the shuffle adds up. Null texts have
    no words; a null doc_id is written as nothing in the checksum; repeated rows count each; no rows give no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(_count_batches(entries), "word string, n long").filter(F.char_length("word") >= min_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def shard_bounds(words: DataFrame, column: str, shards: int, each: int = 100) -> list[str]:
    """shards - 1 strings that cut the sorted words into shards of about equal size, from a sample of `each` a shard.

    They decide which task numbers a word, not the result.
    """
    n = words.count()
    if shards < 2 or not n:
        return []
    share = min(1.0, shards * each / n)
    draw = F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(share * (1 << 30))
    # By far more rows than `shards * each` can't be drawn by a hash; the limit bounds the driver all the same.
    drawn = sorted(r[0] for r in words.filter(draw).select(F.substring(column, 1, _BOUND)).limit(2 * shards * each).collect())
    return sorted({drawn[len(drawn) * k // shards] for k in range(1, shards)}) if drawn else []


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def bound_nodes(bounds: list[str]) -> list[list[int]]:
    """Node numbers (negative) of the prefixes of each bound, the empty one first; equal prefixes have equal numbers."""
    nodes, last, new = [], "", -1
    held = [-1]
    for b in bounds:
        held = held[: _common(last, b) + 1]
        while len(held) <= len(b):
            new -= 1
            held.append(new)
        nodes.append(list(held))
        last = b
    return nodes


class Numbering:
    """Node numbers of sorted words, one shard after another."""

    def __init__(self, bounds: list[str]):
        self.bounds, self.fixed = bounds, bound_nodes(bounds)
        self.shard = -1
        self.start(0)

    def start(self, shard: int) -> None:
        self.shard, self.last, self.nodes = shard, "", [-1]
        self.next = shard << _PLACES
        self.place = (shard << _PLACES) - 1
        # Prefixes of the bounds on either side, the only ones that other shards can have too.
        self.edges = [(self.bounds[k], self.fixed[k]) for k in (shard - 1, shard) if 0 <= k < len(self.bounds)]

    def of(self, shard: int, word: str) -> tuple[int, list[int]]:
        """A number in the order of words, and the numbers of the word's prefixes, the empty one first."""
        if shard != self.shard:
            self.start(shard)
        keep = _common(self.last, word)
        nodes = self.nodes[: keep + 1]
        for bound, fixed in self.edges:
            n = _common(bound, word) + 1
            if n > len(nodes):
                nodes += fixed[len(nodes) : n]
        fresh = len(word) + 1 - len(nodes)
        nodes += range(self.next, self.next + fresh)
        self.next += fresh
        self.place += 1
        self.last, self.nodes = word, nodes
        return self.place, nodes


def _sharded(words: DataFrame, column: str, bounds: list[str], shards: int) -> DataFrame:
    """words with their shard, in the order of shard and word inside each task."""
    schema = words.withColumn("shard", F.lit(0)).schema
    at = words.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            shard = [bisect_right(bounds, w) for w in rows.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shard, pa.int32())], [*rows.schema.names, "shard"])

    return words.mapInArrow(run, schema).repartition(shards, "shard").sortWithinPartitions("shard", column)


def number_nodes(words: DataFrame, column: str, nodes: str, shards: int, place: str | None = None) -> DataFrame:
    """words with `nodes`, the numbers of the column's prefixes, and `place`, a number in the order of the words.

    The column's values are not null and differ. Numbers are equal exactly if the prefixes are.
    """
    ship(words.sparkSession)
    bounds = shard_bounds(words, column, shards)
    rows = _sharded(words, column, bounds, shards)
    kept = [c for c in rows.columns if c != "shard"]
    at, at_shard = rows.columns.index(column), rows.columns.index("shard")
    keep = [rows.columns.index(c) for c in kept]
    schema = words.select("*", F.array(F.lit(0).cast("long")).alias(nodes), *([F.lit(0).cast("long").alias(place)] if place else [])).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbering(bounds)
        for rows in batches:
            found = [numbers.of(s, w) for s, w in zip(rows.column(at_shard).to_pylist(), rows.column(at).to_pylist())]
            sizes = np.fromiter((len(x) for _, x in found), np.int32, len(found))
            flat = np.fromiter((x for _, n in found for x in n), np.int64, int(sizes.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            extra = [pa.array([p for p, _ in found], pa.int64())] if place else []
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), lists, *extra], names)

    return rows.mapInArrow(run, schema)


def node_pairs(words: DataFrame) -> DataFrame:
    """before, after, kind, id, n: the pairs of each word of id, word, n, forward, backward.

    kind 2: a skipped place, the first of a run of equal characters; 1: another skipped place, where a deletion
    gives the same as at the first; 0: a place between two characters, before the first and behind the last.
    """
    length = F.char_length("word")
    places = F.sequence(F.lit(0), length)
    rows = words.select("id", "n", "word", "forward", "backward", length.alias("length"), F.explode(places).alias("i"))
    before = F.element_at("forward", F.col("i") + 1)
    letter = F.substring("word", F.col("i") + 1, F.lit(1))
    first = (F.col("i") == 0) | (letter != F.substring("word", F.col("i"), F.lit(1)))
    joint = F.struct(F.element_at("backward", F.col("length") - F.col("i") + 1).alias("after"), F.lit(0).alias("kind"))
    skip = F.struct(
        F.element_at("backward", F.greatest(F.col("length") - F.col("i"), F.lit(1))).alias("after"), F.when(first, 2).otherwise(1).alias("kind")
    )
    both = F.when(F.col("i") < F.col("length"), F.array(joint, skip)).otherwise(F.array(joint))
    return rows.select("id", "n", before.alias("before"), F.explode(both).alias("p")).select("before", "p.after", "p.kind", "id", "n")


def near_words(pairs: DataFrame) -> DataFrame:
    """id, n_near, best (struct n, minus_id of the near word of largest n, smallest of equals), of words with near words.

    A meeting's words are reduced to counts and its two best; each word then chooses the better that is not itself.
    """
    it = F.struct(F.col("n"), (-F.col("id")).alias("minus_id"), F.col("kind"))
    met = pairs.groupBy("before", "after").agg(F.sort_array(F.collect_list(it), asc=False).alias("met")).filter(F.size("met") > 1)
    gaps, first = F.filter("met", lambda m: m["kind"] > 0), F.filter("met", lambda m: m["kind"] == 2)
    shorter = F.filter("met", lambda m: m["kind"] == 0)
    met = met.select("met", gaps.alias("gaps"), first.alias("first"), F.get(shorter, F.lit(0)).alias("shorter"))
    sized = met.select(
        "met", "shorter", F.size("gaps").alias("n_gaps"), F.size("first").alias("n_first"),
        F.get("gaps", F.lit(0)).alias("top"), F.get("gaps", F.lit(1)).alias("second"), F.get("first", F.lit(0)).alias("top_first"),
    )
    rows = sized.select("*", F.explode("met").alias("m")).drop("met")
    own, kind = F.col("m.minus_id"), F.col("m.kind")

    def ranked(column: str) -> Column:
        return F.struct(F.col(f"{column}.n").alias("n"), F.col(f"{column}.minus_id").alias("minus_id"))

    has_shorter = (kind == 2) & F.col("shorter").isNotNull()
    other = F.when(F.col("top.minus_id") != own, ranked("top")).when(F.col("second").isNotNull(), ranked("second"))
    longer = F.when(F.col("n_first") > 0, ranked("top_first"))
    count = F.when(kind == 0, F.col("n_first")).otherwise(F.col("n_gaps") - 1 + F.when(has_shorter, 1).otherwise(0))
    best = F.when(kind == 0, longer).otherwise(F.greatest(other, F.when(has_shorter, ranked("shorter"))))
    found = rows.select((-own).alias("id"), count.cast("long").alias("count"), best.alias("best")).filter("count > 0")
    return found.groupBy("id").agg(F.sum("count").alias("n_near"), F.max("best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """id, root of rows of id, form: the end of each chain of forms, by doubling the steps until no chain goes on.

    Forms have twice the occurrences, so a chain has at most 64 links and seven rounds reach its end.
    """
    chains = materialized(forms.select("id", F.col("form").alias("root")), "spelling-chains")
    while True:
        onward = chains.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = materialized(chains.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-chains")
        if moved.filter("moved").isEmpty():
            return moved.select("id", "root")
        chains = moved.select("id", "root")


def spelling_groups(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, shards: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words that `word_counts` finds.

    Near words differ by exactly one inserted, deleted or replaced code point. form: the near word of largest n
    (ties: the smallest), if that n is at least `ratio` times the word's; root: the end of the chain of forms, the
    word itself without one. Words of any length are taken whole. shards: tasks that number the words, from their
    number if not given; they don't change the result.
    """
    words = materialized(word_counts(docs, min_length, min_count), "spelling-words")
    shards = shards or max(1, min(4096, words.count() // 50_000 + 1))
    forward = materialized(number_nodes(words, "word", "forward", shards, "id").withColumn("mirrored", F.reverse("word")), "spelling-forward")
    backward = number_nodes(forward.select("id", "mirrored"), "mirrored", "backward", shards).select("id", "backward")
    pairs = node_pairs(forward.join(backward, "id"))
    near = materialized(near_words(pairs), "spelling-near")
    known = forward.select("id", "word", "n")
    listed = known.join(near, "id", "left")
    enough = F.col("best.n") >= ratio * F.col("n")
    listed = listed.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best.minus_id")).alias("form_id"))
    listed = materialized(listed, "spelling-listed")
    roots = follow(listed.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    # Names of forms and roots: two look-ups by number, of the words that have them only.
    named = listed.filter("form_id is not null").join(roots, "id")
    named = named.join(known.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_id")
    named = named.join(known.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    named = named.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = listed.filter("form_id is null").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n")
    )
    return named.unionByName(alone)
