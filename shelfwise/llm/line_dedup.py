"""Substring deduplication by hashing lines, paragraphs, sentences or clauses.

Each text is cut into units; a unit's normal form (lower case, single spaces) is digested. Of all units with
one digest, the earliest by (doc_id, place in the text) stays; repeats are removed, as passages of a stated least size,
and whole lines and paragraphs of any size where the caller asks for it.

Documents are dealt into buckets. A bucket names each digest once, with its earliest place there, so that a
line in a third of all documents is as many rows as there are buckets, not documents. The digest's owner is
the bucket with the earliest place; all other buckets are told, and each cuts its texts on its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from shelfwise.llm.common import ship, shuffle_partitions, text_bytes

# Letters of scripts written without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, ideographs.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
# Marks that end a sentence or clause without a space after them: full-width, Indic, Arabic, Ethiopic, Armenian, Burmese, Khmer, Tibetan.
_STOPS = "\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u061f\u06d4\u1362\u1367\u0589\u104b\u17d4\u17d5\u0f0d\u0f0e\u203c\u2047-\u2049"
_PAUSES = "\uff0c\u3001\uff64\uff1b\uff1a\u060c\u061b\u1363-\u1366\u104a"
_CLOSING = "\u300d\u300f\uff09\u3011\u300b\u3009\uff63\u201d\u2019\u00bb)\\]\"'"


def _marks(spaced: str, other: str) -> re.Pattern:
    """Ends of units: white space after a mark or between two letters of unspaced scripts, other marks, line breaks."""
    after = rf"(?:(?<=[{other}])|(?<=[{other}][{_CLOSING}]))(?![\s{other}{_CLOSING}])"
    return re.compile(rf"(?<=[{spaced}{other}])\s+|(?<=[{_UNSPACED}])\s+(?=[{_UNSPACED}])|\s*\n\s*|{after}")


BOUNDARIES = {
    "line": re.compile(r"\s*\n\s*"),
    "paragraph": re.compile(r"\s*\n[^\S\n]*\n\s*"),
    "sentence": _marks(".!?", _STOPS),
    "clause": _marks(".!?,;:", _STOPS + _PAUSES),
}
_UNSPACED_LETTERS = re.compile(f"[{_UNSPACED}]")
_LAST = (1 << 63) - 1

_FIRST = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("bucket", pa.int32()), ("rank", pa.int64())])


def units(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) in code points; together they are the whole text, each with the white space that follows it."""
    if not text:
        return []
    ends = [m.end() for m in BOUNDARIES[unit].finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def size_in_words(words: list[str]) -> int:
    """Words between spaces; two letters of scripts without spaces, or 64 other characters in a row, count as one too."""
    return sum(1 if len(w) < 4 else max(1, len(w) // 64, 0 if w.isascii() else len(_UNSPACED_LETTERS.findall(w)) // 2) for w in words)


def digest(words: list[str], seed: int = 0) -> tuple[int, int]:
    """Digest of a unit's normal form; units of another seed are never equal."""
    whole = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), seed)
    low, high = whole & ((1 << 64) - 1), whole >> 64
    return low - (1 << 64) if low >> 63 else low, high - (1 << 64) if high >> 63 else high


def whole_units(text: str, spans: list[tuple[int, int]], words: list[list[str]], whole: tuple[str, ...]):
    """(first, last + 1, digest) of each unit of the kinds in `whole`, as ranges of the smaller units `spans`.

    Units of several kinds that hold the same spans are one; a line and a paragraph of one normal form are equal.
    """
    ends = {b: k + 1 for k, (_, b) in enumerate(spans)}
    ranges = {(ends.get(a, 0), ends[b]) for kind in whole for a, b in units(text, kind)}
    for i, j in sorted(ranges):
        if held := [w for k in range(i, j) for w in words[k]]:
            yield i, j, digest(held, 1)


def _in_order(table: pa.Table) -> tuple[list[int], pa.Table]:
    """Ranks and rows of a bucket, by doc_id (null last); equal ids by a hash of the text."""
    ranks = [_LAST if i is None else i for i in table.column("doc_id").to_pylist()]
    order = sorted(range(len(ranks)), key=lambda k: (ranks[k], table.column("row_id")[k].as_py()))
    return [ranks[k] for k in order], table.take(pa.array(order, pa.int64()))


def _firsts(unit: str, whole: tuple[str, ...]):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        ranks, table = _in_order(table)
        seen: dict[tuple[int, int], int] = {}
        for rank, text in zip(ranks, table.column("text")):
            text = text.as_py() or ""
            spans = units(text, unit)
            words = [text[a:b].lower().split() for a, b in spans]
            for held in words:
                if held:
                    seen.setdefault(digest(held), rank)
            for _, _, d in whole_units(text, spans, words, whole):
                seen.setdefault(d, rank)
        h = np.array(list(seen), np.int64).reshape(-1, 2)
        return pa.table(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(len(h), bucket, np.int32)), pa.array(list(seen.values()), pa.int64())],
            schema=_FIRST,
        )

    return run


def removed_units(
    text: str, spans: list[tuple[int, int]], min_words: int, foreign: set, seen: set, whole: tuple[str, ...] = ()
) -> list[bool]:
    """Which units go: runs of repeats (owned elsewhere or seen before) that hold min_words words or more together.

    So do those of a repeated unit of the kinds in `whole`, whatever its size.
    """
    gone, start, held = [False] * len(spans), 0, 0
    words = [text[a:b].lower().split() for a, b in spans]
    for k, own in enumerate(words):
        d = digest(own) if own else None
        if d is None or d in foreign or d in seen:
            held += size_in_words(own)  # white space alone goes with its neighbours
            continue
        seen.add(d)
        if held >= min_words:
            gone[start:k] = [True] * (k - start)
        start, held = k + 1, 0
    if held >= min_words:
        gone[start:] = [True] * (len(spans) - start)
    for i, j, d in whole_units(text, spans, words, whole):
        if d in foreign or d in seen:
            gone[i:j] = [True] * (j - i)
        seen.add(d)
    return gone


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in spans:
        if out and out[-1]["end"] == a:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b})
    return out


def _cut(unit: str, min_words: int, whole: tuple[str, ...], schema: pa.Schema):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        _, docs = _in_order(docs)
        foreign = set(zip(told.column("h1").to_pylist(), told.column("h2").to_pylist()))
        seen: set = set()
        texts, kept, cut, counts, gone_counts = [], [], [], [], []
        for text in docs.column("text"):
            text = text.as_py()
            spans = units(text or "", unit)
            gone = removed_units(text or "", spans, min_words, foreign, seen, whole)
            stays = [s for s, g in zip(spans, gone) if not g]
            intact = len(stays) == len(spans)
            texts.append(text if intact else "".join(text[a:b] for a, b in stays))
            kept.append(_merged(stays))
            cut.append(_merged([s for s, g in zip(spans, gone) if g]))
            counts.append(len(spans))
            gone_counts.append(sum(gone))
        values = {"text": texts, "kept_spans": kept, "removed_spans": cut, "n_units": counts, "n_removed": gone_counts}
        columns = [pa.array(values[f.name], f.type) if f.name in values else docs.column(f.name) for f in schema]
        return pa.table(columns, schema=schema)

    return run


def dedup_units(docs: DataFrame, unit: str = "clause", min_words: int = 15, whole: tuple[str, ...] = ()) -> DataFrame:
    """Every row with `text` cut, and n_units, n_removed, kept_spans and removed_spans (offsets in the original).

    Of units with one normal form the earliest by doc_id (null last; rows of one id in no stated order), then by
    place, stays, in its own text too; the others go where they are part of a passage: units in a row, all
    repeats, of min_words words or more together (two letters a word in scripts without spaces). A single short repeat, such as a greeting or a heading, says
    nothing and stays; min_words=1 removes it as well. The smaller the unit, the less of a passage that starts and
    ends inside units escapes. `whole` names larger kinds ("line", "paragraph") of which each repeat goes, of any
    size; a paragraph wrapped otherwise is the same paragraph. n_units and n_removed count `unit`. Null text stays null and empty stays empty, with no
    units. The other columns come back unchanged, except ones named like the four added, which are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    added = {"n_units", "n_removed", "kept_spans", "removed_spans"}
    others = [c for c in docs.columns if c not in added | {"doc_id", "text"}]
    _, size = text_bytes(docs)
    buckets = 4 * max(shuffle_partitions(spark), size // (64 << 20))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("row"),
        F.xxhash64("text").alias("row_id"),
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(buckets)).cast("int"))
    firsts = rows.select("bucket", "doc_id", "row_id", "text").groupBy("bucket").applyInArrow(
        _firsts(unit, whole), "h1 long, h2 long, bucket int, rank long"
    )
    # At most one row a bucket for each digest.
    of_digest = Window.partitionBy("h1", "h2")
    owner = F.min(F.struct("rank", "bucket")).over(of_digest)["bucket"]
    told = firsts.withColumn("owner", owner).filter("bucket != owner").select("bucket", "h1", "h2")
    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    schema = StructType(
        [
            StructField("doc_id", LongType()), StructField("text", StringType()), rows.schema["row"],
            StructField("n_units", IntegerType()), StructField("n_removed", IntegerType()),
            StructField("kept_spans", span), StructField("removed_spans", span),
        ]
    )
    cut = (
        rows.groupBy("bucket")
        .cogroup(told.groupBy("bucket"))
        .applyInArrow(_cut(unit, min_words, whole, to_arrow_schema(schema)), schema)
    )
    ordered = [F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return cut.select(*ordered, "n_units", "n_removed", "kept_spans", "removed_spans")
