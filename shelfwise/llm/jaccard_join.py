"""N-gram Jaccard join: grouped prefix join on word shingles, exact.

Documents are sets of 64-bit hashes of 5-word shingles; a pair links at Jaccard >= threshold. Shingles are
ordered by the number of sets (slice by slice) they occur in, rarest first (ties by hash). A set of n shingles
that links with any other shares a shingle with it within the first n - ceil(threshold * n) + 1, and a
shingle of only one set is shared with none, so a set whose rare shingles fill that prefix has no partner.

1. Equal sets of a slice of texts collapse into one. Postings (shingle, set) meet by shingle, which gives
   frequencies. Only shingles met more than once go back to their slice.
2. Sets with enough of those survive, with a prefix; equal sets of all slices collapse into one key.
3. Keys with equal prefix and size are one group. Groups that share a prefix shingle and whose sizes allow
   a link are candidate pairs; they are not listed but connected: groups of one shingle and size class (all
   sizes in it are compatible) through one of them, neighbouring classes where their nearest sizes are.
4. Each connected candidate set is expanded to its members, whose whole sets meet in one task, or in blocks
   of bounded size, two at a time. There every pair of members is verified by counting shared shingles,
   unless both are connected already. The links found connect the classes.

Postings are packed into byte rows, one for each slice and hash range, so that 64-bit random numbers cross
the shuffle without row overhead. Keys are 64-bit digests of the whole set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, held, materialized, ship, shuffle_partitions, slices, text_bytes
from shelfwise.llm.components import components

N = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

_MEMBERS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64())])
_PACKED = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("kind", pa.int32()), ("rows", pa.binary())])
_PACKED_DDL = "bucket long, slice long, kind int, rows binary"
_POSTINGS, _TABLE = 0, 1
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_SURVIVORS = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("q", pa.int32()), ("items", pa.list_(pa.int64()))])


class _Words(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = found
        return found


def shingle_sets(texts: list[str | None], n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of its whole word sequence if that is shorter than n."""
    known = held("shingle-words", _Words).__getitem__
    with np.errstate(over="ignore"):
        for text in texts:
            # ASCII only: A-Z lower-cased, words between space, tab, line feed, vertical tab, form feed, return.
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
            w = np.fromiter(map(known, words), np.uint64, len(words))
            width = min(n, len(w))
            h = np.zeros(max(0, len(w) - width + 1) if len(w) else 0, np.uint64)
            for d in range(width):
                h = h * _MULTIPLIER + w[d : d + len(h)]
            if width < n:
                h = h + np.uint64(width + 1) * _MIX
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
            yield np.unique(h)


def set_key(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as compressed byte planes: the like high bytes of sorted numbers lie side by side."""
    head = np.array([len(columns), len(columns[0]), *(c.itemsize for c in columns)], "<u4").tobytes()
    planes = (np.ascontiguousarray(c.view("u1").reshape(-1, c.itemsize).T).tobytes() for c in columns)
    return _SQUEEZE.compress(head + b"".join(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    data = _EXPAND.decompress(data)
    count, n = np.frombuffer(data, "<u4", 2).tolist()
    sizes = np.frombuffer(data, "<u4", count, 8).tolist()
    at, out = 8 + 4 * count, []
    for size in sizes:
        planes = np.frombuffer(data, "u1", n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel())
        at += n * size
    return out


def _ranges(values: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted unsigned 64-bit values, by their top bits."""
    top = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    starts = np.flatnonzero(np.diff(top, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)]):
        yield int(top[a]), a, b


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def _packets(found: list[tuple]) -> pa.RecordBatch:
    return batch(_PACKED, list(zip(*found)))


def _members(n: int):
    def run(batches):
        for rows in batches:
            ids, texts, found = rows.column("doc_id").to_pylist(), rows.column("text"), []
            for doc_id, items in zip(ids, shingle_sets(map(lambda t: t.as_py(), texts), n)):
                found.append((doc_id, len(items), _signed(set_key(items)) if len(items) else None))
            if found:
                yield batch(_MEMBERS, list(zip(*found)))

    return run


def _postings(n: int, bits: int):
    """Packets of a slice of texts: a table of its sets (key, size), and postings (shingle, set number) by shingle range."""

    def run(batches):
        slice_id = TaskContext.get().partitionId() << 32
        for rows in batches:
            texts = rows.column("text").to_pylist()
            for a, b in slices(texts, 8 << 20):
                sets = {}
                for items in shingle_sets(texts[a:b], n):
                    if len(items):
                        sets.setdefault(set_key(items), items)
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets.values()], np.uint32)
                h = np.concatenate(list(sets.values()))
                of = np.repeat(np.arange(len(sizes), dtype="<u2" if len(sizes) < 1 << 16 else "<u4"), sizes)
                order = np.argsort(h, kind="stable")
                h, of = h[order], of[order]
                out = [(slice_id & ((1 << bits) - 1), slice_id, _TABLE, _pack([np.array(list(sets), np.uint64), sizes]))]
                for bucket, lo, hi in _ranges(h, bits):
                    steps = np.diff(h[lo:hi], prepend=np.uint64(0))
                    out.append((bucket, slice_id, _POSTINGS, _pack([steps, of[lo:hi]])))
                    if len(out) >= 256:
                        yield _packets(out)
                        out = []
                if out:
                    yield _packets(out)
                slice_id += 1

    return run


def _by_group(batches, name: str) -> Iterator[list[tuple[int, int, bytes]]]:
    """(slice, kind, rows) packets of one group after the other; a task gets them sorted by it."""
    last, held = None, []
    for rows in batches:
        columns = (rows.column(c).to_pylist() for c in (name, "slice", "kind"))
        for group, slice_id, kind, data in zip(*columns, rows.column("rows")):
            if group != last and held:
                yield held
                held = []
            last = group
            held.append((slice_id, kind, data.as_py()))
    if held:
        yield held


def _shared(batches):
    """Postings of a shingle range -> those of shingles met more than once, with how often, back to their slices."""
    for held in _by_group(batches, "bucket"):
        out = [(0, slice_id, kind, data) for slice_id, kind, data in held if kind == _TABLE]
        sources = [(slice_id, *_unpack(data)) for slice_id, kind, data in held if kind == _POSTINGS]
        if sources:
            h = np.concatenate([np.cumsum(steps, dtype=np.uint64) for _, steps, _ in sources])
            of = np.concatenate([x.astype(np.uint32) for _, _, x in sources])
            source = np.repeat(np.arange(len(sources), dtype=np.uint32), [len(x) for _, _, x in sources])
            order = np.argsort(h, kind="stable")
            _, lengths = _runs(h[order])
            df = np.repeat(lengths, lengths)
            keep = order[df > 1]
            many = np.zeros(len(h), "<u4")
            many[order] = df
            keep.sort()  # back to the order of sources, and of shingles in each
            starts, lengths = _runs(source[keep])
            for a, size in zip(starts.tolist(), lengths.tolist()):
                rows = keep[a : a + size]
                out.append((0, sources[source[rows[0]]][0], _POSTINGS, _pack([np.diff(h[rows], prepend=np.uint64(0)), of[rows], many[rows]])))
        for a in range(0, len(out), 256):
            yield _packets(out[a : a + 256])


def _survivors(percent: int):
    """Per set: its shared shingles, rarest first, if there are enough of them for a partner; q of them are its prefix."""

    def run(batches):
        for held in _by_group(batches, "slice"):
            keys, sizes = _unpack(next(data for _, kind, data in held if kind == _TABLE))
            packs = [_unpack(data) for _, kind, data in held if kind == _POSTINGS]
            if not packs:
                continue
            h = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _, _ in packs])
            of, df = (np.concatenate([p[k] for p in packs]) for k in (1, 2))
            order = np.lexsort((h, df, of))
            of, h = of[order], h[order].view(np.int64)
            starts, m = _runs(of)
            size = sizes[of[starts]].astype(np.int64)
            need = -(-percent * size // 100)
            good = np.flatnonzero(m >= need)
            for k in range(0, len(good), 1024):
                some = good[k : k + 1024]
                items = [h[starts[i] : starts[i] + m[i]] for i in some]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(items)))
                key = keys[of[starts[some]]].view(np.int64)
                yield batch(_SURVIVORS, [key, size[some].astype(np.int32), (m - need + 1)[some].astype(np.int32), lists])

    return run


def _verified(percent: int):
    """Members of a candidate set, one or two blocks of it at a time -> the links that connect them."""

    def links(keys, n, blocks, items) -> list[tuple[int, int]]:
        owner = np.repeat(np.arange(len(keys)), [len(x) for x in items])
        _, code = np.unique(np.concatenate(items), return_inverse=True)
        posting = owner[np.argsort(code, kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(code))])
        ends = np.cumsum([len(x) for x in items])
        label, found = np.arange(len(keys)), []
        two = len(np.unique(blocks)) > 1
        for x in range(len(keys)):
            rest = label != label[x]
            if two:
                rest &= blocks != blocks[x]
            if not rest.any():
                continue
            codes = code[ends[x] - len(items[x]) : ends[x]]
            same = np.bincount(np.concatenate([posting[bounds[c] : bounds[c + 1]] for c in codes]), minlength=len(keys))
            for y in np.flatnonzero(rest & (100 * same >= percent * (n + n[x] - same))):
                if label[y] != label[x]:
                    found.append((int(keys[x]), int(keys[y])))
                    label[label == label[y]] = label[x]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []

        def closed() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            keys, n, blocks, items = zip(*held)
            return links(np.array(keys), np.array(n, np.int64), np.array(blocks), items)

        for rows in batches:
            lists = rows.column("items")
            flat, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            names = zip(*(rows.column(c).to_pylist() for c in ("part", "block_x", "block_y", "key", "n", "block")))
            for k, (part, block_x, block_y, key, n, block) in enumerate(names):
                if (part, block_x, block_y) != last:
                    out += closed()
                    last, held = (part, block_x, block_y), []
                held.append((key, n, block, flat[cuts[k] : cuts[k + 1]]))
        out += closed()
        if out:
            yield batch(_LINKS, list(zip(*out)))

    return run


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """key -> part: the connected candidate set that a key belongs to, for keys that have a candidate partner."""
    prefixes = sets.select("key", "n", F.slice("items", F.lit(1), F.col("q")).alias("prefix"))
    grouped = prefixes.select("key", "n", "prefix", F.xxhash64("n", "prefix").alias("gid"))
    heads = grouped.groupBy("gid").agg(F.min("key").alias("head"))
    grouped = materialized(grouped.join(heads, "gid").select("key", "n", "head", F.when(F.col("key") == F.col("head"), F.col("prefix")).alias("prefix")), "jaccard-groups")
    # Sizes of one class differ by less than the threshold's ratio; sizes two classes apart by more.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    entries = grouped.filter("key = head").select("head", "n", size_class.alias("class"), F.explode("prefix").alias("h"))
    classes = materialized(
        entries.groupBy("h", "class").agg(
            F.min("head").alias("pivot"), F.count(F.lit(1)).alias("many"),
            F.min(F.struct("n", "head")).alias("least"), F.max(F.struct("n", "head")).alias("most"),
        ),
        "jaccard-classes",
    )
    pivots = classes.filter("many > 1").select("h", "class", "pivot")
    starred = entries.join(pivots, ["h", "class"]).select(F.col("pivot").alias("u"), F.col("head").alias("v"))
    lower = classes.select("h", F.col("most").alias("low"), (F.col("class") + 1).alias("class"))
    upper = classes.select("h", F.col("least").alias("high"), "class")
    crossing = lower.join(upper, ["h", "class"]).filter(100 * F.col("low.n") >= percent * F.col("high.n"))
    crossing = crossing.select(F.col("low.head").alias("u"), F.col("high.head").alias("v"))
    inside = grouped.filter("key != head").select(F.col("head").alias("u"), F.col("key").alias("v"))
    return components(starred.unionByName(crossing).unionByName(inside)).select(F.col("node").alias("key"), F.col("component").alias("part"))


def _links(sets: DataFrame, percent: int, block_keys: int = 2048, block_items: int = 2_000_000) -> DataFrame:
    parts = materialized(_candidates(sets, percent), "jaccard-parts")
    members = sets.select("key", "n", "items").join(parts, "key")
    sizes = members.groupBy("part").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.size("items")).alias("total"))
    blocks = F.ceil(F.greatest(F.col("keys") / block_keys, F.col("total") / block_items)).cast("int")
    blocked = members.join(sizes.select("part", blocks.alias("blocks")), "part")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("key", F.lit(9)), F.col("blocks")).cast("int"))
    # A key visits each pair of blocks that its own block is part of.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    visits = blocked.select("part", "key", "n", "items", "block", other.alias("other")).select(
        "part", F.least("block", "other").alias("block_x"), F.greatest("block", "other").alias("block_y"), "block", "key", "n", "items"
    )
    pair = ["part", "block_x", "block_y"]
    dealt = visits.repartition(shuffle_partitions(sets.sparkSession), *pair).sortWithinPartitions(*pair)
    return dealt.mapInArrow(_verified(percent), "u long, v long")


def jaccard_links(docs: DataFrame, percent: int = 75, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, n_shingles, key; links: u, v), keys linked so that classes are connected.

    Between equal texts there are no links: they share a key.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    _, size = text_bytes(rows)
    parts = shuffle_partitions(spark)
    bits = max(parts - 1, size // (6 << 20)).bit_length()
    members = rows.mapInArrow(_members(n), "doc_id long, n_shingles long, key long")
    packed = rows.select("text").mapInArrow(_postings(n, bits), _PACKED_DDL)
    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(_shared, _PACKED_DDL)
    again = shared.repartition(parts, "slice").sortWithinPartitions("slice")
    sets = again.mapInArrow(_survivors(percent), "key long, n int, q int, items array<bigint>")
    # Equal sets of different slices are one.
    sets = materialized(sets.dropDuplicates(["key"]), "jaccard-sets")
    links = materialized(_links(sets, percent), "jaccard-links")
    return members, links


def near_duplicate_classes(docs: DataFrame, percent: int = 75, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) for each row.

    Null and empty texts, and texts without words, have no shingles and link with nothing. Equal texts
    always link. Null doc_ids never name a class unless all its rows have one; repeated rows keep their own
    row; other columns are ignored; no rows give no rows.
    """
    members, links = jaccard_links(docs, percent, n)
    members = materialized(members, "jaccard-members")
    labels = components(links).withColumnRenamed("node", "key")
    keyed = members.filter("key is not null")
    smallest = keyed.groupBy("key").agg(F.min("doc_id").alias("smallest"))
    # A key's class is named by its smallest doc_id; keys without links are classes of their own.
    named = smallest.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialized(named, "jaccard-keys")
    ids = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_key = named.select("key", "component").join(ids, "component").select("key", "component_id")
    alone = members.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return keyed.join(of_key, "key").select("doc_id", "n_shingles", "component_id").unionByName(alone)
