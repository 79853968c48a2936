"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The mix is a row of slots, one block of one source each. A source with weight w gives its j-th block the
release time floor(j / w) and the deadline ceil((j + 1) / w); the slot t goes to the released block with
the earliest deadline. Every block then runs inside its window, so after any number of slots a source has
had less than one block more or less than its weight asks for.

Weights are shares n / frame with whole n that sum to `frame`, so all windows repeat with that period: one
frame is scheduled once, in a single bounded row, and all frames of the mix follow it.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialized

NO_SOURCE = "\x00none"
REST = "\x00rest"
FANOUT = 64


def frame_schedule(lines: DataFrame, frame: int) -> DataFrame:
    """lines (line, n; n sums to `frame`) -> slot, line, j, release, deadline of one frame, earliest deadline first."""
    state = F.array_sort(F.collect_list(F.struct("line", F.col("n").cast("int").alias("n"), F.lit(0).alias("j"))))
    # A schedule has at most max_sources lines and a fixed number of slots, so this one row is bounded.
    one = lines.groupBy().agg(state.alias("lines")).filter(F.size("lines") > 0)
    release, deadline = f"floor(x.j * {frame}L / x.n)", f"ceil((x.j + 1) * {frame}L / x.n)"
    return one.selectExpr(f"""inline(
        aggregate(
            sequence(0L, {frame - 1}L),
            struct(lines, cast(array() as array<struct<slot:bigint,deadline:bigint,line:string,j:int,release:bigint>>) as picks),
            (acc, t) -> transform(
                array(array_min(transform(
                    filter(acc.lines, x -> x.j < x.n and {release} <= t),
                    x -> struct({deadline} as deadline, x.line as line, x.j as j, {release} as release)))),
                p -> struct(
                    transform(acc.lines, x -> struct(x.line as line, x.n as n, if(x.line = p.line, x.j + 1, x.j) as j)) as lines,
                    concat(acc.picks, array(struct(t as slot, p.deadline, p.line, p.j, p.release))) as picks))[0],
            acc -> acc.picks))""")


def _node_schedules(nodes: DataFrame) -> DataFrame:
    """nodes (node, frame, lines: array of (line, n), n sums to frame) -> node, line, n, j, slot, release, deadline, frame.

    frame_schedule for many frames at once, a row each; a node has at most 2 * FANOUT lines on average FANOUT.
    """
    release, deadline = "floor(x.j * acc.frame / x.n)", "ceil((x.j + 1) * acc.frame / x.n)"
    return nodes.selectExpr("node", "frame", f"""inline(
        aggregate(
            sequence(0L, frame - 1L),
            struct(frame, transform(lines, x -> struct(x.line as line, x.n as n, 0L as j)) as lines,
                cast(array() as array<struct<slot:bigint,deadline:bigint,line:string,n:bigint,j:bigint,release:bigint>>) as picks),
            (acc, t) -> transform(
                array(array_min(transform(
                    filter(acc.lines, x -> x.j < x.n and {release} <= t),
                    x -> struct({deadline} as deadline, x.line as line, x.n as n, x.j as j, {release} as release)))),
                p -> struct(
                    acc.frame as frame,
                    transform(acc.lines, x -> struct(x.line as line, x.n as n, if(x.line = p.line, x.j + 1L, x.j) as j)) as lines,
                    concat(acc.picks, array(struct(t as slot, p.deadline as deadline, p.line as line, p.n as n, p.j as j, p.release as release))) as picks))[0],
            acc -> acc.picks))""")


def _node_shares(members: DataFrame, allotted: DataFrame) -> DataFrame:
    """members (node, line, size) and allotted (node, slots a turn) -> node, frame, turns, lines (line, n).

    A node's frame is 2^e of its turns: two slots a line at least. Whole n: one each, the rest by largest remainders.
    """
    lines = members.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("line", "size"))).alias("m"), F.sum("size").alias("total"))
    lines = lines.join(allotted, "node").withColumn("turns", F.expr("cast(pow(2, greatest(0, ceil(log2(2.0D * size(m) / slots)))) as bigint)"))
    lines = lines.withColumn("frame", F.expr("turns * slots")).withColumn("free", F.expr("frame - size(m)"))
    # Over one a line, as the sizes ask for; then whole numbers, and what they leave to the largest remainders.
    lines = lines.withColumn("extra", F.expr("transform(m, x -> greatest(0.0D, x.size / cast(total as double) * frame - 1))"))
    lines = lines.withColumn("all", F.expr("aggregate(extra, 0.0D, (a, x) -> a + x)"))
    lines = lines.withColumn("q", F.expr("transform(extra, x -> if(all > 0, x / all, 1.0D / size(m)) * free)"))
    lines = lines.withColumn("open", F.expr("free - aggregate(q, 0L, (a, x) -> a + cast(floor(x) as bigint))"))
    lines = lines.withColumn("order", F.expr("array_sort(transform(q, (x, i) -> struct(floor(x) - x as r, i as i)))"))
    lines = lines.withColumn("up", F.expr("transform(slice(order, 1, cast(greatest(open, 0) as int)), x -> x.i)"))
    shares = "transform(m, (x, i) -> struct(x.line as line, 1L + cast(floor(q[i]) as bigint) + if(array_contains(up, i), 1L, 0L) as n))"
    return lines.select("node", F.expr(shares).alias("lines"), "turns").withColumn(
        "frame", F.expr("aggregate(lines, 0L, (a, x) -> a + x.n)")
    )


def nested_picks(pooled: DataFrame, n_pooled: int, rest: DataFrame, n_rest: int, frame: int) -> tuple[DataFrame, DataFrame, int]:
    """Slots of the pooled sources inside the line REST: (line, n, period), (line, j, slot, release, deadline), turns.

    pooled: (line, size). The slots that a line gets are themselves a row of slots, which a frame of its own deals to
    its members, as deep as it takes for about FANOUT members a frame. `rest` (j, slot, release, deadline) are the
    n_rest slots of REST in a frame. A member's block b in place u of the line's row has the slot of the line's u-th block;
    it is released with the block that its release names and due with the one before its deadline. All repeat with
    `period` slots; `turns` (a power of two) frames are a whole number of periods of every source.
    """
    counts = [max(1, -(-n_pooled // FANOUT))]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // FANOUT))
    cell = F.pmod(F.xxhash64("line"), F.lit(counts[0]))
    members = pooled.select("line", "size", cell.alias("cell"))
    # Levels from the root (one cell) to the cells that hold sources.
    spark = pooled.sparkSession
    levels = []
    for depth in range(len(counts)):
        width = FANOUT**depth
        at = members.withColumn("node", F.concat(F.lit(f"{depth}/"), F.floor(F.col("cell") / width).cast("string")))
        if depth == 0:
            levels.append(at.select("node", "line", "size"))
        else:
            child = F.concat(F.lit(f"{depth - 1}/"), F.floor(F.col("cell") / FANOUT ** (depth - 1)).cast("string"))
            levels.append(at.groupBy("node", child.alias("line")).agg(F.sum("size").alias("size")))
    root = f"{len(counts) - 1}/0"
    plan = spark.range(1).select(F.lit(root).alias("line"), F.lit(n_rest).cast("long").alias("n"), F.lit(frame).cast("long").alias("period"))
    picks = rest.select(F.lit(root).alias("line"), "j", "slot", "release", "deadline")
    for level in reversed(levels):
        shares = _node_shares(level, plan.select(F.col("line").alias("node"), F.col("n").alias("slots")))
        inner = materialized(_node_schedules(shares), "mix-schedules")
        parent = plan.select(F.col("line").alias("node"), F.col("n").alias("pn"), "period")
        own = inner.join(parent, "node")
        for into, u in (("slot", F.col("slot")), ("release", F.col("release")), ("deadline", F.col("deadline") - 1)):
            at = picks.select(F.col("line").alias("node"), F.col("j").alias("_j"), F.col(into).alias("_at"))
            own = own.withColumn("_u", u).withColumn("_j", F.pmod("_u", "pn")).join(at, ["node", "_j"])
            own = own.withColumn(f"_{into}", F.col("_at") + F.floor(F.col("_u") / F.col("pn")) * F.col("period")).drop("_u", "_j", "_at")
        own = materialized(own, "mix-picks")
        plan = own.filter("j = 0").select("line", "n", (F.col("frame") / F.col("pn") * F.col("period")).cast("long").alias("period"))
        picks = own.select("line", "j", F.col("_slot").alias("slot"), F.col("_release").alias("release"), F.col("_deadline").alias("deadline"))
    turns = (plan.agg(F.max("period")).first()[0] or frame) // frame
    return plan, picks, turns


def capped_weights(sizes: list[tuple[str, int]], total: int, max_share: float | Fraction) -> dict[str, Fraction]:
    """Weights of the sources that a cap binds. sizes: the largest sources, largest first, of `total` in all.

    A capped source weighs max_share; the others share what is left in proportion to their size, and the cap
    applies to them again. At most 1 / max_share sources can be capped.
    """
    cap, left, rest, found = Fraction(max_share), Fraction(1), total, {}
    for source, size in sizes:
        if rest - size <= 0 or left * size <= cap * rest:
            break
        found[source] = cap
        left, rest = left - cap, rest - size
    return found


def _lines(sizes: DataFrame, weights: dict[str, float] | None, max_share: float, max_sources: int) -> list[tuple[str, int, Fraction]]:
    """(line, bytes, weight): a line for each of the largest sources, one for all others; at most max_sources."""
    if weights is not None:
        asked = [k for k, v in weights.items() if v > 0]
        found = {r["source"]: r["size"] for r in sizes.filter(F.col("source").isin(asked)).collect()}
        order = sorted(found, key=lambda k: (-weights[k], k))
        own = order if len(order) < max_sources else order[: max_sources - 1]
        lines = [(k, found[k], Fraction(weights[k])) for k in sorted(own)]
        others = [(found[k], Fraction(weights[k])) for k in order[len(own) :]]
        asks = sum(w for _, w in others)
        # As scarce as its scarcest source.
        return lines + ([(REST, asks * min(Fraction(b) / w for b, w in others), asks)] if others else [])
    total, n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    max_share = max(Fraction(max_share), Fraction(1, max(1, n)))  # n sources can't all stay below 1 / n
    top = [(r["source"], r["size"]) for r in sizes.orderBy(F.desc("size"), "source").limit(max_sources - 1).collect()]
    capped = capped_weights(top, total, max_share)
    rest = total - sum(size for source, size in top if source in capped)
    left = 1 - sum(capped.values())
    lines = [(s, size, capped.get(s, left * Fraction(size, max(1, rest)))) for s, size in top]
    pooled = total - sum(size for _, size in top)
    return lines + ([(REST, pooled, left * Fraction(pooled, max(1, rest)))] if pooled else [])


def whole_shares(weights: list[Fraction], frame: int) -> list[int]:
    """Whole numbers that sum to `frame` in proportion to the weights: one each, the rest by largest remainders."""
    free = frame - len(weights)
    quotas = [w / sum(weights) * frame for w in weights]
    extra = [max(Fraction(0), q - 1) for q in quotas]
    scaled = [x / max(sum(extra), Fraction(1)) * free for x in extra] if sum(extra) else [Fraction(free, len(weights))] * len(weights)
    whole = [int(x) for x in scaled]
    order = sorted(range(len(weights)), key=lambda i: (whole[i] - scaled[i], i))
    for i in order[: free - sum(whole)]:
        whole[i] += 1
    return [1 + n for n in whole]


def _hash(*columns: Column) -> Column:
    """Sixty even bits of an MD5."""
    text = F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 15), 16, 10).cast("long")


def spark_table(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    """Few rows (line, n, in_mix, blocks, period, or the first of them) as a table."""
    names = ["line", "n", "in_mix", "blocks", "period"][: len(rows[0]) if rows else 5]
    schema = "array<struct<" + ",".join(f"{k}:{'string' if k == 'line' else 'bigint'}" for k in names) + ">>"
    cells = [F.struct(*[F.lit(v) for v in row]) for row in rows]
    return docs.sparkSession.range(1).select(F.inline(F.array(*cells).cast(schema)))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, max_share: float = 0.25, block_bytes: int = 1 << 20,
    frame: int = 1024, max_sources: int = 512, seed: int = 11,
) -> DataFrame:
    """Every row of docs with the place it has in the mix.

    weights: target weight of each source (others stay out); without them, a source weighs what its bytes
    do, but at most max_share (the excess goes to the others in proportion); of n sources one may always have
    1 / n. The mix ends where the source that is scarcest against its weight has been used up once, so no row is
    repeated; with max_share=1 that is all sources, and every row has a place.

    Adds struct `mix`: in_mix (false: held back for a later mix, the other fields are null), slot (from 0;
    one block each), block (of its source, from 0), release, deadline (of the block, in slots) and place
    (order inside the block). Blocks hold about block_bytes of text each, dealt by a hash of id and text,
    which also splits a source that holds most of the rows. The smallest sources beyond max_sources share
    one line of the schedule, whose slots are dealt to them by frames of their own, so each has its own blocks and
    windows; the mix then has as many slots as that takes, with smaller blocks. Null source: a source of its own; null or empty text counts one byte; equal
    rows get equal places; a column named `mix` is replaced; no rows, no rows.
    """
    if weights is not None and len(weights) < frame:
        max_sources = max(max_sources, len(weights) + 1)
    if max_sources > frame:
        raise ValueError("a frame needs a slot for each source")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"]).alias("row"))
    size = F.greatest(F.coalesce(F.octet_length("row.text"), F.lit(0)), F.lit(1)).cast("long")
    rows = rows.withColumn("source", F.coalesce(F.col("row.source"), F.lit(NO_SOURCE)))
    sizes = rows.groupBy("source").agg(F.sum(size).alias("size"))
    lines = _lines(sizes, weights, max_share, max_sources)
    shares = whole_shares([w for _, _, w in lines], frame) if lines else []
    # Bytes a unit of weight, of the scarcest line: it is used up once, as are all that are as scarce.
    unit = min((Fraction(b) / w for _, b, w in lines), default=Fraction(1))
    frames = max(1, round(unit * sum(w for _, _, w in lines) / frame / block_bytes))
    nested = None
    known = [name for name, *_ in lines if name != REST]
    if len(known) < len(lines):
        own = frame_schedule(spark_table(docs, [(name, n) for (name, *_), n in zip(lines, shares)]), frame).filter(F.col("line") == REST)
        own = materialized(own.withColumn("j", F.col("j").cast("long")), "mix-rest")
        pooled = sizes.filter(~F.col("source").isin(known)).withColumnRenamed("source", "line")
        # What its slots are dealt by, and the bytes a unit of weight, beside the scarcest.
        ratio = F.lit(float(Fraction(lines[-1][1]) / lines[-1][2] / unit))
        if weights is not None:
            asked = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "line string, weight double")
            scarcest = F.lit(float(unit))
            pooled = pooled.join(asked, "line").select("line", F.col("weight").alias("size"), (F.col("size") / F.col("weight") / scarcest).alias("ratio"))
        else:
            pooled = pooled.withColumn("ratio", ratio)
        nested = nested_picks(pooled, pooled.count(), own, shares[-1], frame)
        frames = nested[2] * max(1, round(Fraction(frames, nested[2])))  # every source has whole periods
    # Blocks of a line: n in each frame of the mix, and as many more of the same size as are held back.
    plan = [(name, n, n * frames, round(n * frames * (Fraction(b) / w / unit)), frame) for (name, b, w), n in zip(lines, shares)]
    table = spark_table(docs, plan)  # at most max_sources rows
    picks = frame_schedule(table, frame).withColumn("j", F.col("j").cast("long"))  # `frame` rows
    if nested:
        in_mix = F.expr(f"n * {frames * frame}L div period")
        more = nested[0].join(pooled.select("line", "ratio"), "line")
        more = more.select("line", "n", in_mix.alias("in_mix"), F.round(in_mix * F.col("ratio")).cast("long").alias("blocks"), "period")
        table = table.filter(F.col("line") != REST).unionByName(more)
        picks = picks.filter(F.col("line") != REST).select("line", "j", "slot", "release", "deadline").unionByName(nested[1])
    small = F.broadcast if not nested else lambda x: x
    line = F.col("source") if nested else F.when(F.col("source").isin(known), F.col("source")) if known else F.lit(None)
    text_digest = F.md5(F.encode(F.coalesce(F.col("row.text"), F.lit("")), "utf-8"))
    dealt = (
        rows.withColumn("line", line.cast("string"))
        .join(small(table), "line", "left")
        .withColumn("key", _hash(F.col("row.doc_id"), text_digest, F.lit(seed)))
        .withColumn("block", F.pmod("key", "blocks"))
        .withColumn("chosen", F.coalesce(F.col("block") < F.col("in_mix"), F.lit(False)))
        .withColumn("j", F.when(F.col("chosen"), F.pmod("block", "n")))
    )
    turn = F.floor(F.col("block") / F.col("n")) * F.col("period")
    placed = dealt.join(small(picks), ["line", "j"], "left")
    fields = {
        "slot": F.col("slot") + turn, "block": F.col("block"), "release": F.col("release") + turn,
        "deadline": F.col("deadline") + turn, "place": F.col("key"),
    }
    found = [F.when(F.col("chosen"), c).cast("long").alias(k) for k, c in fields.items()]
    return placed.select("row.*", F.struct(F.col("chosen").alias("in_mix"), *found).alias("mix"))


def _mixes(docs: DataFrame, **options) -> DataFrame:
    """Mix after mix, each of what the one before held back, until nothing is left that has a weight.

    Every mix uses up a source, and no more of them than caps fit into a mix are held back: without weights there are
    at most 1 / max_share mixes, of four or more sources. The numbers of a later mix follow the slots before it.
    """
    done, first = None, 0
    while True:
        placed = materialized(mix(docs, **options), "mixes")
        held, last = placed.agg(F.count_if(~F.col("mix.in_mix")), F.max("mix.slot")).first()
        moved = [(F.col(f"mix.{k}") + F.lit(first)).cast("long").alias(k) for k in ("slot", "block", "release", "deadline")]
        found = placed.filter("mix.in_mix").withColumn("mix", F.struct(F.col("mix.in_mix").alias("in_mix"), *moved, F.col("mix.place").alias("place")))
        done = found if done is None else done.unionByName(found)
        if not held or last is None:
            return done
        docs, first = placed.filter(~F.col("mix.in_mix")).drop("mix"), first + last + 1


def mixed_documents(docs: DataFrame, later: bool = False, **options) -> DataFrame:
    """The rows of the mix in its order (slot, then place), with the columns of docs; a column `mix` there gets the place.

    later: what the mix holds back follows in later mixes, so every row has a place (with weights: of the sources in them).
    """
    own = docs.columns
    mixed = _mixes(docs, **options) if later else mix(docs, **options).filter("mix.in_mix")
    return mixed.orderBy("mix.slot", "mix.place").select(*[F.col(f"`{c}`") for c in own])
