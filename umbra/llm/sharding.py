"""K-d tree sharding to equal bytes.

Method: the rows are split recursively at distributed weighted medians along the widest metadata dimension, weights
being bytes, until each leaf holds one shard's target. A node that stands for k shards is split at floor(k/2)/k of its
bytes. The width of a dimension is its range in the node over its range in the table.

A split point is found by histograms: every open node's bracket is cut into ``BINS`` bins whose bytes are summed in one
aggregation for all nodes, and the bin that holds the split becomes the bracket. The order within a node is (dimension,
hash of the text, hash of the id), so ties, hot values and hot texts split as finely as needed; equal texts agree in
every dimension used by default and stay together unless their group holds more than ``GROUP_SHARE`` of a shard.

Slots are numbered by counting within sub-buckets of each shard, so no shard is sorted in one task.

Defined cases: a null text weighs one byte and counts as empty elsewhere; a null doc_id is hashed as null; rows are
told apart by their place where all else is equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from umbra.llm.runtime import Scratch

BINS = 1 << 14
TOLERANCE = 0.0005
GROUP_SHARE = 0.02
SLOT_ROWS = 20_000
KEYS = ("text_key", "row_key")


@dataclass
class Node:
    """A subtree that stands for `shards` shards from `first` on."""

    id: int
    first: int
    shards: int
    weight: int
    dim: str = ""
    order: list[str] = field(default_factory=list)
    fixed: list[int] = field(default_factory=list)
    lo: int = 0
    hi: int = 0
    below: int = 0
    left: Node | None = None
    right: Node | None = None


def _bounds(items: DataFrame, node: Column, dims: list[str]) -> dict[int, dict]:
    cols = [f(F.col(d)).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    return {r["node"]: r.asDict() for r in items.groupBy(node.alias("node")).agg(F.sum("weight").alias("weight"), *cols).collect()}


def _goes_left(n: Node) -> Column:
    """Order keys below the split point, component by component."""
    out = F.col(n.order[len(n.fixed)]) < n.hi
    for key, value in zip(reversed(n.order[: len(n.fixed)]), reversed(n.fixed), strict=True):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def _place(n: Node, leaf=lambda n: F.lit(n.id)) -> Column:
    if n.left is None:
        return leaf(n)
    return F.when(_goes_left(n), _place(n.left, leaf)).otherwise(_place(n.right, leaf))


def _search(items: DataFrame, place: Column, nodes: list[Node], slack: int, group: int) -> None:
    """Sets each node's split point; one aggregation a round for all of them."""
    open_ = list(nodes)
    while open_:
        want = {n.id: n.weight * (n.shards // 2) // n.shards for n in open_}
        value = bin_ = inside = F.lit(None)
        for n in open_:
            key = F.col(n.order[len(n.fixed)])
            width = max(1, -(-(n.hi - n.lo) // BINS))
            own = (F.col("node") == n.id) & (key >= n.lo) & (key < n.hi)
            for k, v in zip(n.order, n.fixed, strict=False):
                own = own & (F.col(k) == v)
            bin_ = F.when(own, F.floor((key - F.lit(n.lo)) / F.lit(width))).otherwise(bin_)
        counted = items.withColumn("node", place).withColumn("bin", bin_.cast("long")).where("bin is not null")
        rows = counted.groupBy("node", "bin").agg(F.sum("weight").alias("weight")).collect()  # at most BINS rows a node
        bins: dict[int, list] = {}
        for r in rows:
            bins.setdefault(r.node, []).append((r.bin, r.weight))
        still = []
        for n in open_:
            width = max(1, -(-(n.hi - n.lo) // BINS))
            run, lo, inside, after = n.below, n.lo, 0, n.hi
            for b, w in sorted(bins.get(n.id, [])):
                lo, after = n.lo + b * width, min(n.hi, n.lo + (b + 1) * width)
                if run + w >= want[n.id]:
                    inside = w
                    break
                run += w
            n.lo, n.below = lo, run
            if width > 1 and inside > slack:
                n.hi = after
                still.append(n)
            elif width == 1 and inside > (group if len(n.fixed) else slack) and len(n.fixed) < len(n.order) - 1:
                n.fixed.append(lo)
                n.lo, n.hi = -(1 << 62), 1 << 62
                still.append(n)
            else:
                # the whole bin goes to the side that leaves the smaller error
                n.hi = after if want[n.id] - run > run + inside - want[n.id] else lo
        open_ = still


def kd_shards(items: DataFrame, shards: int, dims: list[str]) -> tuple[Column, list[Node]]:
    """The shard of each row of a written table with the columns weight, text_key, row_key and the integer dims."""
    whole = _bounds(items, F.lit(1), dims)
    if not whole:
        return F.lit(0), []
    top = whole[1]
    root = Node(1, 0, shards, top["weight"])
    slack = max(1, int(top["weight"] / shards * TOLERANCE))
    group = max(1, int(top["weight"] / shards * GROUP_SHARE))
    level, leaves, ids = [root], [], 1
    while level := [n for n in level if n.shards > 1 or leaves.append(n)]:
        place = _place(root)
        bounds = whole if level == [root] else _bounds(items, place, dims)
        for n in level:
            b = bounds.get(n.id) or {f"{e}_{d}": 0 for d in dims for e in ("lo", "hi")} | {"weight": 0}
            n.weight = b["weight"]
            n.dim = max(dims, key=lambda d: (b[f"hi_{d}"] - b[f"lo_{d}"]) / max(1, top[f"hi_{d}"] - top[f"lo_{d}"]))
            n.order = [n.dim, *KEYS]
            n.lo, n.hi = b[f"lo_{n.dim}"], b[f"hi_{n.dim}"] + 1
        _search(items, place, level, slack, group)
        below = []
        for n in level:
            half = n.shards // 2
            n.left, n.right = Node(ids + 1, n.first, half, 0), Node(ids + 2, n.first + half, n.shards - half, 0)
            ids += 2
            below += [n.left, n.right]
        level = below
    return _place(root, lambda n: F.lit(n.first)), leaves


def slots(df: DataFrame, shard: str, key: str) -> DataFrame:
    """Adds slot: gapless from 0 in each shard. `df` is read twice; pass a written table."""
    subs = max(8, -(-df.count() // SLOT_ROWS))
    cut = df.withColumn("umbra_sub", F.pmod(F.col(key), F.lit(subs)))
    before = W.partitionBy(shard).orderBy("umbra_sub").rowsBetween(W.unboundedPreceding, -1)
    start = cut.groupBy(shard, "umbra_sub").count().select(shard, "umbra_sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("umbra_start"))
    inside = F.row_number().over(W.partitionBy(shard, "umbra_sub").orderBy(key))
    return (
        cut.withColumn("umbra_in", inside).join(start, [shard, "umbra_sub"])
        .withColumn("slot", (F.col("umbra_start") + F.col("umbra_in") - 1).cast("bigint")).drop("umbra_sub", "umbra_start", "umbra_in")
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Dimensions: size, lines and non-ASCII bytes, by eighth octaves."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    octave = lambda c: F.floor(F.log2(c + F.lit(1)) * 8).cast("long")
    size = F.octet_length(text).cast("long")
    items = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (size + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        octave(size).alias("d_size"),
        octave(F.length(text) - F.length(F.translate(text, "\n", ""))).alias("d_lines"),
        octave(size - F.length(text)).alias("d_accents"),
        F.shiftright(F.xxhash64(text), 2).alias("text_key"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumns({"weight": F.col("size"), "row_key": F.shiftright(F.xxhash64("doc_id", "place"), 2)})
    items = scratch.table(items, "items")
    shard, _ = kd_shards(items, shards, ["d_size", "d_lines", "d_accents"])
    placed = scratch.table(items.select("doc_id", "size", "text_crc32", "row_key", shard.cast("int").alias("shard")), "placed")
    return scratch.finish(slots(placed, "shard", "row_key").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    ))
