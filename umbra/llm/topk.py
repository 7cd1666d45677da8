"""Exact top-k by inner product from sorted lists.

Method: no-random-access aggregation. Vectors lie in blocks, each with one sorted list of (vector, component) for every
dimension. A query reads each list from the end where its contribution is largest, all lists step by step to the same
depth, and adds every entry read to its vector's sum. What a vector's unread lists can add lies between the list's far
end and the last entry read, so sum and bounds give a lower and an upper score for each vector, and the last entries
alone an upper score for all vectors not yet seen. Reading stops when no outsider can reach the k-th largest lower score;
the lists are then read on, in order, for the entries of the few candidates left, which resolves their scores.

Blocks stay where they are. Queries go to them in chunks of at most ``CHUNK`` components, the only thing broadcast. Each
query is first run against one block, dealt by hash; the k-th best score there is a lower score that all other blocks
start with. The k best of every block are merged, which is exact. Nothing grows in a task: a block has at most about
``BLOCK`` components.

Defined cases: vectors that are null or hold a null, NaN or infinity take no part; vectors of different length aren't
compared; a query's own row is no candidate; ties go to the smaller vec_id; rows that repeat a vec_id are candidates
each, and queries each, with a result of its own; a null vec_id takes no part; an empty table gives no rows; other
columns are ignored. Scores are exact while sums stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from umbra.llm.runtime import Scratch, lean, release

BLOCK, CHUNK, STEPS = 1 << 18, 1 << 20, 16


class Lists:
    """A block's sorted lists: for each dimension the vectors' places, and their components, largest first."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.width = vectors.shape
        self.place = np.ascontiguousarray(np.argsort(-vectors.T, 1, kind="stable"))
        self.value = np.take_along_axis(np.ascontiguousarray(vectors.T), self.place, 1)
        #: how far from the top of each list a vector's entry stands: what marks it as read at a depth
        self.depth = np.empty((self.n, self.width), np.int32)
        np.put_along_axis(self.depth, self.place.T, np.arange(self.n, dtype=np.int32)[:, None], 0)

    def part(self, query: np.ndarray, up: np.ndarray, down: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and contributions of the entries between two depths, of lists read from the top and from the bottom."""
        n = self.n
        place = np.concatenate([self.place[up, a:b].ravel(), self.place[down, n - b : n - a].ravel()])
        gain = np.concatenate([(self.value[up, a:b] * query[up, None]).ravel(), (self.value[down, n - b : n - a] * query[down, None]).ravel()])
        return place, gain

    def edge(self, query: np.ndarray, up: np.ndarray, down: np.ndarray, at: int) -> np.ndarray:
        """Contribution of each list's entry at a depth."""
        return np.concatenate([self.value[up, at] * query[up], self.value[down, self.n - 1 - at] * query[down]])

    def seen(self, rows: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> np.ndarray:
        """Which lists have shown each of the rows at this depth."""
        own = self.depth[rows]
        return np.concatenate([own[:, up] < depth, own[:, down] >= self.n - depth], 1).astype(np.float64)


def top_k(lists: Lists, query: np.ndarray, k: int, floor: float = -np.inf, own: int = -1) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(rows, scores, depth, entries read): every row that can be among the k best and reaches `floor`, ties included.

    The depth is the one at which no outsider could qualify any more; entries count those read to resolve scores, too.
    """
    n, up, down = lists.n, np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    total, rows = np.zeros(n), np.delete(np.arange(n), own) if own >= 0 else np.arange(n)
    step, depth, dims = max(1, -(-n // STEPS)), 0, len(up) + len(down)
    if not dims:
        return (rows, total[rows], 0, 0) if floor <= 0 else (rows[:0], total[:0], 0, 0)
    far, few = lists.edge(query, up, down, n - 1), max(4 * k, n // 32)
    while depth < n and len(rows):
        reach = min(n, depth + step)
        place, gain = lists.part(query, up, down, depth, reach)
        total += np.bincount(place, gain, n)
        depth = reach
        if depth == n:
            break
        near = lists.edge(query, up, down, depth - 1)
        if floor == -np.inf and 2 * depth < n or near.sum() >= floor > -np.inf:
            continue  # a vector that no list has shown yet may still qualify
        rows = rows[total[rows] + np.maximum(near, 0).sum() >= floor]  # a bound that needs no look at what each has shown
        if floor > -np.inf and 4 * len(rows) > n:
            continue
        seen = lists.seen(rows, up, down, depth)
        base = total[rows]
        upper, lower = base + near.sum() - seen @ near, base + far.sum() - seen @ far
        if len(lower) >= k:
            floor = max(floor, float(np.partition(lower, len(lower) - k)[len(lower) - k]))
        rows = rows[upper >= floor]
        if near.sum() < floor and len(rows) <= few:
            break
    end = depth
    if depth < n and len(rows):  # read on for the entries of what is left
        wanted = np.zeros(n, bool)
        wanted[rows] = True
        while end < n and not lists.seen(rows, up, down, end).all():
            reach = min(n, end + 2 * step)
            place, gain = lists.part(query, up, down, end, reach)
            hit = wanted[place]
            total += np.bincount(place[hit], gain[hit], n)
            end = reach
    rows = rows[total[rows] >= floor]
    return rows, total[rows], depth, end * dims


def _packed(df: DataFrame) -> DataFrame:
    """One row for each block of a width: its rows' numbers, ids and components."""

    def run(table: pa.Table) -> pa.Table:
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        number, ids = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("number", "vec_id"))
        release()
        return pa.table({"width": table.column("width").slice(0, 1), "block": table.column("block").slice(0, 1), "numbers": pa.array([number], pa.binary()), "ids": pa.array([ids], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary())})

    return df.groupBy("width", "block").applyInArrow(run, "width int, block bigint, numbers binary, ids binary, vectors binary")


def _asked(blocks: DataFrame, queries: dict, k: int, first: bool) -> DataFrame:
    """number, query_id, vec_id, score of each block's k best; with `first`, from one block for each query. A row without vec_id says what was read."""
    held = blocks.sparkSession.sparkContext.broadcast(queries)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number, ids = np.frombuffer(row["numbers"], np.int64), np.frombuffer(row["ids"], np.int64)
                asks = held.value.get(row["width"])
                if asks is None:
                    continue
                lists, place = Lists(np.frombuffer(row["vectors"]).reshape(len(ids), row["width"])), {x: i for i, x in enumerate(number.tolist())}
                share, out = row["block"], []
                for i, (ask, vec) in enumerate(zip(asks["numbers"].tolist(), asks["vectors"], strict=True)):
                    if first and ask % asks["blocks"] != share:
                        continue
                    rows, score, depth, reads = top_k(lists, vec, k, asks["floors"][i], place.get(ask, -1))
                    best = np.lexsort((ids[rows], -score))[:k]
                    out += [(ask, int(asks["ids"][i]), int(ids[rows[b]]), int(score[b]), None, None) for b in best.tolist()]
                    out.append((ask, int(asks["ids"][i]), None, None, depth / lists.n, reads))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.float64(), pa.int64()), strict=True)], names)

    names = ["number", "query_id", "vec_id", "score", "depth", "reads"]
    return blocks.mapInArrow(run, "number bigint, query_id bigint, vec_id bigint, score bigint, depth double, reads bigint")


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score over the integer vectors floor(scale * x); depth and reads of the query's lists.

    depth: the share of the lists after which no outsider could qualify, on the average of the blocks; reads: entries
    read in all, to resolve the scores as well.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = scratch.table(
        vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
        .select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("width"), F.coalesce(is_query, F.lit(False)).alias("asks"),
            F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"), F.monotonically_increasing_id().alias("number"),
        ),
        "vectors",
    )
    sizes = whole.groupBy("width").agg(F.count("*").alias("rows"), F.count_if("asks").alias("asked")).where("asked > 0").collect()  # a row a width
    parts = [(r.width, max(1, -(-r.rows * r.width // BLOCK)), max(1, -(-r.asked * max(16, r.width) // CHUNK))) for r in sizes]
    widths = spark.createDataFrame(parts, "width int, blocks bigint, chunks bigint")
    dealt = whole.join(widths, "width").withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")))
    many = min(20_000, sum(p[1] for p in parts))  # tasks, one for each block where these are no more
    blocks = scratch.table(_packed(dealt), "blocks").repartition(max(1, many))
    asks = dealt.where("asks").withColumn("chunk", F.pmod(F.xxhash64("number", F.lit(1)), F.col("chunks")))
    found = []
    for i in range(max((p[2] for p in parts), default=0)):
        queries: dict = {}
        for r in asks.where(F.col("chunk") == i).orderBy("number").collect():  # CHUNK components of a width at most
            own = queries.setdefault(r.width, {"blocks": r.blocks, "numbers": [], "ids": [], "vectors": []})
            own["numbers"].append(r.number)
            own["ids"].append(r.vec_id)
            own["vectors"].append(r.v)
        for own in queries.values():
            own |= {"numbers": np.array(own["numbers"], np.int64), "ids": np.array(own["ids"], np.int64), "vectors": np.array(own["vectors"], np.float64).reshape(len(own["ids"]), -1)}
            own["floors"] = np.full(len(own["ids"]), -np.inf)
        if any(own["blocks"] > 1 for own in queries.values()):
            floors = _asked(blocks, queries, k, True).where("vec_id is not null").groupBy("number").agg(F.min("score").alias("least"), F.count("*").alias("held"))
            least = {r.number: r.least for r in floors.where(F.col("held") >= k).collect()}  # a row a query
            for own in queries.values():
                own["floors"] = np.array([least.get(x, -np.inf) for x in own["numbers"].tolist()], np.float64)
        found.append(scratch.table(_asked(blocks, queries, k, False), f"found{i}"))
    if not found:
        return scratch.finish(spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint, depth double, reads bigint"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    cost = every.where("vec_id is null").groupBy("number").agg(F.avg("depth").alias("depth"), F.sum("reads").alias("reads"))
    best = every.where("vec_id is not null").drop("depth", "reads")
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return scratch.finish(best.join(cost, "number").select("query_id", "rank", "vec_id", "score", "depth", "reads"))
