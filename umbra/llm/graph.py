"""Bitmaps of keys, which filter rows before a shuffle, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.runtime import cut

#: A bitmap is broadcast, so it has 32 MiB at most; more keys than a quarter of its bits go without one.
MOST_BITS, BUCKET = 1 << 28, 1 << 15


class Membership:
    """A bitmap of the hashed keys of a written table, 32 bits or more a key until `MOST_BITS`; none beyond that."""

    def __init__(self, keys: DataFrame, *columns: str):
        n = keys.count()
        self.bits = max(BUCKET, min(MOST_BITS, 1 << max(0, 32 * n - 1).bit_length()))
        self.bitmap = None
        if 4 * n <= self.bits:
            at = self._place(*[F.col(c) for c in columns])
            self.bitmap = (
                keys.select(at.alias("at")).groupBy(F.expr(f"at div {BUCKET}").alias("bitmap_bucket"))
                .agg(F.expr(f"bitmap_construct_agg(at % {BUCKET})").alias("bitmap"))
            )

    def _place(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.bits))

    def flagged(self, df: DataFrame, *key: Column) -> DataFrame:
        """df with umbra_maybe: false for rows whose key is surely not among the keys."""
        if self.bitmap is None:
            return df.withColumn("umbra_maybe", F.lit(True))
        named = df.withColumns({"bitmap_at": self._place(*key)}).withColumn("bitmap_bucket", F.expr(f"bitmap_at div {BUCKET}"))
        byte = F.expr(f"cast(conv(hex(substring(bitmap, cast((bitmap_at % {BUCKET}) div 8 + 1 as int), 1)), 16, 10) as int)")
        bit = F.expr(f"cast((bitmap_at % {BUCKET}) % 8 as int)")
        joined = named.join(F.broadcast(self.bitmap), "bitmap_bucket", "left")
        maybe = F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
        return joined.withColumn("umbra_maybe", maybe).drop("bitmap_at", "bitmap_bucket", "bitmap")

    def near(self, df: DataFrame, *key: Column) -> DataFrame:
        """Rows of df whose key may be among the keys: none of those is lost, few others stay."""
        return self.flagged(df, *key).where("umbra_maybe").drop("umbra_maybe")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key isn't in `gone`, a written table of distinct keys; null keys stay.

    Only rows that the bitmap can't clear are shuffled. (The planner would move an anti join below the bitmap, and
    shuffle all rows; an outer join stays above it.)
    """
    flagged = Membership(gone, key).flagged(df, F.col(key))
    listed = gone.select(F.col(key).alias("umbra_gone"))
    checked = flagged.where("umbra_maybe").join(listed, F.col(key) == F.col("umbra_gone"), "left").where("umbra_gone is null")
    return flagged.where("not umbra_maybe").select(*df.columns).unionByName(checked.select(*df.columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): label is the smallest node of its component.

    Each round hooks a node, and the node that its label names, to the smallest label next to it, and then follows each
    label's own label, until nothing changes. As roots are hooked too, whole trees merge in a round: the rounds grow with
    the logarithm of a chain's length, in whatever order its nodes stand. Aggregations combine before they shuffle, so a
    hub's edges never meet in one task. `edges` is read each round: pass a table.
    """
    spark: SparkSession = edges.sparkSession
    both = edges.select(F.col("a"), F.col("b")).union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = cut(both)
    if both.isEmpty():
        return spark.createDataFrame([], "node bigint, label bigint")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        less = labels.join(near, labels.node == near.a).where("near < label")
        hooks = less.select(F.explode(F.array("node", "label")).alias("hook"), "near").groupBy("hook").agg(F.min("near").alias("near"))
        hooked = cut(
            labels.join(hooks, labels.node == hooks.hook, "left")
            .select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        )
        up = hooked.select(F.col("node").alias("up_node"), F.col("label").alias("up"))
        moved = cut(
            hooked.join(up, F.col("label") == F.col("up_node"), "left")
            .select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        )
        done = moved.where("old <> label").isEmpty()
        labels = moved.select("node", "label")
        if done:
            return labels
