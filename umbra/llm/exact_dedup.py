"""Exact deduplication with durable keyed state.

Method: stateful streaming deduplication. Each text is normalised (runs of ``\\x20 \\x09-\\x0D`` become one space) and
digested; a streaming aggregation keeps, for each digest and without expiry, the smallest stable identifier, the
content locator of its row (file and position) and the number of rows, in RocksDB state on disk with its log in the
ledger's folder. A ledger can outlive a run: later tables meet the digests that it retains.

Full bytes are checked on hits: the rows of each shared digest are reduced to their least and greatest text before any
shuffle, and both must equal, byte for byte, the text at the state's locator, in whatever table that lies. Where they
differ, the digest's rows are regrouped by their whole text. Everything is DataFrame operations.

A hot digest never brings its rows into one task: the state, its check and its rows' decisions combine before they
shuffle or join a broadcast row.

Defined cases: a null text counts as empty; a null doc_id sorts after all others, and if all ids of a group are null,
keep_id is null and one row stays; of repeated rows with one doc_id one stays; an empty table gives no rows; other
columns are ignored. A later table's row with a smaller doc_id takes over from the one that the ledger kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.graph import Membership, without
from umbra.llm.runtime import PLACE, PLACE_TYPE, Scratch, cut, keyed_join

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no space set aside for each of many small stores
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # all stores of an executor share one bound
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",  # what a store sets aside goes by this
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of ended runs are closed this often
}
FOUND = f"{PLACE} {PLACE_TYPE}, doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", PLACE)


def keyed_state(digests: DataFrame) -> DataFrame:
    """The state to keep for each digest of a stream (or table) of doc_id, place, digest: works on both kinds alike."""
    return digests.groupBy("digest").agg(F.min(_first()).alias("first"), F.count("*").alias("group_size"))


class Ledger(Scratch):
    """Retained digests under a folder of one's own, or one of the run in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        super().__init__(spark, "ledger")
        self.retained, self.path = folder is not None, folder or self.path

    def stream(self, source: DataFrame) -> DataFrame:
        """Runs the stateful query over what the streaming source has new; the newest state of each digest so far."""
        held = {k: self.spark.conf.get(k, None) for k in STORE}
        for k, v in STORE.items():
            self.spark.conf.set(k, v)
        try:
            def keep(batch: DataFrame, number: int) -> None:
                batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/state/n{number}")

            state = keyed_state(source)
            running = (
                state.writeStream.outputMode("update").foreachBatch(keep)
                .option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start()
            )
            running.awaitTermination()
        finally:
            for k, v in held.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        schema = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
        updates = self.spark.read.schema(schema).parquet(f"{self.path}/state/*")
        return updates.groupBy("digest").agg(F.max_by(F.struct("first", "group_size"), "batch").alias("x")).select("digest", "x.*")

    def add(self, docs: DataFrame, digest=sha256) -> DataFrame:
        """PLACE, doc_id, keep_id, group_size, kept, text_sha256 for each row of docs, which has a place for each."""
        run = Scratch(self.spark, "dedup")
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), PLACE, normalised(F.col("text")).alias("norm"))
        new = texts.select("doc_id", PLACE, digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256"))
        own = f"{self.path}/digests/{uuid.uuid4().hex}"
        new.write.parquet(own)
        log, every = (self.spark.read.schema(new.schema).parquet(x) for x in (own, f"{self.path}/digests/*"))
        if log.isEmpty():
            return self.spark.createDataFrame([], FOUND)
        state = self.stream(self.spark.readStream.schema(new.schema).parquet(f"{self.path}/digests/*"))
        if self.retained:
            state = state.join(log.select("digest").distinct(), "digest", "left_semi")
        state = run.table(state, "groups")
        differ = self._differing(every, state, run, digest)

        found = [PLACE, "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("first") == _first()).alias("kept"), "text_sha256"]
        whole = keyed_join(log, state.withColumn("rows", F.col("group_size")), "digest").select(*found, "digest")
        if not differ.isEmpty():
            # digests that different texts share: group these rows by the whole text, which its sha256 stands for no more
            rows = self._texts(every.join(differ, "digest", "left_semi"), run, "collisions")
            groups = rows.groupBy("norm").agg(F.min(_first()).alias("first"), F.count("*").alias("group_size"))
            fixed = rows.join(groups, "norm").select(*found, "digest").join(log.select(PLACE), PLACE, "left_semi")
            whole = whole.join(differ, "digest", "left_anti").unionByName(fixed)
        return run.finish(whole.drop("digest"))

    def _stored(self, rows: DataFrame, run: Scratch) -> DataFrame:
        """Place and normalised text of what the tables hold near the places of `rows`, a written table."""
        files = [r.file for r in rows.select(F.col(f"{PLACE}.file").alias("file")).distinct().collect()]  # names of the tables' files
        if not files:
            return self.spark.createDataFrame([], f"at {PLACE_TYPE}, norm string")
        stored = run.located(self.spark.read.schema("text string").parquet(*files), "stored")
        return Membership(rows, PLACE).near(stored, F.col(PLACE)).select(F.col(PLACE).alias("at"), normalised(F.col("text")).alias("norm"))

    def _texts(self, rows: DataFrame, run: Scratch, name: str) -> DataFrame:
        """The rows with their normalised text, read at their places."""
        rows = run.table(rows, name)
        return run.table(self._stored(rows, run).join(rows, F.col("at") == F.col(PLACE)).drop("at"), f"{name}-texts")

    def _differing(self, log: DataFrame, state: DataFrame, run: Scratch, digest) -> DataFrame:
        """Digests whose rows hold another text than the one at the state's locator."""
        shared = run.table(state.where("group_size > 1").select("digest", F.col(f"first.{PLACE}").alias(PLACE), F.col("group_size").alias("rows")), "shared")
        kept = self._texts(shared, run, "keepers").select("digest", F.col("norm").alias("kept_norm"))
        hits = run.table(keyed_join(log.select("digest", PLACE), shared.select("digest", "rows"), "digest").select(PLACE), "hits")
        near = self._stored(hits, run).withColumn("digest", digest(F.col("norm")))
        ends = near.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
        return cut(ends.join(kept, "digest").where("least <> kept_norm or greatest <> kept_norm").select("digest"))


def dedup(docs: DataFrame, digest=sha256, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row.

    `folder` holds the state of earlier tables and keeps it; by default the state goes when the table is done. `digest`
    can be replaced (weaker ones for tests).
    """
    ledger = Ledger(docs.sparkSession, folder)
    whole = ledger.add(ledger.located(docs, "rows"), digest).drop(PLACE)
    if folder is None:
        ledger.drop()
    return whole


def duplicates_dropped(docs: DataFrame) -> DataFrame:
    """The rows that the operator marks as kept: one of each group of equal texts, whatever the doc_ids."""
    ledger, own = Ledger(docs.sparkSession), Scratch(docs.sparkSession, "distinct")
    rows = own.located(docs, "rows")
    gone = own.table(ledger.add(rows).where("not kept").select(PLACE), "gone")  # the result reads it
    ledger.drop()
    return without(rows, gone, PLACE).select(*docs.columns)
