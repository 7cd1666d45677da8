"""Declared names as a relation, and one mapping for a whole fleet: both without a document fold.

``fleet_slots`` gives the result of first-come linear probing over all values, in parallel: every value asks for its
next candidate slot, each slot keeps the asker that came first and turns the others to their next slot, also one it kept
before. Since all slots prefer the same order, this ends in exactly what inserting the values one by one would give.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from umbra.functions import addresses as A
from umbra.functions.rewrite import java
from umbra.operators.lines import explode_lines, spread
from umbra.plans import rulebook as book
from umbra.plans.rendering import SpaceExhausted


def _named(family: str):
    return lambda v: F.struct(F.lit(family).alias("family"), F.trim(v, F.lit('";[]' if family == "domains" else '";')).alias("value"))


def declared(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, family, value, first_line: names that unscoped declarations give, each once a document without regard to case.

    Texts are dealt out by their keys, so all that follows stays in place and sorts no more rows than its share.
    """
    lines = explode_lines(spread(docs.select(*keys, text), *keys), *keys, text=text)
    found = []
    for (family, pattern) in book.COLLECTORS:
        raw = F.regexp_extract("line", java(pattern), 1)
        parts = F.filter(F.split(raw, r"[,\s]+"), lambda x: x != "") if family == "domains" else F.when(raw != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
        found.append(F.transform(parts, _named(family)))
    emails = F.regexp_extract_all("line", F.lit("(?U)" + book.EMAIL), F.lit(0))
    found.append(F.transform(emails, lambda v: F.struct(F.lit("emails").alias("family"), v.alias("value"))))
    found.append(F.transform(emails, lambda v: F.struct(F.lit("domains").alias("family"), F.substring_index(v, "@", -1).alias("value"))))
    rows = lines.select(*keys, "line_no", F.posexplode(F.concat(*found)).alias("at", "x")).select(*keys, "line_no", "at", "x.*").where("value <> ''")
    first = W.partitionBy(*keys, "family", F.lower("value")).orderBy("line_no", "at")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*keys, "family", "value", F.col("line_no").alias("first_line"))


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[[^-]*\])?$", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/umbra-{os.getpid()}")
    return df.checkpoint()


def fleet_slots(values: DataFrame, size: int) -> DataFrame:
    """value, slot for distinct values with `seed` (their first slot) and `rank` (a total order)."""
    held = values.count()
    if held > size:
        raise SpaceExhausted(f"{size} slots available, {held} needed")
    state = _cut(values.select("value", "rank", F.pmod(F.col("seed"), F.lit(size)).alias("slot")))
    while True:
        first = state.groupBy("slot").agg(F.min("rank").alias("best"))
        asked = _cut(state.join(first, "slot").withColumn("lost", F.col("rank") != F.col("best")))
        if asked.where("lost").isEmpty():
            return asked.select("value", "slot")
        state = asked.select("value", "rank", F.when(F.col("lost"), (F.col("slot") + 1) % size).otherwise(F.col("slot")).alias("slot"))


def fleet_networks(docs: DataFrame, salt: bytes, key: str = "doc_id", text: str = "text", pools: tuple[str, ...] = book.V4_POOLS) -> DataFrame:
    """original, pseudonym of every /24 in a corpus, as if one document after another (by key) had been sanitised together."""
    lines = explode_lines(docs, key, text=text).where(F.col("line").rlike(r"[0-9]\.[0-9]"))
    quads = lines.select(key, "line_no", F.posexplode(A.ipv4_candidates(F.col("line"))).alias("seq", "quad"))
    numbers = quads.withColumn("n", A.ipv4_number(F.col("quad"))).where(F.col("n").isNotNull() & ~A.mask_like(F.col("n")))
    nets = numbers.groupBy((F.col("n") - F.col("n") % 256).alias("net")).agg(F.min(F.struct(key, "line_no", "seq")).alias("rank"))
    asked = nets.select(F.col("net").alias("value"), "rank", A.ipv4_seed(F.col("net"), salt, pools).alias("seed"))
    slots = fleet_slots(asked, A.pool_size(pools))
    return slots.select(A.ipv4_text(F.col("value")).alias("original"), A.ipv4_text(A.pool_slot(F.col("slot"), pools)).alias("pseudonym"))


def clashes(numbers: Column, pools: tuple[str, ...] = book.V4_POOLS) -> Column:
    """Whether a kept address lies inside a pseudonym pool."""
    out = F.lit(False)
    for p in pools:
        out = out | A.within(numbers, p)
    return out
