"""Exact self-join of shingle sets by Jaccard similarity, and its components.

Method: the size-aware heavy-light join. With the threshold at p percent, a set of n shingles overlaps any partner in
at least t = ceil(p n / 100) of them, so two partners share a shingle among the n - t + 1 first of each, and two among
the n - t + 2 first, under any one order of all shingles. Light sets (n up to the boundary) post every 2-subset of that
longer prefix and meet each other there. Heavy sets scan inverted lists of single prefix shingles, in which the light
sets just below the boundary are posted too. The boundary minimises the summed cost of posting and scanning, which
a histogram by size gives: subsets to post against list entries to scan.

The order puts rare shingles first. Frequencies come from one fixed-size counting sketch over all documents, whose
collisions change only the order's quality, never the result. Common passages so fall out of the prefixes.

Equal sets are joined by a fingerprint first; each class is represented by its smallest doc_id. In each list every
member is compared with the list's hub, the set with the fewest rarer shingles; then members which that left in
different components are compared with each other, the largest component of a list on one side only. No pair that
could join two components is left out, and n near copies of one text cost about n comparisons, not n**2. Comparison is
exact, on whole sets.

No task gets what grows with a list, a hub or a group of copies: hot keys join broadcast rows (at most HOT of them), a
hub's set is dealt to several tasks by the number of its pairs, and members are paired only within neighbouring bands
of size. Words, shingles and keys are 64-bit hashes: two texts of n and m shingles count a false common one with a
probability under n m / 2**64.

Defined cases: text null, empty or only white space: an empty set, linked with nothing. Fewer than k words: the whole
sequence is one shingle. Rows that share a doc_id are one node: their texts' links are all its own, and an empty text
among them has the node's component. A null doc_id: the row takes part in no link and has a null component. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.graph import Membership, components, without
from umbra.llm.runtime import HOT, Scratch, cut, keyed_join, lean
from umbra.llm.textops import mix, shingle_sets, texts_of

SKETCH_BITS, RANGES = 22, 64
#: A task counts about so many shingles at once.
HELD = 1 << 17
#: Bins of a set's outline, which counts its shingles by their last byte.
BINS = 256
_SALT = np.uint64(0xA24BAED4963EE407)


def least_overlap(n: int, percent: int) -> int:
    """ceil(percent * n / 100): what a set of n shares with any partner at least."""
    return -(-percent * n // 100)


def _tally(total: np.ndarray, held: list[np.ndarray]) -> None:
    """Counts slots where they lie in `total`: what this needs goes by the slots held, not by the sketch."""
    at, n = np.unique(np.concatenate(held), return_counts=True)
    total[at] += n.astype(np.uint32)


def _sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """Rank classes by the number of documents of each slot, over all documents; and what a rare shingle's slot holds.

    Tasks count all slots; the counts meet by ranges of slots, so no task merges whole sketches.
    """
    slots, shift = 1 << SKETCH_BITS, np.uint64(64 - SKETCH_BITS)
    width = slots // RANGES

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            held, size = [], 0
            for s in shingle_sets(texts_of(batch.column(0)), k):
                held.append((s >> shift).astype(np.uint32))
                size += len(s)
                if size > HELD:
                    _tally(total, held)
                    held, size = [], 0
            if held:
                _tally(total, held)
        for i in range(RANGES):
            part = total[i * width : (i + 1) * width]
            if part.any():
                yield pa.record_batch([pa.array([i]), pa.array([zlib.compress(part.tobytes(), 1)])], ["part", "counts"])

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = totals.setdefault(i, np.zeros(width, np.uint64))
                total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        for i, total in totals.items():
            rank = np.minimum(255, np.round(8 * np.log2(total.astype(np.float64) + 1))).astype(np.uint8)
            yield pa.record_batch([pa.array([i]), pa.array([rank.tobytes()]), pa.array([float(total.sum(dtype=np.float64))])], ["part", "ranks", "total"])

    parts = docs.select("text").mapInArrow(count, "part bigint, counts binary").repartition(RANGES, "part")
    rows = parts.mapInArrow(merge, "part bigint, ranks binary, total double").collect()  # at most one byte a slot
    ranks = np.zeros(slots, np.uint8)
    for r in rows:
        ranks[r.part * width : (r.part + 1) * width] = np.frombuffer(r.ranks, np.uint8)
    mean = sum(r.total for r in rows) / slots
    return ranks, mean + 3 * math.sqrt(mean)


def _sets(docs: DataFrame, k: int, percent: int, classes) -> DataFrame:
    """doc_id, n_shingles, fingerprint, prefix (rarest first, as hashes), the cost of scanning the prefix's lists, outline."""
    shift = np.uint64(64 - SKETCH_BITS)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, noise = classes.value
        for batch in batches:
            ids, n, fp, prefix, scan, outline = batch.column(0), [], [], [], [], []
            for s in shingle_sets(texts_of(batch.column(1)), k):
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s) * (100 - percent) >= percent:  # smaller sets have no partner but equal ones
                    take = min(len(s), len(s) - least_overlap(len(s), percent) + 2)
                    own = rank[(s >> shift).astype(np.int64)]
                    first = s[np.lexsort((s, own))[:take]]
                    prefix.append(first.tobytes())
                    held = 2.0 ** (rank[(first >> shift).astype(np.int64)] / 8)
                    scan.append(float(np.maximum(1.0, held - noise).sum()))
                    bins = np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
                    outline.append(bins.astype(np.uint8 if bins.max() < 256 else "<u4").tobytes())
                else:
                    prefix.append(None)
                    scan.append(0.0)
                    outline.append(None)
            yield pa.record_batch(
                [ids, pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(prefix, pa.binary()), pa.array(scan, pa.float64()), pa.array(outline, pa.binary())],
                ["doc_id", "n_shingles", "fp", "prefix", "scan", "outline"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, fp binary, prefix binary, scan double, outline binary")


def boundary(classes: DataFrame, percent: int) -> int:
    """The largest light size: least cost of subsets posted up to it and lists scanned above it, from a histogram."""
    step = F.floor(F.log2("n") * 4)
    # a histogram by quarter octaves of the size: at most a few hundred rows
    rows = classes.groupBy(step.alias("step")).agg(F.max("n").alias("top"), F.count("*").alias("sets"), F.sum("scan").alias("scan"), F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r.step)
    best, cost = 0, math.inf
    for b in [0, *(r.top for r in rows)]:
        light = sum(r.sets * math.comb(p, 2) for r in rows if r.top <= b for p in [round(r.n / r.sets) - least_overlap(round(r.n / r.sets), percent) + 2])
        heavy = sum(r.scan for r in rows if r.top >= percent * (b + 1) / 100)
        if light + heavy < cost:
            best, cost = b, light + heavy
    return best


def _postings(classes: DataFrame, percent: int, light: int) -> DataFrame:
    """(key, node, size_pos): subsets of light prefixes and single shingles of heavy ones and of those just below.

    size_pos holds the size and the shingle's place in the order; of a subset, one less than its second one's place,
    so that one formula bounds what the two sets can still share.
    """
    band = -(-percent * (light + 1) // 100)
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size_pos", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for node, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if n <= light:
                    i, j = np.triu_indices(len(s), 1)
                    lo, hi = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
                    out.append((mix(lo * _SALT + hi), node, n, j - 1))
                if n >= band:
                    own = s[:-1] if len(s) > 1 else s
                    out.append((own, node, n, np.arange(len(own))))
                size += len(out[-1][0])
                if size > 1 << 18:
                    yield _flat(out, schema)
                    out, size = [], 0
            if out:
                yield _flat(out, schema)

    return classes.select("node", "n", "prefix").mapInArrow(run, "key bigint, node bigint, size_pos bigint")


def _flat(parts: list, schema: pa.Schema) -> pa.RecordBatch:
    size = np.array([len(p[0]) for p in parts])
    keys = np.concatenate([p[0] for p in parts]).view(np.int64)
    node, n = (np.repeat(np.array([p[i] for p in parts], np.int64), size) for i in (1, 2))
    return pa.record_batch([pa.array(keys), pa.array(node), pa.array(n << 32 | np.concatenate([p[3] for p in parts]))], schema=schema)


def _possible(percent: int, n: str, pos: str, m: str, at: str):
    """Sizes allow a link, and so does what follows the pair's first common shingle (or two) in both prefixes."""
    need = F.expr(f"({percent}L * ({n} + {m}) + {99 + percent}) div {100 + percent}")
    left = F.expr(f"1 + least({n} - {pos} - 1, {m} - {at} - 1)")
    return F.expr(f"100L * least({n}, {m}) >= {percent}L * greatest({n}, {m})") & (left >= need)


def _dealt(rows: DataFrame, pairs: DataFrame, sets: DataFrame, node: str, other: str, words: str) -> DataFrame:
    """Rows, one for each pair, with the words of one of their nodes; a node with many pairs is dealt to several tasks."""
    load = pairs.groupBy(node).count()
    spread = max(256, pairs.count() // HOT)
    busy = F.broadcast(load.where(F.col("count") > spread).select(node, F.expr(f"int(count div {spread}) + 1").alias("parts")))  # HOT rows at most
    one = F.coalesce("parts", F.lit(1))
    left = rows.join(busy, node, "left").withColumn("deal", F.pmod(F.xxhash64(other), one).cast("int")).drop("parts")
    right = sets.where(f"is_{node}").select(F.col("node").alias(node), F.col("words").alias(words)).join(busy, node, "left")
    right = right.withColumn("deal", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    return left.join(right, [node, "deal"]).drop("deal")


def _compared(pairs: DataFrame, sides: DataFrame, held) -> DataFrame:
    """The pairs (a, b) of a written table for whose sides, as bytes, held(x, y) is true."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [held(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _dealt(_dealt(pairs, pairs, sides, "b", "a", "words_b"), pairs, sides, "a", "b", "words_a")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a bigint, b bigint")


def outlines_allow(percent: int):
    """Whether two sets can link by their outlines: in each bin they share no more than the smaller count."""

    def held(x: bytes, y: bytes) -> bool:
        x, y = (np.frombuffer(o, np.uint8 if len(o) == BINS else "<u4").astype(np.int64) for o in (x, y))
        most = int(np.minimum(x, y).sum())
        return 100 * most >= percent * (int(x.sum()) + int(y.sum()) - most)

    return held


def sets_link(percent: int):
    """Whether two whole sets link."""

    def held(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    return held


def _whole_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The nodes of a written table with their whole shingle sets; only their documents pass the filter before any shuffle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [s.tobytes() for s in shingle_sets(texts_of(batch.column(1)), k)]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.binary())], ["node", "words"])

    near = Membership(nodes, "node").near(docs, F.col("doc_id"))
    return near.select("doc_id", "text").mapInArrow(run, "node bigint, words binary").join(nodes, "node")


def _nodes(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs, and on which side they stand."""
    ends = [pairs.select(F.col(c).alias("node"), F.lit(c == "a").alias("is_a"), F.lit(c == "b").alias("is_b")) for c in ("a", "b")]
    return ends[0].union(ends[1]).groupBy("node").agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b"))


def _links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs of a written table that link: by their outlines first, so that few whole sets move."""
    nodes = scratch.table(_nodes(pairs), f"{name}_ends")
    known = sets.where("outline is not null").select(F.col("doc_id").alias("node"), F.col("outline").alias("words"))
    known = scratch.table(Membership(nodes, "node").near(known, F.col("node")).join(nodes, "node"), f"{name}_outlines")
    pairs = scratch.table(_compared(pairs, known, outlines_allow(percent)).distinct(), f"{name}_pairs")
    nodes = scratch.table(_nodes(pairs), f"{name}_nodes")
    whole = scratch.table(_whole_sets(docs, nodes, k), f"{name}_sets")
    linked = scratch.table(_compared(pairs, whole, sets_link(percent)), f"{name}_links")
    scratch.drop(f"{name}_sets")
    return linked


def _lists(groups: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the lists of two; key, node, n, pos and the hub of the longer lists.

    One aggregation tells all about a list of two, so its members needn't be fetched.
    """
    wide = groups.where("prefix is not null")
    postings = scratch.table(_postings(wide, percent, boundary(wide, percent)), "postings")
    found = postings.groupBy("key").agg(
        F.min("node").alias("a"), F.max("node").alias("b"), F.min("size_pos").alias("less"), F.max("size_pos").alias("more"), F.count("*").alias("rows"),
    ).where("a < b")
    found = scratch.table(found, "found_keys")
    ends = {f"{c}_{x}": F.expr(f"{x} {op}") for x in ("less", "more") for c, op in (("n", ">> 32"), ("pos", "& 4294967295"))}
    twos = found.where("rows = 2").withColumns(ends).where(_possible(percent, "n_less", "pos_less", "n_more", "pos_more")).select("a", "b").distinct()
    many = scratch.table(found.where("rows > 2").select("key", "rows"), "many")
    near = Membership(many, "key").near(postings, F.col("key"))  # most keys have one set: they needn't be shuffled again
    lists = keyed_join(near, many, "key").select("key", "node", F.expr("size_pos >> 32").alias("n"), F.expr("size_pos & 4294967295").alias("pos"))
    lists = scratch.table(lists, "shared")
    scratch.drop("postings")
    hubs = lists.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("hub"), F.count("*").alias("rows"))
    return twos, scratch.table(keyed_join(lists, scratch.table(hubs, "hubs"), "key"), "lists")


def _still_apart(lists: DataFrame, labels: DataFrame, star: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of one list whose components differ, one of them outside the list's largest, in bands of size that can link."""
    apart = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = scratch.table(apart.select("key", "node", "n", "pos", "label", F.col("hub.node").alias("hub")), "labelled")
    sizes = apart.groupBy("key", "label").count()
    most = sizes.groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels"), F.sum("count").alias("rows"))
    most = scratch.table(most.where("labels > 1").select("key", F.col("most.label").alias("main"), "rows"), "mains")
    band = F.floor(F.log("n") / (math.log(100 / percent) * 1.000001)).cast("int") if percent < 100 else F.col("n").cast("int")
    apart = scratch.table(keyed_join(apart, most, "key").where("node <> hub").withColumn("band", band), "apart")
    minor = apart.where("label <> main").select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "label")], F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    return (
        apart.join(minor, ["key", "band"])
        .where("label <> label_b and (label = main or node < node_b)")
        .where(_possible(percent, "n", "pos", "n_b", "pos_b"))
        .select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
        .join(star, ["a", "b"], "left_anti")
    )


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest doc_id reachable over links of `percent` or more."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50: below, partners may share less than two shingles of their prefixes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes = spark.sparkContext.broadcast(_sketch(docs, k))  # one byte a slot: 4 MiB
    sets = scratch.table(_sets(docs, k, percent, classes), "sets")
    classes.destroy()
    groups = scratch.table(
        sets.where("fp is not null and doc_id is not null").groupBy("fp")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").cast("int").alias("n"), F.first("prefix").alias("prefix"), F.first("scan").alias("scan"), F.count("*").alias("rows")),
        "groups",
    )
    # a doc_id of several texts is linked with the node of each
    several = sets.where("doc_id is not null").groupBy("doc_id").agg(*[f(F.xxhash64(F.coalesce("fp", F.lit(b"")))).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    several = scratch.table(several.where("lo <> hi").select("doc_id"), "several")
    node_of = groups.select("fp", "node", "rows")
    own = keyed_join(sets.where("fp is not null").select("doc_id", "fp").join(several, "doc_id", "left_semi"), node_of, "fp")
    own = scratch.table(own.where("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct(), "own")

    twos, lists = _lists(groups, percent, scratch)
    star = (
        lists.where(F.col("hub.node") != F.col("node"))
        .where(_possible(percent, "n", "pos", "hub.n", "hub.pos"))
        .select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).union(twos).distinct()
    )
    star = scratch.table(star, "star")
    linked = _links(star, docs, sets, k, percent, scratch, "star").union(own)
    labels = components(linked)
    rest = scratch.table(_still_apart(lists, labels, star, percent, scratch), "rest")
    if not rest.isEmpty():
        labels = components(linked.union(_links(rest, docs, sets, k, percent, scratch, "rest")))

    found = scratch.table(node_of.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"), "rows"), "found")
    texts = keyed_join(sets.where("fp is not null and doc_id is not null").select("doc_id", "n_shingles", "fp"), found, "fp").drop("fp")
    rest = sets.where("fp is null or doc_id is null").select("doc_id", "n_shingles").join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
    rest = rest.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return scratch.finish(texts.select("doc_id", "n_shingles", "component_id").union(rest))


def near_duplicates_dropped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without the near copies: of each component the row with the smallest doc_id stays.

    Rows with a null doc_id stay: they take part in no link. Of rows that share a doc_id, all stay or go.
    """
    gone = jaccard_components(docs, k, percent).where("component_id < doc_id").select("doc_id").distinct()
    gone = Scratch(docs.sparkSession, "near").table(gone, "gone")  # the result reads it
    return without(docs, gone, "doc_id")
