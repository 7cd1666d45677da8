"""Quality classification of whole texts.

Method: naive Bayes support vectors. A text's indicators of hashed byte n-grams (one to four bytes) and of repeated
words are scaled by the log-count ratios of the two classes, scaled to unit length by their number, and a linear
hinge-loss model is fitted by dual coordinate descent; the two fold into one weight for each n-gram. Margins of rows
that a fold left out calibrate the score, with the classes weighted back to their share among the labels.

Fitted on at most ``PER_CLASS`` rows of each class, drawn by a hash of the id from labelled rows that are not held out,
and on the first of them that hold ``SLOTS`` n-grams together (one row at least).

Defined cases: a null text counts as empty and scores as one without n-grams; rows with a null label are not learned
from; of several labels of a row each counts once; if a class has no row, the score is the share of label 1 (0.5 with no
label at all); a null doc_id stays; repeated rows are scored each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.linear import dual_coordinate_descent, logistic, margins
from umbra.llm.runtime import Scratch, bounded, lean, remainder, ship
from umbra.llm.textops import slices, texts_of, words_of

PER_CLASS, SLOTS, BITS, THRESHOLD, SMOOTH = 2500, 6_000_000, 17, 0.3, 1.0
#: Slots of n-grams, then one for each power of two of repeated words.
SIZE, REPEATS = (1 << BITS) + 32, 1 << BITS


def indicators(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram slots of each text."""
    shift, seen = np.uint32(32 - BITS), np.zeros(SIZE, bool)  # n-grams hash into the first 1 << BITS
    for a, b in slices(texts):
        part = texts[a:b]
        buf = np.frombuffer(b"\n".join([*part, b"\n\n\n\n"]), np.uint8).astype(np.uint32)
        grams, key = [], np.zeros(len(buf) - 4, np.uint32)
        for n in range(4):
            key = key << np.uint32(8) | buf[n : len(buf) - 4 + n]
            grams.append(((key + np.uint32(n + 1)) * np.uint32(2654435761)) >> shift)
        words, bound = words_of(part, fold=False)
        again = words[1:] == words[:-1]
        at = 0
        for i, t in enumerate(part):
            for n, g in enumerate(grams):
                seen[g[at : at + max(0, len(t) - n)]] = True
            run = again[bound[i] : max(bound[i], bound[i + 1] - 1)]
            if run.any():
                seen[REPEATS + int(np.log2(run.sum()))] = True
            nz = np.flatnonzero(seen)
            seen[nz] = False
            yield nz.astype(np.int32)
            at += len(t) + 1


def _unit(slots: np.ndarray) -> float:
    return 1 / np.sqrt(max(1, len(slots)))


def fit(sets: list[np.ndarray], labels: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weight of each slot, bias) such that sigmoid(sum of weights / sqrt(number) + bias) estimates P(label 1)."""

    def ratios(rows: np.ndarray) -> np.ndarray:
        counts = []
        for label in (1, 0):
            own = [sets[i] for i in rows.tolist() if labels[i] == label]
            c = np.bincount(np.concatenate([*own, np.zeros(0, np.int32)]), minlength=SIZE) + SMOOTH
            counts.append(c / (len(own) + 2 * SMOOTH))
        return np.log(counts[0] / counts[1])

    def train(rows: np.ndarray) -> np.ndarray:
        r = ratios(rows)
        data = [(sets[i], r[sets[i]] * _unit(sets[i])) for i in rows.tolist()]
        w = dual_coordinate_descent(data, np.where(labels[rows] == 1, 1.0, -1.0), SIZE)
        w[:-1] *= r
        return w

    every = np.arange(len(sets))
    out = np.zeros(len(sets))
    for fold in (0, 1):
        left = every % 2 == fold
        w = train(every[~left])
        out[left] = margins([(sets[i], np.full(len(sets[i]), _unit(sets[i]))) for i in every[left].tolist()], w)
    weight = np.where(labels == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum())) * len(labels)
    a, b = logistic(out, (labels == 1).astype(float), weight)
    w = train(every)
    return (w[:-1] * a).astype(np.float32), float(w[-1] * a + b)


def quality_of(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows whose crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (remainder("doc_id", 5) != 0)).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    weights, bias = np.zeros(SIZE, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if len(counts) == 2:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
        share = F.when(F.col("label") == 1, int(min(1, PER_CLASS / counts[1]) * (1 << 31))).otherwise(int(min(1, PER_CLASS / counts[0]) * (1 << 31)))
        sample = known.where(place < share)  # about PER_CLASS distinct ids of each label

        @lean
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [s.tobytes() for s in indicators(texts_of(batch.column(2)))]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["label", "place", "slots"])

        scratch = Scratch(spark, "quality")
        joined = docs.where("doc_id is not null").join(F.broadcast(sample), "doc_id").select("label", place.alias("place"), "text")
        rows = scratch.table(joined.mapInArrow(sets, "label int, place bigint, slots binary"), "rows")
        kept = bounded(rows, "label", ["place", "slots"], F.octet_length("slots") / 4, PER_CLASS, SLOTS)
        scratch.drop()
        kept.sort(key=lambda r: (r.place, r.label, r.slots))
        y = np.array([r.label for r in kept], np.int64)
        if min((y == 0).sum(), (y == 1).sum()) >= 2:
            weights, bias = fit([np.frombuffer(r.slots, np.int32) for r in kept], y, prior)
    held = spark.sparkContext.broadcast((weights, bias))

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            m = np.array([float(weights[s].sum(dtype=np.float64)) * _unit(s) + bias for s in indicators(texts_of(batch.column(1)))])
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30))), pa.float64())], ["doc_id", "score"])

    found = docs.mapInArrow(score, "doc_id bigint, score double")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
