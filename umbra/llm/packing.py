"""Vector bin packing of token pieces into fixed-length sequences.

Method: the dot-product heuristic. A sequence has limits on tokens, on segments and on loss-bearing tokens. The open
sequence takes, among the pieces that still fit in every dimension, the one whose demand vector has the largest dot
product with what the sequence has left, each dimension scaled by its limit and weighted by the group's mean demand.

Pieces are dealt by a hash of their identity into groups of about ``GROUP`` pieces; each group is packed by itself, so
a hot source spreads evenly, memory is bounded by the group, and a lost executor only repeats its groups. Each group
leaves one partly filled sequence at most per exhausted limit, a share that shrinks with the group's size.

Defined cases: a null or empty text is a document of the end token alone; repeated rows are packed each by itself; a
null doc_id stays null; an empty table gives no rows; other columns are ignored. Documents longer than a sequence are
cut at multiples of the limit, so each token lies in exactly one piece. A null role bears no loss.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.runtime import Scratch, lean, release, ship
from umbra.llm.textops import slices, texts_of
from umbra.llm.wordbpe import coder

GROUP = 4000
TOKENS, SEGMENTS = 4096, 512
ENCODE_BYTES = 1 << 20
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def encode_pieces(docs: DataFrame, vocabulary: str, end_id: int, most: int = TOKENS) -> DataFrame:
    """Encodes whole texts once and cuts each at multiples of `most`; one row for each piece."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    ship(docs.sparkSession)

    @functools.partial(lean, keeps=coder.__module__)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in slices(texts, ENCODE_BYTES):
                rows = []
                tokens, bound = words.encode(texts[a:b])
                for doc, lo, hi in zip(ids[a:b], bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    own = np.append(tokens[lo:hi], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), most):
                        part = own[start : start + most]
                        rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(own)))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECE)


def dot_product_bins(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, position in the order of placement) of each row of `demand`, none of which exceeds `limits`."""
    n = len(demand)
    bins, order = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    share = demand / limits
    weight = share.mean(0) if n else limits
    keys = np.lexsort(tuple(-demand[:, d] for d in range(demand.shape[1] - 1, -1, -1)))
    left, share = demand[keys], share[keys] * weight
    alive, row, placed, current = np.ones(n, bool), keys, 0, 0
    room = limits.astype(np.float64)
    while placed < n:
        fits = alive & (left <= room).all(1)
        if not fits.any():
            current, room = current + 1, limits.astype(np.float64)
            if alive.sum() < 0.6 * len(alive):  # drop what is placed from the scan
                left, share, row, alive = left[alive], share[alive], row[alive], np.ones(int(alive.sum()), bool)
            continue
        at = int(np.where(fits, share @ (room / limits), -1.0).argmax())
        bins[row[at]], order[row[at]] = current, placed
        room = room - left[at]
        alive[at], placed = False, placed + 1
    return bins, order


def pack(pieces: DataFrame, limits: dict[str, int], group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces with the columns `limits` names (the first: tokens) within each limit.

    `pieces` is read more than once; pass a written table.
    """
    dims = list(limits)
    most = np.array(list(limits.values()), np.int64)
    groups = max(1, -(-pieces.count() // group))
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset"))])
    key = F.pmod(F.xxhash64(*[F.col(c) for c in pieces.columns]), F.lit(groups))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        demand = np.stack([table.column(d).to_numpy() for d in dims], 1).astype(np.int64)
        bins, order = np.zeros(len(demand), np.int64), np.zeros(len(demand), np.int64)
        full = demand[:, 0] == most[0]
        bins[full] = np.arange(int(full.sum()))
        sub, placed = dot_product_bins(demand[~full], most)
        bins[~full], order[~full] = sub + int(full.sum()), placed
        line = np.lexsort((order, bins))
        length = demand[line, 0]
        before = np.cumsum(length) - length
        first = np.flatnonzero(np.diff(bins[line], prepend=-1))
        offset = np.zeros(len(demand), np.int64)
        offset[line] = before - np.repeat(before[first], np.diff(np.append(first, len(line))))
        table = table.drop_columns(["umbra_group"])
        release()
        return table.append_column("sequence_id", pa.array((int(key[0].as_py()) << 32) + bins)).append_column("offset", pa.array(offset))

    return pieces.withColumn("umbra_group", key).groupBy("umbra_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, tokens: int = TOKENS, segments: int = SEGMENTS) -> DataFrame:
    """Packs whole documents: every token bears loss, so the third limit equals the first."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(encode_pieces(docs, vocabulary, end_id, tokens), "pieces")
    demand = pieces.withColumns({"segments": F.lit(1).cast("bigint"), "loss_tokens": F.col("length")})
    return scratch.finish(pack(demand, {"length": tokens, "segments": segments, "loss_tokens": tokens}))


def pack_conversations(turns: DataFrame, vocabulary: str, limits: tuple[int, int, int] = (TOKENS, 24, 1536), bears_loss: str = "assistant", end_id: int = 2) -> DataFrame:
    """conv_id, turn, start, length, segments, loss_tokens, sequence_id, offset for each piece of each turn.

    `turns` has conv_id, turn, role and text; tokens of turns whose role is `bears_loss` bear loss. All three limits
    hold at once; a turn is cut at multiples of what one sequence can take of it.
    """
    most, segments, loss = limits
    scratch = Scratch(turns.sparkSession, "conversations")
    rows = scratch.table(turns.select(F.monotonically_increasing_id().alias("doc_id"), "conv_id", "turn", "role", "text"), "turns")
    asked = F.coalesce(F.col("role") == bears_loss, F.lit(False))
    pieces = [
        encode_pieces(rows.where(asked), vocabulary, end_id, min(most, loss)).withColumn("loss_tokens", F.col("length")),
        encode_pieces(rows.where(~asked), vocabulary, end_id, most).withColumn("loss_tokens", F.lit(0).cast("bigint")),
    ]
    demand = scratch.table(pieces[0].union(pieces[1]).withColumn("segments", F.lit(1).cast("bigint")), "pieces")
    packed = pack(demand, {"length": most, "segments": segments, "loss_tokens": loss})
    out = ["conv_id", "turn", "start", "length", "segments", "loss_tokens", "sequence_id", "offset"]
    return scratch.finish(packed.join(rows.select("doc_id", "conv_id", "turn"), "doc_id").select(*out))
