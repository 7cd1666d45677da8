"""Token counts of document sections from one encoding of the whole document.

Method: offset-mapped attribution. The whole text is encoded once with a byte-level vocabulary; the byte lengths of its
tokens give each token's span, since such tokens are the text's bytes in order. Spans are then interval-joined to the
sections, both sorted: a section's tokens lie between two binary searches. A token that crosses a boundary goes by rule:
``first`` to the section of its first byte, ``last`` to that of its last, ``most`` to the one that holds most of its
bytes, the earlier at a tie. So sections add up to the document's tokens whatever the cuts.

By default the sections are the text's lines, each with its line end. Tokenising a document's own sections one by one
would count differently, as merges and leading spaces reach over line ends.

Defined cases: a null or empty text has no section and no row; a null doc_id stays; repeated rows are counted each; an
empty table gives no rows; other columns are ignored. Very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.runtime import lean, ship

RULES = ("first", "last", "most")


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(k) for k in ranks]

    def ends(self, text: bytes) -> np.ndarray:
        """End of each token's byte span; a token starts where the one before ends."""
        return np.cumsum(self.size[np.array(self.coder.encode_ordinary(text.decode("utf-8", "replace")), np.int64)])


@functools.lru_cache(1)
def byte_coder(path: str, pattern: str) -> ByteBpe:
    """The worker's one encoder, which its tasks share."""
    return ByteBpe(path, pattern)


def owners(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary), for sections that begin at `starts` and leave no gap."""
    begin = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    if rule == "first":
        return first, first != last
    if rule == "last":
        return last, first != last
    own = first.copy()
    for i in np.flatnonzero(first != last).tolist():
        cuts = np.concatenate([[begin[i]], starts[first[i] + 1 : last[i] + 1], [ends[i]]])
        own[i] = first[i] + int(np.diff(cuts).argmax())
    return own, first != last


def section_tokens(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "most") -> DataFrame:
    """doc_id, section, start_char, end_char, tokens, crossing (tokens of it that reach into others) for each line."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    ship(docs.sparkSession)
    names = ["doc_id", "section", "start_char", "end_char", "tokens", "crossing"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(vocabulary, pattern)
        for batch in batches:
            out, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                raw = text.encode()
                buf = np.frombuffer(raw, np.uint8)
                starts = np.flatnonzero(buf[:-1] == 10) + 1
                starts = np.concatenate([[0], starts])
                letters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                chars = letters[np.append(starts, len(buf))]
                own, crossing = owners(coder.ends(raw), starts, rule)
                n = len(starts)
                out.append((np.full(n, -1 if doc is None else doc), np.full(n, doc is None), np.arange(n), chars[:-1], chars[1:], np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)))
                size += n
                if size > 50_000:
                    yield flat(out)
                    out, size = [], 0
            if out:
                yield flat(out)

    def flat(parts: list) -> pa.RecordBatch:
        ids, null, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.record_batch([pa.array(ids.astype(np.int64), mask=null), *[pa.array(c.astype(np.int64)) for c in rest]], names)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
