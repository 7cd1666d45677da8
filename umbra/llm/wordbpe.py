"""Batched encoding with a word-end BPE vocabulary file.

White space never enters a token of such a vocabulary, so the ids of a text are the ids of its space-delimited chunks,
one after another. Each batch encodes only the distinct chunks that the worker hasn't met yet: they are cut by the
file's own pattern and merged by rank in arrays, all words of one length at a time. Anything outside plain Latin text
goes through the tokenizer itself. A chunk is known by a 64-bit hash: with the ``CHUNKS`` that a worker remembers at
most, two of them share one with a probability under 2**-24.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import regex

from umbra.llm.runtime import CACHES, release
from umbra.llm.textops import word_hashes, word_spans

LONGEST, CHUNKS = 32, 1 << 19
_NONE = np.int32(1 << 30)
_MARKS = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = regex.compile(r"[\x20-ɏ\x00-\x1B&&[^\x80-\x9F]]*", regex.V1)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encodes lists of UTF-8 texts; `cache` bounds the chunks that one worker remembers, at about 30 bytes each."""

    def __init__(self, path: str, cache: int = CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"] + r"|\n")
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first = np.stack([self._ranks(self.inner[:, None], x[None, :]) for x in (self.inner, self.last)])
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        self.known, self.where, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def _merge(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) of the words of an equal-length byte matrix, by number of ids left."""
        rows, out = np.arange(len(chars)), []
        ids = self.inner[chars]
        ids[:, -1] = self.last[chars[:, -1]]
        rank = self.first[0][chars[:, :-1], chars[:, 1:]]
        rank[:, -1:] = self.first[1][chars[:, -2:-1], chars[:, -1:]]
        while ids.shape[1] > 1 and len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            if (over := best == _NONE).any():
                out.append((rows[over], ids[over]))
                go = ~over
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    return out
            line, width = np.arange(len(rows)), ids.shape[1] - 1
            ids = np.where(np.arange(width) <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[line, at] = self.merged[best]
            if width > 1:
                rank = np.where(np.arange(width - 1) < at[:, None], rank[:, :-1], rank[:, 1:])
                left = line[at > 0]
                rank[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
                right = line[at < width - 1]
                rank[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])
        out.append((rows, ids))
        return out

    def _words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: pool, and each word's start and size there."""
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        buf, first = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n
        where, size, parts, total = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [], 0
        for length in np.unique(n).tolist():
            own = np.flatnonzero(n == length)
            if length <= LONGEST:
                done = [(own[r], x) for r, x in self._merge(buf[first[own][:, None] + np.arange(length)])]
            else:
                done = [(own[i : i + 1], np.array([self._slow(raw[k].decode())], np.int32)) for i, k in enumerate(own.tolist())]
            for rows, ids in done:
                where[rows] = total + np.arange(len(rows)) * ids.shape[1]
                size[rows] = ids.shape[1]
                parts.append(ids.astype(np.uint32).ravel())
                total += ids.size
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), where, size

    def _slow(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        index: dict[bytes, int] = {b"\n": 0}
        kind = np.zeros(len(chunks), np.int8)  # 0: cut by the pattern, 1: letters, 2: letters and a mark, 3: exact
        head, mark = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        rest = []
        for i, c in enumerate(chunks):
            c = c.lower()
            if c.isalpha():
                kind[i], head[i] = 1, index.setdefault(c, len(index))
            elif c[:-1].isalpha() and c[-1] in _MARKS:
                kind[i], head[i], mark[i] = 2, index.setdefault(c[:-1], len(index)), index.setdefault(c[-1:], len(index))
            elif _PLAIN.fullmatch(t := c.decode("utf-8", "replace")):
                rest.append(t)
            else:
                kind[i] = 3
        found = self.pattern.findall("\n".join(rest).lower())
        which = np.fromiter((index.setdefault(w.encode(), len(index)) for w in found), np.int64, len(found))
        pool, where, size = self._words(list(index)[1:])
        where, size = np.concatenate([[0], where]), np.concatenate([[0], size])
        new_size, new_where = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        flats, total = [], 0
        for k, what in ((1, head[kind == 1]), (2, np.stack([head, mark], 1)[kind == 2].ravel()), (0, which)):
            flats.append(gather(pool, where[what], size[what]))
            cum = np.concatenate([[0], np.cumsum(size[what])])
            if k:
                bound = np.arange(0, len(what) + 1, k)
            else:
                bound = np.concatenate([[0], np.flatnonzero(which == 0), [len(which)]]) if rest else np.zeros(1, np.int64)
            new_size[kind == k] = np.diff(cum[bound])
            new_where[kind == k] = total + cum[bound[:-1]]
            total += len(flats[-1])
        flat = np.concatenate(flats)
        slow, total = [], len(flat)
        for i in np.flatnonzero(kind == 3).tolist():
            ids = self._slow(chunks[i].decode("utf-8", "replace"))
            new_where[i], new_size[i] = total, len(ids)
            total += len(ids)
            slow.append(np.array(ids, np.uint32))
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.where = np.concatenate([self.where, (new_where + len(self.pool)).astype(np.int32)])[order]
        self.size = np.concatenate([self.size, new_size.astype(np.int32)])[order]
        self.pool = np.concatenate([self.pool, flat, *slow])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order (uint32), and each text's bounds there."""
        buf = np.frombuffer(b" ".join(texts), np.uint8)
        starts, ends = word_spans(buf)
        hashes = word_hashes(buf, starts, ends)
        length = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        bound = np.searchsorted(starts, np.concatenate([[0], np.cumsum(length)]))
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > self.limit:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        miss = np.ones(len(unique), bool) if not len(self.known) else self.known[at] != unique
        if miss.any():
            view = buf.tobytes()
            own = first[miss]
            self._learn(unique[miss], [view[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            at = np.searchsorted(self.known, unique)
        size = self.size[at][back].astype(np.int64) if len(unique) else np.zeros(0, np.int64)
        ids = gather(self.pool, self.where[at][back].astype(np.int64), size) if len(unique) else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(size)])[bound]


@functools.lru_cache(1)
def coder(path: str) -> WordBpe:
    """The worker's one encoder, which its tasks share; what reading its file took goes back to the system."""
    own = WordBpe(path)
    release()
    return own


CACHES[__name__] = coder.cache_clear


def gather(pool: np.ndarray, where: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pool's runs of `size` entries from `where`, one after another."""
    first = np.cumsum(size) - size
    return pool[np.arange(int(size.sum())) + np.repeat(where - first, size)]
