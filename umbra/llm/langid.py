"""Language identification of whole texts.

Method: hierarchical discrimination. One-versus-one linear support vector machines first tell language families apart,
then others tell the languages within the predicted family apart; votes decide, summed margins break ties. Features are
relative frequencies of byte bigrams and trigrams (A-Z folded, other ASCII non-letters as one space), so a text's score
is a mean of weights over its n-grams: one pass, no vocabulary, any length.

Fitted on at most ``PER_LANGUAGE`` rows of each language, drawn by a hash of the id from labelled rows that are not held
out, and on the first of them that hold ``SLOTS`` n-grams together (one row at least). Every label is a language of the model; its weights grow with the square of the number of families and of a
family's languages, and hold only the n-grams that the rows have.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no labelled row all are ``und``; with
one language all others get it with score 1; a null lang is never learned from; a null doc_id stays; repeated rows are
scored each; an empty table gives no rows; in `identify`, other columns pass through, and those of its `names` are
replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.linear import dual_coordinate_descent
from umbra.llm.runtime import Scratch, bounded, lean, remainder, ship
from umbra.llm.textops import slices, texts_of

PER_LANGUAGE, SLOTS, SIZE = 300, 1 << 20, 1 << 16
#: Branches of the languages that a corpus may hold; any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER, _LETTER = regex.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text) or (not text.isascii() and _LETTER.search(text.decode("utf-8", "replace"))))


def ngrams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and hashed trigram slots at each place of a folded buffer that ends in two spare bytes."""
    b = buf.astype(np.uint32)
    two = b[:-2] << np.uint32(8) | b[1:-1]
    three = ((two << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    return two, three


def _folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return _FOLD[np.frombuffer(b" ".join([*texts, b"  "]), np.uint8)], np.cumsum(size) - size


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf, _ = _folded([text])
    two, three = ngrams(buf)
    slot, n = np.unique(np.concatenate([two[: len(text) + 1], three[: len(text) + 1] + SIZE]), return_counts=True)
    return slot.astype(np.int32), n / (len(text) + 1)


class Model:
    """Pairwise weights by family and by language."""

    def __init__(self, rows: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(rows)
        self.members: dict[str, list[str]] = defaultdict(list)
        for lang in self.langs:
            self.members[FAMILY_OF.get(lang, lang)].append(lang)
        self.pairs: list[tuple[str, str]] = []
        weights, bias = [], []
        pooled = {f: [r for lang in langs for r in rows[lang]] for f, langs in self.members.items()}
        self.families = sorted(self.members)
        used = np.unique(np.concatenate([i for data in rows.values() for i, _ in data]))
        self.place = np.zeros(2 * SIZE, np.int32)  # of each slot among the weights; 0: no row has it
        self.place[used] = np.arange(1, len(used) + 1)
        for names, data in ((self.families, pooled), *((langs, rows) for langs in self.members.values())):
            for a, b in combinations(sorted(names), 2):
                self.pairs.append((a, b))
                scaled = [(self.place[i], v * 30) for i, v in (*data[a], *data[b])]
                y = np.array([1.0] * len(data[a]) + [-1.0] * len(data[b]))
                w = dual_coordinate_descent(scaled, y, len(used) + 1)
                w[:-1] *= 30
                bias.append(w[-1])
                weights.append(w[:-1].astype(np.float32))
        self.bias, self.weights = np.array(bias), weights

    def _vote(self, names: list[str], margin: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner, and its least certainty over its duels."""
        names = sorted(names)
        votes, sums, sure = np.zeros((len(names), n)), np.zeros((len(names), n)), np.ones((len(names), n))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            m = margin[a, b]
            p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
            votes[i] += m >= 0
            votes[j] += m < 0
            sums[i] += m
            sums[j] -= m
            sure[i], sure[j] = np.minimum(sure[i], p), np.minimum(sure[j], 1 - p)
        best = (votes + np.tanh(sums / 100) * 0.4).argmax(0)
        return best, sure[best, np.arange(n)]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        buf, first = _folded(texts)
        two, three = ngrams(buf)
        two, three = two[: first[-1] + len(texts[-1]) + 1], three[: first[-1] + len(texts[-1]) + 1] + SIZE
        two, three = self.place[two], self.place[three]
        length = np.diff(np.append(first, len(two)))
        margin = {}
        for pair, w, b in zip(self.pairs, self.weights, self.bias, strict=True):
            margin[pair] = np.add.reduceat(w[two] + w[three], first, dtype=np.float64) / length + b
        family, sure = self._vote(self.families, margin, len(texts))
        lang, score = np.empty(len(texts), object), np.zeros(len(texts))
        for i, name in enumerate(self.families):
            own = np.flatnonzero(family == i)
            names = sorted(self.members[name])
            if len(own):
                inside = {p: m[own] for p, m in margin.items() if p[0] in names and p[1] in names}
                best, certain = self._vote(names, inside, len(own))
                lang[own], score[own] = np.array(names, object)[best], sure[own] * certain
        return lang.tolist(), score


def fit(docs: DataFrame, learn: Column) -> Model | None:
    """Learns from the rows that `learn` names."""
    ship(docs.sparkSession)
    docs = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = docs.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    shares = [(r.lang, int(min(1.0, PER_LANGUAGE / r["count"]) * (1 << 31))) for r in counts]
    langs, most = (pa.array(x, t) for x, t in zip(zip(*shares, strict=True), (pa.string(), pa.int64()), strict=True))
    # as Arrow: a list of rows would start a second kind of Python workers on each executor, which stay beside the first
    share = docs.sparkSession.createDataFrame(pa.table([langs, most], ["lang", "share"]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) if has_letter(t) else None for t in texts_of(batch.column(2))]
            keep = pa.array([x is not None for x in found], pa.bool_())
            slot, share = ([x[i].astype((np.int32, np.float32)[i]).tobytes() for x in found if x] for i in (0, 1))
            lang, at = batch.column(0).filter(keep), batch.column(1).filter(keep)
            yield pa.record_batch([lang, at, pa.array(slot, pa.binary()), pa.array(share, pa.binary())], ["lang", "place", "slot", "share"])

    chosen = docs.join(F.broadcast(share), "lang").where(place < F.col("share")).select("lang", place.alias("place"), "text")
    scratch = Scratch(docs.sparkSession, "language")
    rows = scratch.table(chosen.mapInArrow(run, "lang string, place bigint, slot binary, share binary"), "rows")
    by_lang = defaultdict(list)
    first = bounded(rows, "lang", ["place", "slot", "share"], F.octet_length("slot") / 4, PER_LANGUAGE, SLOTS)
    for r in sorted(first, key=lambda r: (r.lang, r.umbra_rank)):
        by_lang[r.lang].append((np.frombuffer(r.slot, np.int32), np.frombuffer(r.share, np.float32).astype(np.float64)))
    scratch.drop()
    return Model(by_lang) if by_lang else None


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns, and the predicted language and its score under `names`; the text is read whole."""
    ship(docs.sparkSession)
    docs = docs.drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a float for each n-gram in use and pair
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = texts_of(batch.column(at))
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for a, b in slices([texts[i] for i in lettered]):
                found, score = model.predict([texts[i] for i in lettered[a:b]])
                for i, lang in zip(lettered[a:b], found, strict=True):
                    langs[i] = lang
                scores[lettered[a:b]] = score
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


def lettered(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter; without one a text is ``und`` under any model."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t) for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(docs, ~held_out)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
