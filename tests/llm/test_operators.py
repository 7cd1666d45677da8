"""The training-data operators on odd inputs and against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from umbra.llm import attribution, langid, mixing, sharding, topk, warc
from umbra.llm.exact_dedup import dedup, duplicates_dropped
from umbra.llm.graph import components
from umbra.llm.jaccard import jaccard_components, least_overlap, near_duplicates_dropped
from umbra.llm.linear import dual_coordinate_descent, margins
from umbra.llm.packing import dot_product_bins, pack_conversations, pack_documents
from umbra.llm.quality import indicators, quality_of
from umbra.llm.textops import shingle_sets, word_hashes, word_spans
from umbra.llm.wordbpe import WordBpe

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, k):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows, k, percent):
    sets, label = {}, {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(shingles(text, k))
        label[doc] = doc
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if both and 100 * both >= percent * (len(x) + len(y) - both) and find(a) != find(b):
                        label[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


# ---- primitives
def test_words_and_shingles_match_brute_force():
    texts = [b"", b"  ", b"a", b"A b\x0bc", b"x" * 300000 + b" y", " é  ü ".encode(), b"a b c d e a b c d e"]
    for text, got in zip(texts, shingle_sets(texts, 4), strict=True):
        assert len(got) == len(shingles(text.decode(), 4))
    buf = np.frombuffer(b"ab AB " + b"z" * 300000 + b" ab", np.uint8)
    h = word_hashes(buf, *word_spans(buf))
    assert h[0] == h[1] == h[3] != h[2]


def test_encoder_matches_the_tokenizer():
    coder = WordBpe(VOCABULARY, cache=50)
    texts = ["", " ", "I'll don't STOP's 12 3a ½", "İstanbul ΑΣ", "日本語 テスト", "a\x1cb c", "é é", "<|endoftext|> hi", "x" * 100, "🙂ok...!!", "'S'T 'RE", "word, (word) word."] * 3
    ids, bound = coder.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[bound[i] : bound[i + 1]].tolist() == coder.exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_prefix_bound(percent):
    for n in range(1, 200):
        t = least_overlap(n, percent)
        assert t * 100 >= percent * n > (t - 1) * 100


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    rows = [(np.arange(3), np.array([v * 2 + rng.normal(0, 0.3), rng.normal(), 1.0])) for v in y]
    w = dual_coordinate_descent(rows, y, 3)
    assert (np.sign(margins(rows, w)) == y).mean() > 0.98


# ---- 1 and 5
def test_language_held_out_accuracy(docs):
    got = langid.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_odd(odd, spark):
    rows = {r.doc_id: r for r in langid.language_of(odd).collect() if r.doc_id}
    assert {rows[i].lang_pred for i in (3, 4, 5, 9)} == {"und"}
    assert rows[1].lang_pred == "en" and rows[3].score == 0
    assert langid.language_of(odd).count() == odd.count()
    assert langid.language_of(odd.where("1 = 0")).count() == 0
    assert {r.lang_pred for r in langid.language_of(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(odd, None).columns[-2:] == ["lang_pred", "score"]


def test_every_label_is_a_language_of_the_model(spark):
    names = sorted({lang for langs in langid.FAMILIES.values() for lang in langs}) + [f"x{i}" for i in range(32)]
    rows = [(i, f"{chr(0x4E00 + 7 * i)}{chr(0x5E00 + 7 * i)} " * 4, lang) for i, lang in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert len(names) > 64 and model.langs == sorted(names)
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, model).collect())


def test_quality_held_out(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert held[held.quality == 1].score.mean() > held[held.quality == 0].score.mean() + 0.4
    assert ((held.score >= 0.3) == (held.predicted == 1)).all()


def test_quality_odd(odd, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (6, 1), (7, 0), (7, 1), (None, 0)], "doc_id bigint, quality int")
    for known in (labels, labels.where("quality = 1"), labels.where("1 = 0")):
        rows = quality_of(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_of(odd.where("1 = 0"), labels).count() == 0


def test_indicators_are_sets_of_the_text_alone():
    alone = [list(indicators([t]))[0].tolist() for t in (b"abc abc", b"", b"zz")]
    assert alone == [x.tolist() for x in indicators([b"abc abc", b"", b"zz"])]
    assert alone[1] == []


# ---- 2
def test_shards_are_equal_in_bytes(docs):
    rows = sharding.shard_documents(docs, 4).toPandas()
    by = rows.groupby("shard")["size"].sum()
    assert len(rows) == docs.count() and set(by.index) == set(range(4))
    assert by.max() - by.min() < 2.5 * rows["size"].max()
    for _, s in rows.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert rows.groupby(["text_crc32", "size"]).shard.nunique().max() == 1


def test_shards_odd(odd):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if r.doc_id in (3, 4)} == {1}
    assert sharding.shard_documents(odd.where("1 = 0"), 3).count() == 0


def test_one_giant_group_is_still_split(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = [r["count"] for r in sharding.shard_documents(same, 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 120


# ---- 3
def test_jaccard_matches_brute_force(spark, docs, odd):
    near = [(1000 + i, " ".join(f"t{(j * 7) % 97}" if (j + i) % 29 else f"e{i}" for j in range(60))) for i in range(14)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(120).collect()] + near + [(2000, "a b c d e"), (2001, "a b c d e f"), (2002, "a b c d")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(frame, k=2, percent=80).collect()}
    assert got == brute_components(rows, 2, 80)
    kept = {r.doc_id for r in near_duplicates_dropped(frame, k=2, percent=80).collect()}
    assert kept == set(got.values())


def test_jaccard_contract_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, shingles(r.text, 4)) for r in docs.collect()]
    label = {d: d for d, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    rows.sort(key=lambda r: len(r[1]))
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if 100 * len(x) < 85 * len(y):
                break
            both = len(x & y)
            if both and 100 * both >= 85 * (len(x) + len(y) - both) and find(a) != find(b):
                label[max(find(a), find(b))] = min(find(a), find(b))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, k=4, percent=85).collect()}
    assert got == {(d, len(x), find(d)) for d, x in rows}


def test_texts_of_one_doc_id_are_one_node(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b), (2, None), (4, "alone " + b[:40])]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4, percent=85).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_jaccard_odd(odd):
    rows = jaccard_components(odd, k=4, percent=85).collect()
    want = brute_components([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], 4, 85)
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id is not None} == set(want.items())
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    assert {r.n_shingles for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert jaccard_components(odd.where("1 = 0")).count() == 0


def test_long_chain_in_random_order_is_one_component(spark):
    ids = [int(x) for x in np.random.default_rng(0).permutation(500)]
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)) + [(1000, 1002), (1002, 1001)], "a bigint, b bigint").coalesce(1)
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**dict.fromkeys(ids, 0), **dict.fromkeys((1000, 1001, 1002), 1000)}


# ---- 4
def check_packing(rows, texts, most=4096):
    coder = WordBpe(VOCABULARY).exact
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1]) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0, *[r.length for r in s]])[:-1]) and sum(r.length for r in s) <= most


def test_packing(docs):
    rows = pack_documents(docs, VOCABULARY).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.length for r in rows) / 4096 > 0.97 * (len({r.sequence_id for r in rows}) - 1)


def test_packing_odd(odd):
    rows = pack_documents(odd, VOCABULARY).collect()
    once = [(r.doc_id, r.text) for r in odd.where("doc_id is not null and doc_id <> 2").collect()]
    for doc, text in once:
        assert sum(r.length for r in rows if r.doc_id == doc) == len(WordBpe(VOCABULARY).exact.encode(text or "", add_special_tokens=False).ids) + 1
    assert sum(r.doc_id is None for r in rows) == 2 and pack_documents(odd.where("1 = 0"), VOCABULARY).count() == 0


def test_bins_keep_all_limits():
    rng = np.random.default_rng(3)
    demand = np.stack([rng.integers(1, 900, 500), np.ones(500, int), rng.integers(0, 400, 500)], 1)
    demand[:, 2] = np.minimum(demand[:, 2], demand[:, 0])
    bins, _ = dot_product_bins(demand, np.array([1000, 4, 500]))
    for b in np.unique(bins):
        assert (demand[bins == b].sum(0) <= [1000, 4, 500]).all()
    assert (bins >= 0).all()


def test_conversations_keep_three_limits(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").limit(200)
    odd_turns = spark.createDataFrame([(1, 1, None, None), (1, 2, "assistant", ""), (None, 3, "assistant", "word " * 3000), (1, 1, "user", "x" * 9000)], "conv_id bigint, turn bigint, role string, text string")
    turns = turns.select("conv_id", "turn", "role", "text").union(odd_turns).withColumns({"doc_id": F.lit(1), "length": F.lit("z"), "segments": F.lit(0)})
    limits = (1024, 6, 256)
    rows = pack_conversations(turns, VOCABULARY, limits).toPandas()
    sums = rows.groupby("sequence_id")[["length", "segments", "loss_tokens"]].sum()
    assert (sums <= list(limits)).all().all()
    assert all((sums[c] > 0.9 * most).any() for c, most in zip(sums, limits, strict=True))  # each limit binds somewhere
    coder = WordBpe(VOCABULARY).exact
    source = turns.toPandas()
    tokens = sum(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for t in source.text)
    loss = sum(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for t, r in zip(source.text, source.role, strict=True) if r == "assistant")
    assert rows.length.sum() == tokens and rows.loss_tokens.sum() == loss
    assert pack_conversations(turns.where("1 = 0"), VOCABULARY).count() == 0


# ---- 6
def test_revisits(spark):
    rows = [
        (1, "u", 10, True, "e1", None, {"content-length": "5", "date": "1"}), (2, "u", 20, False, "e1", None, {"content-length": "0", "date": "2"}), (3, "u", 15, True, "e2", None, {}),
        (4, "u", 12, False, "e1", None, {"date": "4", "content-type": "x"}), (5, "v", 12, False, "e1", None, None), (6, None, 12, False, "e1", None, None), (7, "u", 10, False, "e1", None, None),
        (8, "w", 1, True, None, "m", None), (9, "w", 2, False, None, "m", {"date": "9"}), (10, "w", 3, False, None, None, None), (4, "u", 12, False, "e1", None, {"date": "4", "content-type": "x"}),
    ]
    records = spark.createDataFrame(rows, "record_id bigint, url string, at bigint, full boolean, etag string, modified string, headers map<string,string>")
    got = sorted((r.record_id, r.refers_to, r.state, tuple(sorted((r.headers or {}).items()))) for r in warc.resolve(records).collect())
    assert got == sorted([
        (2, 3, "changed", ()), (4, 1, "resolved", (("content-length", "5"), ("date", "4"))), (4, 1, "resolved", (("content-length", "5"), ("date", "4"))), (5, None, "unresolved", ()),
        (6, None, "unresolved", ()), (7, None, "unresolved", ()), (9, 8, "resolved", (("date", "9"),)), (10, 8, "unverified", ())], key=lambda x: (x[0], x[1] or 0))
    assert warc.resolve(records.where("1 = 0")).count() == 0


@pytest.mark.parametrize("url, canonical", [
    ("HTTP://www.A.com:80/x/?b=2&a=1#f", "https://a.com/x?a=1&b=2"), ("https://a.com", "https://a.com"), ("https://a.com/X/", "https://a.com/X"), ("http://a.com:443/", "https://a.com:443"),
    ("https://a.com:80/", "https://a.com:80"), ("ftp://a.com/b", "ftp://a.com/b"), ("foo.com/a", None), ("bar.org/b", None), ("/rel", None), ("", None), ("https:///x", None), (None, None),
])
def test_canonical_url(spark, url, canonical):
    assert spark.range(1).select(warc.canonical_url(F.lit(url).cast("string")).alias("u")).first().u == canonical


def test_revisits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_ROWS", 20)  # so that the hot URL is cut, most of its rows in one burst
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        hot, url = rng.random() < 0.6, None if rng.random() < 0.05 else f"https://u{rng.integers(0, 30)}"
        at = int(rng.integers(500, 510)) if hot and rng.random() < 0.8 else int(rng.integers(0, 1000))
        rows.append((i, "https://hot" if hot else url, at, bool(rng.random() < 0.4), f"e{rng.integers(0, 3)}" if rng.random() < 0.8 else None, f"m{rng.integers(0, 2)}", {"date": str(i)}, "b", 1, "z"))
    records = spark.createDataFrame(rows, "record_id bigint, url string, at bigint, full boolean, etag string, modified string, headers map<string,string>, slice string, source int, cuts string")
    want = []
    for i, url, at, full, etag, modified, *_ in rows:
        if not full:
            held = max(((r[2], r[0], r[4], r[5]) for r in rows if r[3] and url is not None and r[1] == url and r[2] < at), default=None, key=lambda x: x[:2])
            same = None if held is None else etag == held[2] if etag is not None and held[2] is not None else modified == held[3]
            want.append((i, held and held[1], "unresolved" if held is None else "resolved" if same else "changed"))
    assert sorted((r.record_id, r.refers_to, r.state) for r in warc.resolve(records).collect()) == want


# ---- 7
def test_dedup_odd(odd):
    rows = dedup(odd).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    want = sorted((str(d), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for d in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert dedup(odd.where("1 = 0")).count() == 0
    assert duplicates_dropped(odd).columns == odd.columns


def test_duplicates_dropped_keeps_what_dedup_keeps(odd, spark):
    more = spark.createDataFrame([(2, "the other text of doc_id 2"), (None, "twice without id"), (None, "twice  without id")], "doc_id bigint, text string")
    rows = odd.select("doc_id", "text").union(more)
    got = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in duplicates_dropped(rows).collect()]
    want = {}
    for r in rows.collect():
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    assert sorted(got, key=str) == sorted(((min((d for d in ids if d is not None), default=None), t) for t, ids in want.items()), key=str)
    assert sum(r.kept for r in dedup(rows).collect()) == len(got)


def test_texts_that_share_a_digest_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz")], "doc_id bigint, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup(rows, digest=lambda c: F.length(c).cast("string")).collect()}
    assert got == {(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)}


def test_keepers_without_an_id_of_their_own_are_told_apart(spark):
    rows = spark.createDataFrame([(None, "ab"), (None, "cd"), (None, "ab"), (5, "xyz"), (5, "uvw")], "doc_id bigint, text string")
    got = sorted(((r.text_sha256, r.doc_id, r.group_size, r.kept) for r in dedup(rows, digest=lambda c: F.length(c).cast("string")).collect()), key=str)
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("ab", "cd", "xyz", "uvw")}
    assert got == sorted([(sha["ab"], None, 2, True), (sha["ab"], None, 2, False), (sha["cd"], None, 1, True), (sha["xyz"], 5, 1, True), (sha["uvw"], 5, 1, True)], key=str)


# ---- 8
def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d", "x", "a", 10, 1, 1, 1), ("d", "x", "b", 100, 1, 1, 1), ("d", "y", "c", 1000, 1, 1, 1), ("e", "x", "f", 1000, 1, 1, 1)],
                                   "domain string, lang string, source string, tokens bigint, weight_domain bigint, weight_lang bigint, weight_source bigint")
    got = {r.source: r.given for r in mixing.budgets(leaves, 400, 1).collect()}
    assert got == {"a": 10, "b": 90, "c": 100, "f": 200}
    got = {r.source: r.given for r in mixing.budgets(leaves, 800, 1).collect()}
    assert got == {"a": 10, "b": 100, "c": 290, "f": 400}


def test_mixing_odd(odd):
    leaves = mixing.document_leaves(odd)
    rows = mixing.mix(leaves, mixing.document_weights(), part=(3, 2), epochs=3).collect()
    total = sum(len(WORD.findall((r.text or "").encode())) for r in odd.collect())
    assert sum(r.take_tokens for r in rows) == total * 3 // 2
    assert mixing.mix(leaves.where("1 = 0"), mixing.document_weights()).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_mixed_takes_each_row_by_itself(spark):
    rows = [(None, f"null {i} " + "w " * 8, "en", "src0") for i in range(10)] + [(7, f"same {i} " + "w " * 8, "en", "src1") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    by = {r.source: r["count"] for r in mixing.mixed(docs, part=(1, 1)).groupBy("source").count().collect()}
    assert by == {"src0": 10, "src1": 10}
    taken = mixing.mix(mixing.document_leaves(docs), mixing.document_weights(), part=(1, 2), epochs=1).collect()
    got = mixing.mixed(docs, part=(1, 2)).collect()
    for source in ("src0", "src1"):
        assert sum(r.source == source for r in got) == sum(r.source == source for r in taken) < 10
    assert len({r.text for r in got}) == len(got)


# ---- 9
@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_matches_brute_force(spark, rule):
    texts = [(1, "one two\nthree\n\n four five"), (2, "\n\n\n"), (3, None), (4, ""), (5, "é\nü  \n  x"), (6, "no end"), (6, "no end"), (None, "a\nb")]
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = attribution.section_tokens(spark.createDataFrame(texts, "doc_id bigint, text string"), vocabulary, public_tokenizers.PATTERN, rule).toPandas()
    coder = attribution.ByteBpe(vocabulary, public_tokenizers.PATTERN)
    for doc, text in ((d, t) for d, t in texts if d in (1, 2, 5)):
        raw, own = text.encode(), got[got.doc_id == doc].sort_values("section")
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert [text[a:b] for a, b in zip(own.start_char, own.end_char, strict=True)] == lines
        line_of = [i for i, x in enumerate(lines) for _ in x.encode()]
        want, begin = [0] * len(lines), 0
        for end in coder.ends(raw).tolist():
            held = line_of[begin:end]
            want[{"first": held[0], "last": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]] += 1
            begin = end
        assert own.tokens.tolist() == want
    assert len(got[got.doc_id == 6]) == 2 and got.doc_id.isna().sum() == 2 and not got.doc_id.isin([3, 4]).any()


# ---- 10
def brute_top_k(rows, k=5):
    v = [(n, i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for n, (i, x) in enumerate(rows) if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    want = []
    for n, q, x in v:
        if q % 50 == 0:
            scores = sorted((-int(x @ y), i) for m, i, y in v if m != n and len(y) == len(x))[:k]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(want)


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8 * 64)  # several blocks and chunks
    monkeypatch.setattr(topk, "CHUNK", 16 * 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(0, 300)]
    rows += [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8), (1150, [1.0, 2.0]), (1151, [3.0, 1.0]), (1200, []), (50, rows[50][1]), (50, rows[51][1]), (None, rows[3][1])]
    rows += [(2000, [0.0] * 8), (2001, [5.0] * 8), (2001, [5.0] * 8), (7, [5.0] * 8)]
    docs = spark.createDataFrame([(i, x, 7, 1, "b") for i, x in rows], "vec_id bigint, embedding array<float>, number bigint, width int, block string")
    got = topk.search(docs, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top_k(rows)
    assert all(0 <= r.depth <= 1 for r in got)


def test_topk_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.search(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_reading_stops_early_and_stays_exact():
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 3, (400, 4)).astype(float)
    v[:9] += 60
    lists = topk.Lists(v)
    for q in np.abs(rng.integers(1, 9, (5, 4))).astype(float):
        for floor in (-np.inf, float(np.sort(v @ q)[-3])):
            rows, scores, depth, reads = topk.top_k(lists, q, 3, floor)
            assert sorted(zip(-scores, rows, strict=True))[:3] == sorted(zip(-(v @ q), range(400), strict=True))[:3]
            assert depth <= 225 and reads <= 1600


@pytest.mark.parametrize("width", [1, 3, 24])
def test_bounds_never_lose_a_row(width):
    rng = np.random.default_rng(width)
    v = rng.integers(-2, 3, (150, width)).astype(float)
    lists = topk.Lists(v)
    for q in [*rng.integers(-2, 3, (30, width)).astype(float), np.zeros(width)]:
        own = int(rng.integers(0, 150))
        rows, scores, *_ = topk.top_k(lists, q, 4, own=own)
        want = sorted((-x, i) for i, x in enumerate(v @ q) if i != own)[:4]
        assert sorted((-s, i) for s, i in zip(scores, rows.tolist(), strict=True))[:4] == want
