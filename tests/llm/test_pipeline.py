"""The corpus pipeline against its stages' brute-force versions, on a small corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, check_packing
from umbra.llm.mixing import mixed


def test_pipeline(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{base} tail{i} alpha beta gamma{i % 3}", "en", f"src{i % 3}", 0) for i in range(6)]
    rows += [(20 + i, " ".join(f"t{i}x{j}" for j in range(60 + i)), "en", f"src{i % 4}", 0) for i in range(20)]
    rows += [(50, rows[10][1], "en", "src1", 0), (51, "!!! 123", "en", "src1", 0), (52, None, None, None, None), (53, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    del texts[50]  # an exact copy
    labels = brute_components(list(texts.items()), 5, 80)
    kept = [d for d in texts if labels[d] == d]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    chosen = [r.doc_id for r in mixed(docs.where(docs.doc_id.isin(kept))).collect()]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(chosen)
    check_packing(packed, [(d, texts[d]) for d in chosen])


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "near duplicates", "mixing", "packing"]


def test_language_fills_what_is_missing(spark):
    rows = [(3 * i, "the house and the street " * 3, "en") for i in range(8)] + [(100 + 3 * i, "la maison est dans la rue " * 3, "fr") for i in range(8)]
    rows += [(201, "the street and the house", None), (202, "dans la rue est la maison", None), (203, "123 !", None), (204, "the house", "de")]
    docs = spark.createDataFrame([(*r, "src1") for r in rows], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {**{r[0]: r[2] for r in rows if r[0] != 203}, 201: "en", 202: "fr"}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    left = corpus_pipeline.language(spark, unlabelled, "").collect()
    assert {r.doc_id for r in left} == {r[0] for r in rows} - {203} and {r.lang for r in left} == {None}
    assert corpus_pipeline.language(spark, docs, "").columns == docs.columns


def test_language_leaves_columns_of_its_names_alone(spark):
    rows = [(3 * i, "the house and the street " * 3, "en", f"own {i}", i / 7) for i in range(8)] + [(None, "the house", None, "own", 0.25), (3, "the house", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.lang_pred, r.score) for r in got.collect()), key=str) == sorted(((r[0], r[3], r[4]) for r in rows), key=str)
