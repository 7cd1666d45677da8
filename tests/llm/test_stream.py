"""The dedup state outlives its query: later tables meet digests that earlier runs retained."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.llm.exact_dedup import Ledger, dedup
from umbra.llm.runtime import PLACE, PLACE_TYPE


def test_state_is_kept_from_run_to_run(spark, tmp_path):
    folder, schema = str(tmp_path / "log"), f"doc_id bigint, {PLACE} {PLACE_TYPE}, digest string"
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for rows, want in (
        ([(5, 0, "a"), (7, 1, "b")], {"a": (5, 1), "b": (7, 1)}),
        ([(3, 2, "a"), (None, 3, "b"), (9, 4, "c")], {"a": (3, 2), "b": (7, 2), "c": (9, 1)}),
    ):
        spark.createDataFrame([(d, ("f", r), x) for d, r, x in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        state = ledger.stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
        assert {r.digest: (r.first.doc_id, r.group_size) for r in state.collect()} == want


def test_later_tables_meet_earlier_ones(spark, tmp_path):
    folder, length = str(tmp_path / "ledger"), lambda c: F.length(c).cast("string")
    tables = [
        ([(5, "one text"), (6, "another one"), (None, "without id")], {(5, 5, 1, True), (6, 6, 1, True), (None, None, 1, True)}),
        ([(2, "one  text"), (7, "another one"), (8, "new"), (9, "new")], {(2, 2, 2, True), (7, 6, 2, False), (8, 8, 2, True), (9, 8, 2, False)}),
    ]
    for digest, at in ((None, "sha"), (length, "length")):  # a weak digest tells texts of one length apart only by their bytes
        for i, (rows, want) in enumerate(tables):
            path = str(tmp_path / f"{at}{i}")
            spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
            docs = spark.read.parquet(path)
            got = dedup(docs, folder=f"{folder}-{at}") if digest is None else dedup(docs, digest, f"{folder}-{at}")
            assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()} == want
    more = spark.createDataFrame([(20, "xxx text"), (21, "one texu")], "doc_id bigint, text string")  # as long as an earlier text
    more.write.parquet(str(tmp_path / "more"))
    got = dedup(spark.read.parquet(str(tmp_path / "more")), length, f"{folder}-length").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(20, 20, 1, True), (21, 21, 1, True)}
