"""Sanitising a corpus: documents in, relations of lines, hits, findings, identities and mappings out.

A document is the unit of work: each is folded by itself inside Arrow batches, so a lost task repeats to the same rows
(the salt is given). Documents are dealt out first, as a scan gives all rows of a row group to one task and folding costs
far more than moving them. The folded rows hold all relations nested; the functions below unfold one each, and column
pruning keeps the rest from being read where the folded table is written.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.operators.lines import spread
from umbra.plans.document import Prepared, Sanitiser
from umbra.plans.policy import Policy
from umbra.plans.verification import verify

_HIT = "struct<line:int,seq:int,rule:string,family:string,value:string,action:string,rendered:string>"
FOLDED = (
    f"lines array<string>, vendor string, marked boolean, hits array<{_HIT}>, "
    "identities array<struct<family:string,value:string,first_line:int>>, "
    "mapping array<struct<kind:string,original:string,pseudonym:string,alloc_order:int>>, "
    "removed array<struct<ord:int,command:string,lines:int>>, findings array<struct<line:int,check:string,text:string>>, "
    "counts map<string,bigint>, kept_counts map<string,bigint>, kept map<string,array<string>>, clashes array<string>, "
    "labels map<string,string>, label_replacements map<string,map<string,array<string>>>, error string"
)


def importable(spark: SparkSession) -> None:
    """Lets Python workers started from another directory import this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, env.get("PYTHONPATH", "")) if p)


#: documents that are folded before their rows are handed on
AT_ONCE = 256


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def fold(text: str | None, labels: list | None, policy: Policy, salt: bytes, prepared: Prepared | None = None) -> dict:
    """One document's row; a document that can't be finished gives its error and no lines."""
    try:
        o = Sanitiser(policy, salt, prepared=prepared).run(text or "", dict(labels or []))
    except ValueError as e:
        return {"error": str(e)}
    return {
        "lines": o.lines, "vendor": o.vendor, "marked": o.marked,
        "hits": [{"line": h.line, "seq": i, "rule": h.rule, "family": h.family, "value": h.value, "action": h.action, "rendered": h.rendered} for i, h in enumerate(o.hits)],
        "identities": [{"family": f, "value": v, "first_line": n} for f, v, n in o.identities],
        "mapping": [{"kind": k, "original": a, "pseudonym": b, "alloc_order": i} for k, t in o.mapping.items() for i, (a, b) in enumerate(t.items())],
        "removed": [{"ord": i, "command": c, "lines": n} for i, (c, n) in enumerate(o.removed)],
        "findings": [{"line": n, "check": c, "text": t} for n, c, t in o.findings],
        "counts": list(o.counts.items()), "kept_counts": list(o.kept_counts.items()), "kept": [(k, sorted(v)) for k, v in o.kept.items()],
        "clashes": sorted(o.clashes), "labels": list(o.labels.items()),
        "label_replacements": [(k, [(f, list(v)) for f, v in r.items()]) for k, r in o.label_replacements.items()], "error": None,
    }


def sanitise(docs: DataFrame, policy: Policy | None = None, salt: bytes = b"", text: str = "text", labels: str | None = None) -> DataFrame:
    """All columns but the text, and the folded relations. `labels` names a map of strings to rewrite alike."""
    policy = policy or Policy()
    policy.validate()
    importable(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, labels)]
    rows = docs.select(*kept, F.col(text).cast("string").alias("umbra_text"), (F.col(labels) if labels else F.lit(None).cast("map<string,string>")).alias("umbra_labels"))
    folded = T.StructType(T._parse_datatype_string(FOLDED).fields)
    schema = T.StructType([*[rows.schema[c] for c in kept], *folded.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(folded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = Prepared(policy)
        for batch in in_parts(batches):
            table = [fold(t, m, policy, salt, prepared) for t, m in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True)]
            columns = [pa.array([r.get(f.name) for r in table], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *arrow.names])

    return (rows if docs.isStreaming else spread(rows)).mapInArrow(run, schema)


def survivors(docs: DataFrame, policy: Policy | None = None, text: str = "text") -> DataFrame:
    """All columns but the text, and line, check, text of what texts still hold that the policy meant to go."""
    policy = policy or Policy()
    policy.validate()
    importable(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*kept, F.col(text).cast("string").alias("umbra_text"))
    found = "array<struct<line:int,check:string,text:string>>"
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("umbra_found", T._parse_datatype_string(found))])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema["umbra_found"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = Prepared(policy)
        for batch in in_parts(batches):
            seen = [[{"line": n, "check": c, "text": t} for n, c, t in verify((x or "").splitlines(), policy, prepared=prepared)] for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(seen, kind)], names=[*kept, "umbra_found"])

    return (rows if docs.isStreaming else spread(rows)).mapInArrow(run, schema).select(*kept, F.explode("umbra_found").alias("x")).select(*kept, "x.*")


def _unfold(folded: DataFrame, array: str, keys: list[str]) -> DataFrame:
    return folded.select(*keys, F.explode(array).alias("x")).select(*keys, "x.*")


def out_lines(folded: DataFrame, *keys: str) -> DataFrame:
    return folded.select(*keys, F.posexplode("lines").alias("at", "text")).select(*keys, (F.col("at") + 1).alias("line_no"), "text")


def hits(folded: DataFrame, *keys: str) -> DataFrame:
    return _unfold(folded, "hits", list(keys))


def findings(folded: DataFrame, *keys: str) -> DataFrame:
    return _unfold(folded, "findings", list(keys))


def identities(folded: DataFrame, *keys: str) -> DataFrame:
    return _unfold(folded, "identities", list(keys))


def mapping(folded: DataFrame, *keys: str) -> DataFrame:
    return _unfold(folded, "mapping", list(keys))


def removed_sections(folded: DataFrame, *keys: str) -> DataFrame:
    return _unfold(folded, "removed", list(keys))


def text_of(folded: DataFrame, *keys: str) -> DataFrame:
    """The output texts: a line end after each line, nothing for no line."""
    return folded.select(*keys, F.when(F.size("lines") > 0, F.concat(F.array_join("lines", "\n"), F.lit("\n"))).otherwise("").alias("text"))
