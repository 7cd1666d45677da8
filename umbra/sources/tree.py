"""File trees as a source and a sink.

The source reads whole files as bytes through Spark, so any store that it knows will do; Spark's listing leaves out names
that begin with a dot or an underscore. A file is refused, with a reason, if a name on its way is hidden, if it holds a NUL byte, a PEM header or bytes that are no UTF-8.
The sink writes each document from the executors to a local or mounted path under another folder: to a temporary name
first, so that a repeated task leaves whole files only.
"""

from __future__ import annotations

import json
import os
import secrets
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.reports import skip_reason
from umbra.plans import structure

VERSION = "1"


def read_tree(spark: SparkSession, paths: list[str], force: bool = False) -> DataFrame:
    """path, text, crlf, reason: one row a file; text is null where a reason refuses it. Order by path is the caller's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    roots = "|".join(_quoted(p.removeprefix("file:").rstrip("/")) for p in paths)
    hidden = F.exists(F.split(F.regexp_replace("path", f"^[a-z0-9]+:/*(?={roots})(?:{roots})", ""), "/"), lambda p: p.startswith("."))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    marked = F.exists(F.slice(F.split(text, r"\r\n|\n|\r"), 1, structure.MARK_LINES), lambda x: F.contains(x, F.lit(structure.MARK)))
    reason = F.coalesce(
        skip_reason(name, F.col("content")), F.when(hidden, "dotfile"), F.when(text.isNull() & F.lit(not force), "not utf-8"), F.when(marked & F.lit(not force), "already sanitised")
    )
    plain = F.coalesce(text, F.decode("content", "ISO-8859-1"))
    return files.select(
        "path", F.when(reason.isNull(), F.regexp_replace(plain, "\r\n", "\n")).alias("text"), F.coalesce(F.contains(plain, F.lit("\r\n")), F.lit(False)).alias("crlf"), reason.alias("reason")
    )


def destination(path: Column, root: str, out: str | None, suffix: str = "", replace: bool = False) -> Column:
    """Where a file goes: itself, or the same place under another folder; with a suffix before the extension."""
    if replace:
        return path
    relative = F.regexp_replace(path, "^" + _quoted(root.rstrip("/")) + "/*", "")
    quoted = suffix.replace("\\", "\\\\").replace("$", "\\$")
    relative = F.regexp_replace(relative, r"(?s)^(.*?)(\.[^./]*)?\z", "$1" + quoted + "$2") if suffix else relative
    return F.concat(F.lit((out or root).rstrip("/") + "/"), relative)


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def collisions(placed: DataFrame) -> DataFrame:
    """Destinations that more than one file would get."""
    return placed.groupBy("dest").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")


def marked_text(lines: Column, vendor: Column, crlf: Column) -> Column:
    """Output text under its marker line, with the line ends of the input."""
    sign = F.when(vendor.isin("juniper", "mikrotik", "fortinet"), "#").otherwise("!")
    head = F.concat(sign, F.lit(structure.marker("", VERSION)[1:]))
    body = F.array_join(F.concat(F.array(head), lines), "\n")
    text = F.when(F.size(lines) > 0, F.concat(body, F.lit("\n"))).otherwise("")
    return F.when(crlf, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)


def write_tree(placed: DataFrame) -> DataFrame:
    """Writes `text` to each local or mounted `dest`; returns dest and an error, if any. One file's failure stops no other."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            errors = []
            for dest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = Path(dest.removeprefix("file://").removeprefix("file:"))
                try:
                    at.parent.mkdir(parents=True, exist_ok=True)
                    part = at.with_name(f".{at.name}.{secrets.token_hex(4)}.part")
                    part.write_bytes(text.encode())
                    os.replace(part, at)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], ["dest", "error"])

    return placed.select("dest", "text").mapInArrow(run, "dest string, error string")


def load_salt(path: str | None) -> bytes:
    """The salt of a file, made with private access if there is none; random without a file."""
    if not path:
        return secrets.token_bytes(32)
    at = Path(path)
    if not at.exists():
        with os.fdopen(os.open(at, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(secrets.token_hex(32))
    return at.read_bytes().strip()


def write_mapping(mapping: dict, path: str) -> None:
    """The mapping leads back to the originals: private, keys in order."""
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        json.dump(mapping, f, indent=2, sort_keys=True)
