"""Detection, survivor checks and reports as joins, aggregates and windows."""

from __future__ import annotations

import re
from functools import reduce
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from umbra.functions.rewrite import java, let
from umbra.plans import rulebook as book
from umbra.plans.guards import ODD, needs
from umbra.plans.policy import Policy


def vendor(text: Column) -> Column:
    """The vendor with the largest sum of hint weights, each hint once; the earlier one at a tie; else unknown.

    A hint is tried only on texts that hold one of the literals which all its matches have.
    """
    low, odd = F.lower(text), text.rlike(f"[{ODD}]")

    def hint(pattern: str) -> Column:
        wanted = needs(re.compile(pattern, re.I | re.M))
        held = text.rlike("(?imU)" + pattern)
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in sorted(wanted)], odd) & held if wanted else held

    scores = [
        F.struct(sum((F.when(hint(p), w).otherwise(0) for p, w in hints), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(v).alias("vendor"))
        for i, (v, hints) in enumerate(book.VENDOR_HINTS.items())
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["vendor"]).otherwise("unknown")


def _held(low: Column, wanted: frozenset[str] | None) -> Column:
    """Whether lower-case text holds one of the literals; true where the text is null and where literals tell nothing."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in sorted(wanted)]), F.lit(True)) if wanted else F.lit(True)


def line_checks(line: Column) -> Column:
    """Names of the always-on checks that a line fails, before any masking; ignored spans are blanked first.

    The blanked line is bound once. A check is tried only on lines that hold one of its literals (blanks bring forth none
    without a space), and that are as long as its shortest match.
    """
    ignored = "|".join(book.IGNORED)

    def failed(low: Column, plain: Column, name: str, pattern: str) -> Column:
        wanted, least = needs(re.compile(pattern)), parser.parse(pattern).getwidth()[0]
        wanted = None if wanted and any(" " in x for x in wanted) else wanted
        return F.when((F.length(plain) >= least) & _held(low, wanted) & plain.rlike("(?U)" + pattern), name)

    def checked(low: Column) -> Column:
        plain = F.when(_held(low, needs(re.compile(ignored, re.I))), F.regexp_replace(line, "(?iU)" + ignored, " ")).otherwise(line)
        return let(plain, lambda x: F.array(*[failed(low, x, n, p) for n, p, _ in book.CHECKS if n != "pem-left"]))

    return F.array_compact(let(F.when(~line.rlike(f"[{ODD}]"), F.lower(line)), checked))


def top_findings(findings: DataFrame, *keys: str, k: int = 5) -> DataFrame:
    """The first k findings of each check, and how many more there are."""
    w = W.partitionBy(*keys, "check")
    ranked = findings.withColumns({"rank": F.row_number().over(w.orderBy("line", "text")), "total": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= k).withColumn("more", F.greatest(F.col("total") - k, F.lit(0))).drop("total")


def by_family(hits: DataFrame) -> DataFrame:
    """Hits by family and rule, with a total for each family and one for all."""
    return hits.rollup("family", "rule").agg(F.count("*").alias("hits"))


def redactions(hits: DataFrame, *keys: str) -> DataFrame:
    """Changed values of rule-named families for each document."""
    changed = F.col("family").isin(*book.RULE_FAMILIES) & (F.col("action") != "keep")
    return hits.groupBy(*keys).agg(F.count_if(changed).alias("redactions"))


def policy_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """section, selector, action: small by its nature, so it can be broadcast."""
    return spark.createDataFrame(policy.rows(), "section string, selector string, action string")


def dangling(declared: DataFrame, referred: DataFrame, *keys: str) -> DataFrame:
    """References whose name (without regard to case) no declaration of the same document has."""
    return referred.withColumn("low", F.lower("name")).join(declared.select(*keys, F.lower("name").alias("low")), [*keys, "low"], "left_anti").drop("low")


def skip_reason(name: Column, content: Column) -> Column:
    """Why a file isn't read as text, or null."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return (
        F.when(name.startswith("."), "dotfile")
        .when(F.decode(content, "ISO-8859-1").contains("\0"), "binary")
        .when(head.rlike(r"^\s*-----BEGIN"), "pem")
    )


def skip_tally(files: DataFrame) -> DataFrame:
    """Reasons by how often they hold, most first."""
    return files.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
