"""Table functions for SQL: `SELECT ... FROM docs, LATERAL sanitised_lines(text)`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from umbra.operators.corpus import importable
from umbra.plans.document import sanitise_text
from umbra.plans.policy import Policy


def register(spark: SparkSession, policy: Policy, salt: bytes) -> None:
    """Registers sanitised_lines(text) and sanitised_hits(text) under one policy."""
    importable(spark)

    class Lines:
        def eval(self, text: str):
            for i, line in enumerate(sanitise_text(text or "", policy, salt).lines, 1):
                yield i, line

    class Hits:
        def eval(self, text: str):
            for h in sanitise_text(text or "", policy, salt).hits:
                yield h.line, h.rule, h.family, h.value, h.action, h.rendered

    spark.udtf.register("sanitised_lines", udtf(Lines, returnType="line_no int, line string"))
    spark.udtf.register("sanitised_hits", udtf(Hits, returnType="line int, rule string, family string, value string, action string, rendered string"))
