"""Documents synthesised from a template, sanitised, and expected as another template."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import corpus
from umbra.plans.policy import Policy
from umbra.queries.base import SALT, concat, register, table


def case(name: str, given: str, expected: str, policy: dict, values: dict[str, str], new: dict[str, str], changes: int) -> None:
    """Registers a query: c_custkey, the output text, and the number of changed values."""
    want = concat(expected, values | new)

    @register(name, f"SELECT c_custkey, {want} AS text, CAST({changes} AS BIGINT) AS changes FROM customer")
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(concat(given, values, True)).alias("text"))
        folded = corpus.sanitise(docs, Policy(policy), SALT)
        total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return corpus.text_of(folded.withColumn("changes", total), "c_custkey", "changes")
