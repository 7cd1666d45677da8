"""Mixing sources to target weights, by hierarchical budgets.

Method: the budget is handed down a domain-language-source tree. The children of a node share its budget by weight;
a child that can't use its share (its tokens times the allowed epochs) takes what it can, and its siblings share the
rest by weight. A node's own limit is the sum of its leaves' limits, so a shortage is redistributed among siblings and
reaches an ancestor only when all of them are full. Shares are whole numbers: what rounding leaves goes out one token
each, in the siblings' order. A leaf then takes its documents in a seeded order for each epoch: whole epochs first, and
of the last one the token-prefix that the budget covers; the document at the prefix's end is taken in part.

Orders are by a hash, and running sums are taken over the hash's first two digits, then the next two, then the rows, so
a hot leaf is summed in 65,536 parts that no task has to sort together. Only DataFrame operations.

Defined cases: a null text has no tokens; documents without tokens belong to a prefix if it reaches beyond their place
in the order; null domain, language or source is the value ``?``; a weight that is missing or below 1 counts as 1;
repeated rows are taken each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from umbra.llm.graph import without
from umbra.llm.runtime import PLACE, Scratch

LEVELS = ("domain", "lang", "source")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `given`: the column `budget` of each parent handed out to its rows by weight, none above its `most`."""
    order = [F.col("most") / F.col("weight"), F.col(name)]
    w = W.partitionBy(*parent).orderBy(*order) if parent else W.partitionBy(F.lit(0)).orderBy(*order)
    everyone = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    after = w.rowsBetween(W.currentRow, W.unboundedFollowing)
    n = nodes.withColumns({"used": F.coalesce(F.sum("most").over(before), F.lit(0)), "open": F.sum("weight").over(after)})
    n = n.withColumn("full", F.col("most") * F.col("open") <= (F.col("budget") - F.col("used")) * F.col("weight"))
    n = n.withColumns({
        "spent": F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everyone), F.lit(0)),
        "others": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone), F.lit(0)),
    })
    n = n.withColumn("given", F.when(F.col("full"), F.col("most")).otherwise(F.expr("(budget - spent) * weight div others")))
    n = n.withColumns({
        "rest": F.col("budget") - F.sum("given").over(everyone),
        "turn": F.sum(F.when(F.col("full"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)),
    })
    extra = F.when(~F.col("full") & (F.col("turn") <= F.col("rest")), 1).otherwise(0)
    return n.withColumn("given", (F.col("given") + extra).cast("bigint")).drop("used", "open", "full", "spent", "others", "rest", "turn")


def budgets(leaves: DataFrame, budget: int, epochs: int) -> DataFrame:
    """`given` for each leaf of a table with the levels, their weights (weight_<level>) and `tokens`."""
    top = None
    for depth, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * epochs).cast("bigint").alias("most"), F.max(f"weight_{level}").alias("weight"))
        nodes = nodes.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("bigint"))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("bigint")) if top is None else nodes.join(top.withColumnRenamed("given", "budget"), parent)
        top = share(nodes, parent, level).select(*keys, "given")
    return top


def mix(docs: DataFrame, weights: dict[str, Column], budget: int | None = None, part: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 17, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, epoch, tokens, take_tokens and the columns `also` for each document taken in each epoch.

    `docs` has doc_id, the levels and tokens; the budget is given or the part of all tokens; weights: by level. `also`
    breaks ties in the order, and gives rows without a doc_id their place in it.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    clean = {c: F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in LEVELS}
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[v.alias(c) for c, v in clean.items()], F.col("tokens").cast("bigint").alias("tokens"), *also)
    rows = scratch.table(rows, "rows")
    leaves = scratch.table(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).withColumns({f"weight_{c}": w for c, w in weights.items()}), "leaves")
    if budget is None:
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * part[0] // part[1]
    given = budgets(leaves, budget, epochs).join(leaves.select(*LEVELS, F.col("tokens").alias("held")), list(LEVELS)).where("held > 0")
    given = given.withColumns({"epochs": F.expr("given div held"), "prefix": F.expr("given % held")})
    given = scratch.table(given.select(*LEVELS, "epochs", "prefix"), "given")
    rows = rows.join(given, list(LEVELS))
    whole = rows.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("take_tokens", F.col("tokens"))
    last = rows.where("prefix > 0").withColumn("epoch", F.col("epochs"))
    identity = F.coalesce(F.col("doc_id").cast("string"), *[F.xxhash64(c).cast("string") for c in also], F.lit("?"))
    last = last.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), "epoch", identity).cast("binary")))
    last = last.withColumns({"head": F.substring("place", 1, 2), "part": F.substring("place", 3, 2)})
    parts = last.groupBy(*LEVELS, "head", "part").agg(F.sum("tokens").alias("sum"))
    heads = parts.groupBy(*LEVELS, "head").agg(F.sum("sum").alias("sum"))

    def before(sums: DataFrame, keys: list[str], by: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        return sums.withColumn(f"before_{by}", F.coalesce(F.sum("sum").over(w), F.lit(0))).drop("sum")

    starts = before(parts, [*LEVELS, "head"], "part").join(before(heads, list(LEVELS), "head"), [*LEVELS, "head"])
    inside = W.partitionBy(*LEVELS, "head", "part").orderBy("place", "tokens", *also).rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, [*LEVELS, "head", "part"])
    left = F.col("prefix") - F.col("before_head") - F.col("before_part") - F.col("inside")
    last = last.where(left > 0).withColumn("take_tokens", F.least("tokens", left))
    out = ["doc_id", *LEVELS, F.col("epoch").cast("int").alias("epoch"), "tokens", "take_tokens", *also]
    return scratch.finish(whole.select(*out).union(last.select(*out)))


def number_in(column: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(regexp_extract({column}, '([0-9]+)', 1) as bigint)"), F.lit(0))


def document_leaves(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The documents' tree, with the columns `also`: the domain is d0 to d3 by the source's number."""
    domain = F.concat(F.lit("d"), (number_in("source") % 4).cast("string"))
    return docs.select("doc_id", domain.alias("domain"), "lang", "source", words(F.col("text")).alias("tokens"), *also)


def document_weights() -> dict[str, Column]:
    return {
        "domain": 4 - F.substring("domain", 2, 1).cast("bigint"),
        "lang": F.when(F.col("lang") == "en", 6).when(F.col("lang").isin("fr", "de"), 2).otherwise(1),
        "source": 1 + number_in("source") % 3,
    }


def mixed(docs: DataFrame, part: tuple[int, int] = (9, 10), seed: int = 17) -> DataFrame:
    """The documents of one epoch that the budgets cover, whole: the last of a leaf's prefix isn't cut.

    Each row is taken by itself, also where doc_ids are null or repeated.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    rows = scratch.located(docs, "rows")
    leaves = document_leaves(rows, (PLACE,))
    taken = mix(leaves, document_weights(), part=part, epochs=1, seed=seed, also=(PLACE,)).where("take_tokens > 0 or tokens = 0")
    left = scratch.table(rows.select(PLACE).join(taken.select(PLACE), PLACE, "left_anti"), "left")  # the result reads it
    return without(rows, left, PLACE).select(*docs.columns)
