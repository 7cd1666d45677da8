"""Lines and scopes as relations: window functions for sections and column-zero blocks, a fold over the line array for stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from umbra.functions.rewrite import java
from umbra.plans import rulebook as book

BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out to several tasks a core, by a hash of some columns (or of all that have one), so repeating a task gives the same rows.

    A scan gives all rows of a row group to one task; AQE joins parts of a shuffle by their compressed size, but not these.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    whole = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    return rows.repartition(tasks, *[F.col(c) for c in by or whole])


def lines_of(text: Column) -> Column:
    """The lines of a text as an array: all line separators, no empty element after the last one."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def explode_lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no from 1, line."""
    return docs.select(*keys, F.posexplode(lines_of(F.col(text))).alias("at", "line")).select(*keys, (F.col("at") + 1).alias("line_no"), "line")


def running(lines: DataFrame, keys: list[str], value: Column) -> Column:
    """The last non-null value up to each line of its document."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))


def column_zero_scope(lines: DataFrame, *keys: str) -> DataFrame:
    """Adds ios_scope: the block whose header stands at column zero; any other such line closes it."""
    kind = F.when(F.trim("line") == "", F.lit(None).cast("string")).when(F.col("line").rlike(r"^\s"), F.lit(None).cast("string"))
    for name, pattern in book.IOS_SCOPES:
        kind = kind.when(F.col("line").rlike(java(pattern)), name)
    return lines.withColumn("ios_scope", F.nullif(running(lines, list(keys), kind.otherwise("")), F.lit("")))


def section_scope(lines: DataFrame, *keys: str) -> DataFrame:
    """Adds section_scopes: those of the last slash-path line; an unknown path has none."""
    path = F.regexp_extract("line", java(book.SECTION, True), 1)
    kind = F.when(path == "", F.lit(None).cast("array<string>"))
    for names, pattern in book.SECTION_SCOPES:
        kind = kind.when(path.rlike(java("^" + pattern)), F.array(*[F.lit(n) for n in names]))
    return lines.withColumn("section_scopes", F.coalesce(running(lines, list(keys), kind.otherwise(F.array().cast("array<string>"))), F.array().cast("array<string>")))


def _stack(lines: Column, opened: Column, opens, closes) -> Column:
    """For each line the stack above it: opens(line) pushes a value, closes(line) pops one."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<array<string>>").alias("seen"))

    def step(acc: Column, line: Column) -> Column:
        stack = acc["stack"]
        below = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        after = F.when(opens(line), F.concat(stack, F.array(opened(line)))).when(closes(line) & (F.size(stack) > 0), below).otherwise(stack)
        return F.struct(after.alias("stack"), F.concat(acc["seen"], F.array(stack)).alias("seen"))

    return F.aggregate(lines, start, step, lambda acc: acc["seen"])


def stanza_scopes(lines: Column) -> Column:
    """For each line of an array the names of the brace stanzas around it; an opening line is outside its own."""
    return _stack(lines, lambda x: F.lower(F.regexp_extract(x, java(book.STANZA_OPEN, True), 1)), lambda x: x.rlike(java(book.STANZA_OPEN, True)), lambda x: x.rlike(java(book.STANZA_CLOSE, True)))


def config_scopes(lines: Column) -> Column:
    """For each line of an array the scopes of the `config ... end` blocks around it."""

    def named(line: Column) -> Column:
        path = F.regexp_extract(line, java(book.CONFIG_OPEN), 1)
        out = F.when(F.lit(False), "")
        for names, pattern in book.CONFIG_SCOPES:
            out = out.when(path.rlike(java(f"^(?:{pattern})$")), ",".join(names))
        return out.otherwise("")

    stacks = _stack(lines, named, lambda x: x.rlike(java(book.CONFIG_OPEN)), lambda x: x.rlike(java(book.CONFIG_END)))
    return F.transform(stacks, lambda s: F.array_distinct(F.filter(F.split(F.array_join(s, ","), ","), lambda n: n != "")))


def joined_wraps(lines: DataFrame, *keys: str) -> DataFrame:
    """Backslash-wrapped commands as one line each: islands of lines whose predecessor was wrapped."""
    w = W.partitionBy(*keys).orderBy("line_no")
    wrapped = F.col("line").rlike(r"\\$")
    opens = F.col("line").rlike(java(book.ROS_WRAP))
    n = lines.withColumns({"wrapped": wrapped, "opens": opens, "before": F.coalesce(F.lag(wrapped).over(w), F.lit(False))})
    n = n.withColumn("starts", ~F.col("before"))
    n = n.withColumn("island", F.sum(F.col("starts").cast("int")).over(w))
    first = W.partitionBy(*keys, "island").orderBy("line_no")
    n = n.withColumns({"real": F.first("opens").over(first), "last": F.max("line_no").over(W.partitionBy(*keys, "island"))})
    piece = F.when(~F.col("real") | F.col("starts"), F.col("line")).otherwise(F.ltrim("line"))
    piece = F.when(F.col("real") & F.col("wrapped") & (F.col("line_no") < F.col("last")), F.regexp_replace(piece, r"\\$", "")).otherwise(piece)
    n = n.withColumns({"piece": piece, "lead": F.when(F.col("real"), F.col("island")).otherwise(-F.col("line_no"))})
    whole = n.groupBy(*keys, "lead").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "piece"))).alias("pieces"))
    return whole.select(*keys, "line_no", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("line"))
