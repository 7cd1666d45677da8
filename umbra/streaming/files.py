"""A folder of documents as a stream: each file is sanitised as it lands, once, into a Parquet table.

The transform is stateless from document to document, so append mode without a watermark holds no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbra.operators import corpus
from umbra.plans.policy import Policy


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of each text file that lands in the folder."""
    texts = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sanitised(docs: DataFrame, policy: Policy, salt: bytes) -> DataFrame:
    return corpus.sanitise(docs, policy, salt)


def run(spark: SparkSession, folder: str, table: str, checkpoint: str, policy: Policy, salt: bytes, once: bool = False) -> StreamingQuery:
    """Starts the stream; with `once` it ends when all that is there is done."""
    writer = sanitised(documents(spark, folder), policy, salt).writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
