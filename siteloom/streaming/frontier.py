"""The frontier as a stream: addresses come in files, each key is handed on once, writes go through one committed batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import urls


def new_addresses(stream: DataFrame) -> DataFrame:
    """Stream of (seq, url): the keys not seen before, held in the state store."""
    return stream.withColumn("key", urls.protocol_key(urls.without_hash_and_auth(F.col("url")))).dropDuplicates(["key"])


def run_available(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> DataFrame:
    """Reads what lies under source, writes new addresses under sink; a restart goes on from the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")  # noqa: E731  a batch written again replaces itself
    query = new_addresses(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)


def resource_events(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a stream of (url, pageUrl): resources by address without fragment, once, and a referrer (url, pageUrl) for every row."""
    bare = stream.withColumn("url", urls.without_hash(F.col("url")))
    return bare.drop("pageUrl").dropDuplicates(["url"]), bare.select("url", "pageUrl")
