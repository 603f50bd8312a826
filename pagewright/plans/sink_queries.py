"""Sinks: trees of files, and streams whose batches are taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.registry import register
from pagewright.plans.session import scratch_path, table
from pagewright.sources import tree
from pagewright.streaming import events as E
from pagewright.streaming.once import DEAD, GOOD, OnceSink


@register(
    "document_tree",
    """SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || (doc_id % 10) || '/' || doc_id || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents""",
)
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as a tree of files, and read back."""
    k = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), (k % 10).cast("string"), F.concat(k.cast("string"), F.lit(".txt")))
    root = scratch_path(spark, "tree")
    tree.write_tree(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content")), root)
    return tree.read_tree(spark, root).select("path", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


#: Events as envelopes whose damage follows from what they hold: errors lose their end, low values their version, and empty properties their type.
_ENVELOPES = """SELECT event_type, CASE WHEN event_type = 'error' THEN 'malformed' WHEN value < 20 THEN 'bad_version' END AS reason FROM events"""


@register("stream_once", f"SELECT coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN event_type END AS kind, count(*) AS n FROM ({_ENVELOPES}) GROUP BY ALL")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of envelopes into a sink that sets malformed ones aside, its batches handed over a second time."""
    source = spark.readStream.schema(E.EVENT).parquet(f"{sf_dir}/events.parquet*")
    version = F.when(F.col("value") < 20, 2).otherwise(1)
    whole = F.to_json(F.struct(version.alias("version"), F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("id")))
    line = F.when(F.col("event_type") == "error", F.expr("left(w, length(w) - 3)")).otherwise(F.col("w"))
    frames = E.decode_frames(source.withColumn("w", whole).select(line.alias("value")))
    sink = OnceSink(spark, scratch_path(spark, "once"))
    take = sink.writer(F.col("reason"))

    def twice(batch: DataFrame, number: int) -> None:
        take(batch, number)
        take(batch, number)  # as after a driver that was lost between the write and the checkpoint

    frames.writeStream.option("checkpointLocation", scratch_path(spark, "once-state")).trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    good, dead = sink.read(GOOD), sink.read(DEAD)
    sums = [good.select(F.lit("").alias("reason"), F.col("frame.type").alias("kind")), dead.select("reason", F.lit(None).cast("string").alias("kind"))]
    return sums[0].unionByName(sums[1]).groupBy("reason", "kind").agg(F.count("*").alias("n"))
