"""New artefacts since the last run, by the checkpoint of a file stream.

What a run has read is in the stream's checkpoint, so a rerun after a failure
neither loses nor repeats files; each batch's counts replace its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import prevalence
from driftlens.sources import artifacts


def update_counts(spark: SparkSession, pairs_path: str, out: str, checkpoint: str) -> int:
    """Reads the pair artefacts not read before and adds their public counts to out; gives the number of batches."""
    schema = f"schema string, tool string, generated_at string, data {artifacts.PAYLOADS['pair']}"
    stream = spark.readStream.schema(schema).option("multiLine", True).json(pairs_path)
    objects = stream.where(artifacts.is_of("pair")).select("data.id", F.explode("data.objects").alias("o"))
    batches = []

    def write(df: DataFrame, batch: int) -> None:
        prevalence.long_counts(df.select("id", F.col("o.public").alias("m")), ["id"], "m").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        batches.append(batch)

    stream_query = objects.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream_query.awaitTermination()
    return len(batches)


def counts(spark: SparkSession, out: str) -> DataFrame:
    """id, kind, n over all batches."""
    return spark.read.schema("id string, kind string, n bigint, batch int").parquet(out).groupBy("id", "kind").agg(F.sum("n").alias("n"))
