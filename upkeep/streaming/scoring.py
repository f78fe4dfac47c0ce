"""Streaming scoring: snapshot rows arriving as files → align / score /
classify → predictions and alerts tables, through ``foreachBatch``.

Each micro-batch writes its rows into a ``batch_id=<epoch>`` partition with
dynamic partition overwrite, so a batch replayed after a failure replaces its
own output instead of duplicating it (exactly-once effect on the sink). The
stream checkpoint lives in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.operators.score import classify, score_linear
from upkeep.operators.serving import alert_filter


def score_batch(batch: DataFrame, coefficients: dict[str, float], intercept: float, watch: float = 0.5,
                high: float = 0.8) -> DataFrame:
    scored = classify(score_linear(batch, coefficients, intercept), "probability", watch, high)
    return scored.select(
        F.col("machine_id").alias("id"), "machine_id", "probability", "predicted_class", "intervention_priority")


def _sink(out_dir: str, coefficients, intercept, watch, high):
    def write(batch: DataFrame, epoch_id: int) -> None:
        preds = score_batch(batch, coefficients, intercept, watch, high).withColumn("batch_id", F.lit(epoch_id))
        preds = preds.persist()
        for name, df in (("predictions", preds), ("alerts", alert_filter(preds))):
            (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(f"{out_dir}/{name}"))
        preds.unpersist()
    return write


def run_scoring_stream(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, checkpoint: str,
                       coefficients: dict[str, float], intercept: float, watch: float = 0.5, high: float = 0.8,
                       max_files_per_trigger: int = 1000) -> None:
    """Process every file present in ``source_dir`` (``availableNow``) and stop."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    q = (stream.writeStream.foreachBatch(_sink(out_dir, coefficients, intercept, watch, high))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
