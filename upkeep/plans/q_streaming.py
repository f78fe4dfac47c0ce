"""Streaming query: the snapshot arrives as files, is scored by the stream and
read back from the alerts sink (same result as the batch alert filter)."""

from __future__ import annotations

from upkeep.plans.oracle import with_ctes
from upkeep.plans.registry import query
from upkeep.plans.serving_data import LINEAR_MODELS, PRIMARY
from upkeep.sources.files import scratch_path
from upkeep.sources.testdata import asset_snapshot
from upkeep.streaming.scoring import run_scoring_stream


@query("stream_alerts", with_ctes(["predictions"], "SELECT id, machine_id, intervention_priority FROM predictions "
                                                   "WHERE intervention_priority IN ('Watch', 'High Priority')"))
def stream_alerts(spark, d):
    snap = asset_snapshot(spark, d)
    src = scratch_path(spark, "stream_src")
    snap.repartition(4).write.parquet(src)  # four files → several micro-batches
    out, ckpt = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt")
    b, w = LINEAR_MODELS[PRIMARY]
    run_scoring_stream(spark, src, snap.schema, out, ckpt, w, b, max_files_per_trigger=1)
    return spark.read.parquet(f"{out}/alerts").select("id", "machine_id", "intervention_priority")
