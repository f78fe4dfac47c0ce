"""Peer-adjusted view (G1-G2): display of externally computed peer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions.columns import to_double
from upkeep.schema import PEER_FIELDS, PEER_NUMERIC


def has_peer_data(df: DataFrame) -> DataFrame:
    """One row: any peer field present and non-null, and how many are."""
    present = [c for c in PEER_FIELDS if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([(False, 0)], "has_peer_data boolean, n_fields_populated bigint")
    flags = df.agg(*[(F.count(c) > 0).cast("int").alias(c) for c in present])
    n = sum((F.col(c) for c in present[1:]), F.col(present[0]))
    return flags.select((n > 0).alias("has_peer_data"), n.cast("bigint").alias("n_fields_populated"))


def peer_view(df: DataFrame) -> DataFrame:
    """machine_id plus the peer fields present; numeric ones coerced (text
    sentinels → NULL), flags and labels as they are."""
    types = dict(df.dtypes)
    cols = [F.col("machine_id")] if "machine_id" in df.columns else []
    for c in PEER_FIELDS:
        if c not in df.columns:
            continue
        cols.append(to_double(F.col(c), types[c]).alias(c) if c in PEER_NUMERIC else F.col(c))
    return df.select(*cols)
