"""Streams: corrections that update a calibration, and a landing folder whose files are scored once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candorframe.operators.feedback import RULES, calibrate
from candorframe.sources.stored import need_columns, read_if_there
from candorframe.functions.whitespace import strip

C = F.col

#: Buckets of contents in the store of corrections.
BUCKETS = 64


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the session's checkpoints, which every executor can reach."""
    from candorframe.session import checkpoint_root

    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stream_feedback(source: DataFrame, store: str, checkpoint: str, order: list[str], *, available_now: bool = True) -> StreamingQuery:
    """Append each new (content, answer) once to the stored table of corrections.

    ``source`` streams sha256, user_label, modality and measurements. Duplicates are looked up in the stored table, so a pair counts once
    ever, not once per watermark. A stored row belongs to the query, named by its checkpoint, and the batch that wrote it: a batch replayed after
    a failure overwrites its own rows and nothing else, and a query with a new checkpoint counts what older ones stored as seen. The store is cut
    into buckets of contents, and only those that a batch touches are read.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        answers = batch.withColumn("user_label", F.upper(strip("user_label"))).where(C("user_label").isin("AI", "REAL"))
        keys = ["modality", "sha256", "user_label"]
        rest = [c for c in answers.columns if c not in keys and c not in order]
        first = answers.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")
        first = first.withColumn("bucket", F.pmod(F.xxhash64("sha256"), F.lit(BUCKETS)).cast("int"))
        old = read_if_there(spark, store, "parquet")
        if old is not None:
            touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # at most BUCKETS
            own = (C("query_id") == query) & (C("batch_id") == batch_id)
            seen = need_columns(old, [*keys, "bucket", "query_id", "batch_id"], store).where(C("bucket").isin(touched) & ~own)
            first = first.join(seen.select(*keys).distinct(), keys, "left_anti")
        out = first.withColumn("query_id", F.lit(query)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "query_id", "batch_id").parquet(store)

    writer = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def calibration_state(spark: SparkSession, store: str, order: list[str]) -> DataFrame:
    """Calibration of every modality from the stored corrections."""
    stored = spark.read.parquet(store)
    out = None
    for modality in RULES:
        one = calibrate(stored.where(C("modality") == modality), modality, order).withColumn("modality", F.lit(modality))
        out = one if out is None else out.unionByName(one)
    return out


def stream_scoring(landing: DataFrame, score, results: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Score every new file of a landing folder once and append the result; the checkpoint makes a restart resume."""
    writer = score(landing).writeStream.format("parquet").option("path", results).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
