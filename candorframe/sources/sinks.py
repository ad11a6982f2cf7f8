"""Results going out, and runs that pick up where they stopped."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candorframe.functions.textscan import formula_safe
from candorframe.session import durable
from candorframe.sources.stored import need_columns, read_if_there

C = F.col


def pending_inputs(inputs: DataFrame, log: DataFrame, key: str = "path") -> DataFrame:
    """Inputs that are not in the result log yet."""
    return inputs.join(log.select(key).distinct(), key, "left_anti")


def log_rows(scored: DataFrame) -> DataFrame:
    """Scored rows as log records: a failed one has the verdict ERROR and its message cut to 200 characters."""
    return scored.select(
        "path", F.when(C("success"), C("label")).otherwise("ERROR").alias("verdict"), "ai_pct", F.when(~C("success"), F.substring(F.coalesce("error", F.lit("")), 1, 200)).alias("error")
    )


def append_results(inputs: DataFrame, log_path: str, score, limit: int = 0) -> DataFrame:
    """Score what the log does not hold and append it as JSON lines; returns the rows that were appended.

    ``score`` takes the pending inputs and returns path, label, ai_pct, success, error. ``limit`` stops early on purpose (0 = no limit).
    """
    spark = inputs.sparkSession
    schema = "path string, verdict string, ai_pct double, error string, batch string"
    log = read_if_there(spark, log_path, "json", schema)
    log = spark.createDataFrame([], schema) if log is None else log
    todo = pending_inputs(inputs, log)
    if limit:
        todo = todo.orderBy("path").limit(limit)
    batch = str(spark.sql("SELECT uuid()").first()[0])
    log_rows(score(todo)).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").json(log_path)
    # The batch is a folder of the log; nothing else is read again.
    mine = read_if_there(spark, log_path, "json", schema)
    return mine.where(C("batch") == batch).drop("batch")


BANK = "sample_id bigint, label int, sha256 string, embedding array<float>, measured array<double>, version bigint, fingerprint string"
BANK_FILE_ROWS = 200_000


def read_bank(spark: SparkSession, bank_path: str) -> DataFrame:
    """The bank's rows: of the rows written for one content and backbone fingerprint the newest; a sample with an empty hash is told by its id."""
    stored = read_if_there(spark, bank_path, "parquet")
    names = [c.split()[0] for c in BANK.split(", ")]
    stored = spark.createDataFrame([], BANK) if stored is None else need_columns(stored, names, bank_path)
    key = F.when(C("sha256") != "", C("sha256")).otherwise(F.concat(F.lit("#"), C("sample_id").cast("string")))
    newest = stored.groupBy("fingerprint", key.alias("_k")).agg(F.max_by(F.struct("sample_id", "label", "sha256", "embedding", "measured", "version"), F.struct("version", "sample_id")).alias("r"))
    return newest.select("r.*", C("fingerprint").cast("string").alias("fingerprint")).select(names)


def bank_merge(samples: DataFrame, bank: DataFrame, fingerprint: str) -> DataFrame:
    """``samples`` (sample_id, label, sha256) with the stored embedding and measurements where hash and backbone fingerprint match, ``reused``, and
    ``relabelled`` where the stored label is another.

    A sample with an empty hash is never reused. ``bank`` has one row per hash, so repeated content cannot multiply rows.
    """
    known = bank.where((C("fingerprint") == fingerprint) & (C("sha256") != "")).groupBy("sha256").agg(F.first(F.struct("embedding", "measured", "label")).alias("_b"))
    out = samples.join(known, "sha256", "left").withColumn("reused", C("_b").isNotNull())
    return out.select("*", "_b.embedding", "_b.measured", (C("reused") & ~C("_b.label").eqNullSafe(C("label"))).alias("relabelled")).drop("_b")


def feature_bank_upsert(samples: DataFrame, bank_path: str, fingerprint: str, extract) -> DataFrame:
    """Append to the bank of one fingerprint what it does not hold yet: stored rows are reused, ``extract`` computes embedding (and, if it likes, an
    array ``measured``) of the others; a row it cannot compute has a NULL embedding and is left out. Returns one row with processed and reused.

    A call writes new and relabelled rows only, in files of their own; the newest row of a content wins when the bank is read. ``compact_bank``
    drops what is superseded.
    """
    spark = samples.sparkSession
    merged = bank_merge(samples, read_bank(spark, bank_path), fingerprint)
    fresh = extract(merged.where("NOT reused").drop("embedding", "measured")).where("embedding IS NOT NULL")
    fresh = fresh if "measured" in fresh.columns else fresh.withColumn("measured", F.lit(None).cast("array<double>"))
    rows = ["sample_id", "label", "sha256", C("embedding").cast("array<float>").alias("embedding"), C("measured").cast("array<double>").alias("measured")]
    delta = durable(fresh.select(*rows, F.lit(True).alias("_new")).unionByName(merged.where("relabelled").select(*rows, F.lit(False).alias("_new"))))
    counts = delta.agg(F.count(F.lit(1)).alias("n"), F.count_if("_new").alias("fresh")).first()
    if counts["n"]:
        out = delta.drop("_new").withColumns({"version": F.lit(time.time_ns()), "fingerprint": F.lit(fingerprint)})
        out.repartition(-(-counts["n"] // BANK_FILE_ROWS), "sha256").write.mode("append").partitionBy("fingerprint").parquet(bank_path)
    return merged.agg((F.count_if("reused") + counts["fresh"]).alias("processed"), F.count_if("reused").alias("reused"))


def compact_bank(spark: SparkSession, bank_path: str) -> None:
    """Rewrite every fingerprint's files as one set of its newest rows. Reading the bank gives the same before and after."""
    rows = durable(read_bank(spark, bank_path))
    files = -(-rows.count() // BANK_FILE_ROWS) or 1
    rows.repartition(files, "fingerprint", "sha256").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(bank_path)


def export_batch_csv(table: DataFrame, path: str) -> None:
    formula_safe(table).write.mode("overwrite").option("header", True).csv(path)


def report_objects(results: DataFrame) -> DataFrame:
    """(report): one JSON object per successful file. Input: filename, success, decision (struct)."""
    return results.where("success").select(F.to_json(F.struct(C("filename").alias("file"), "decision")).alias("report"))


def export_reports_json(results: DataFrame, path: str) -> None:
    report_objects(results).write.mode("overwrite").text(path)
