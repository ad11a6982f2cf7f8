"""Reading what an earlier run may have stored, and tables that are one file or a folder of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_if_there(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame | None:
    """The stored table, None when there is nothing at ``path``. Any other trouble is raised: it must not be taken for an empty store."""
    reader = spark.read.format(kind)
    try:
        return (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def need_columns(stored: DataFrame, names: list[str], path: str) -> DataFrame:
    """``stored`` cut to ``names``; refuses a store that lacks one of them."""
    missing = [n for n in names if n not in stored.columns]
    if missing:
        raise ValueError(f"{path} was not written by this operator: it has no {', '.join(missing)}")
    return stored.select(*names)


def stream_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """``<folder>/<table>.parquet`` as a stream, whether it is a file or a folder of part files."""
    name, schema = f"{table}.parquet", spark.read.parquet(f"{folder}/{table}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{folder}/{name}") if whole else reader.option("pathGlobFilter", name).parquet(folder)
