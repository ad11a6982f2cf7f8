"""Ordered computation that never puts one key's whole sequence into one task.

``prefix_scan`` splits every key into chunks, works inside each chunk with ordinary window functions, and carries one summary row per
(key, chunk) across. The chunk is either given (a dense index divided by a chunk size, no extra sort) or taken from a range partitioning
on (keys, order), which splits a key that holds a third of the table over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candorframe.session import durable

CHUNK = 65_536


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def place(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` range-partitioned on (keys, order), with the partition number as ``_chunk``, kept in the checkpoint folder so that the
    number means the same thing to every later read."""
    by = [*keys, *order]
    return durable(df.repartitionByRange(_partitions(df), *by).withColumn("_chunk", F.spark_partition_id().cast("bigint")))


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    chunk: Column | None = None,
    reverse: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Adds, for every row, the totals over the rows of its key that come strictly before it in ``order``.

    ``sums``: running total (0 before the first row); ``maxes``: running maximum (NULL before the first); ``last``: the value in the row
    just before (NULL for the first). ``reverse`` looks at the rows after instead of before. ``totals`` adds ``total_<name>``, the key's sum.
    """
    sums, maxes, last = sums or {}, maxes or {}, last or {}
    src = df.withColumn("_chunk", chunk.cast("bigint")) if chunk is not None else place(df, keys, order)
    inputs = {f"_s_{n}": c for n, c in sums.items()} | {f"_m_{n}": c for n, c in maxes.items()}
    if last:
        inputs["_l"] = F.struct(*[c.alias(n) for n, c in last.items()])
    src = src.withColumns(inputs)

    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    inside = W.partitionBy(*keys, "_chunk").orderBy(*direction)
    strictly = inside.rowsBetween(W.unboundedPreceding, -1)
    local = {f"_ls_{n}": F.coalesce(F.sum(f"_s_{n}").over(strictly), F.expr("0")) for n in sums}
    local |= {f"_lm_{n}": F.max(f"_m_{n}").over(strictly) for n in maxes}
    if last:
        local["_ll"] = F.lag("_l").over(inside)
        local["_first"] = F.row_number().over(inside) == 1
    detail = src.withColumns(local)

    at = F.struct(*order)
    parts = [F.sum(f"_s_{n}").alias(f"_ps_{n}") for n in sums] + [F.max(f"_m_{n}").alias(f"_pm_{n}") for n in maxes]
    if last:
        parts.append((F.min_by("_l", at) if reverse else F.max_by("_l", at)).alias("_pl"))
    pieces = src.groupBy(*keys, "_chunk").agg(*parts)
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
    across = W.partitionBy(*keys).orderBy(chunk_order)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    carried = {f"_cs_{n}": F.sum(f"_ps_{n}").over(earlier) for n in sums}
    carried |= {f"_cm_{n}": F.max(f"_pm_{n}").over(earlier) for n in maxes}
    if last:
        carried["_cl"] = F.lag("_pl").over(across)
    if totals:
        carried |= {f"total_{n}": F.sum(f"_ps_{n}").over(W.partitionBy(*keys)) for n in sums}
    carry = pieces.withColumns(carried).select(*keys, "_chunk", *carried)

    out = detail.join(carry, [*keys, "_chunk"], "left")
    final = {n: F.col(f"_ls_{n}") + F.coalesce(F.col(f"_cs_{n}"), F.expr("0")) for n in sums}
    final |= {n: F.greatest(f"_lm_{n}", f"_cm_{n}") for n in maxes}
    if last:
        seen = F.when(F.col("_first"), F.col("_cl")).otherwise(F.col("_ll"))
        final |= {n: seen.getField(n) for n in last}
    if totals:
        final |= {f"total_{n}": F.col(f"total_{n}") for n in sums}
    return out.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def position(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Dense index 0, 1, 2 ... of every row inside its key."""
    return prefix_scan(df, keys, order, sums={name: F.lit(1).cast("bigint")})


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key (NULL and NaN left out), and ``n_measured``, how many values there were.

    Equal values are counted before the shuffle; ranks come from a prefix scan, so no task holds one key's values.
    """
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    joined = prefix_scan(counts, keys, [value], sums={"_before": F.col("_w")}, totals=True).withColumnRenamed("total__before", "_n")
    picks = []
    for name, q in quantiles.items():
        rank = F.lit(float(q)) * (F.col("_n") - 1)
        low = F.floor(rank)
        high = F.least(low + 1, F.col("_n") - 1)
        end = F.col("_before") + F.col("_w")
        picks += [
            F.max(F.when((F.col("_before") <= low) & (low < end), F.col(value))).alias(f"_a_{name}"),
            F.max(F.when((F.col("_before") <= high) & (high < end), F.col(value))).alias(f"_b_{name}"),
        ]
    picked = joined.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, q in quantiles.items():
        rank = F.lit(float(q)) * (F.col("_n") - 1)
        share = rank - F.floor(rank)
        out.append((F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * share).alias(name))
    return picked.select(*keys, *out, F.col("_n").alias("n_measured"))


def chunked_fold(df: DataFrame, keys: list[str], order: list[str], chunk: Column, fold, schema: str) -> DataFrame:
    """An order-dependent fold with bounded chunks: ``fold(rows, state) -> (rows_out, state)`` on pandas rows sorted by ``order``.

    ``state`` is any picklable value, None at the start of a key. Keys of one chunk take one pass. For longer keys every chunk is folded
    in parallel from the state its predecessor ended with in the round before, until no chunk's entry state changes; after r rounds the
    first r chunks are settled, and folds that forget their start settle in two or three.
    """
    import pickle

    import pandas as pd

    src = df.withColumn("_chunk", chunk.cast("bigint"))
    group = [*keys, "_chunk"]
    single = src.groupBy(*keys).agg(F.min("_chunk").alias("lo"), F.max("_chunk").alias("hi")).where("lo < hi").limit(1)
    if not single.take(1):

        def alone(pdf: pd.DataFrame) -> pd.DataFrame:
            return fold(pdf.sort_values(order, kind="stable").reset_index(drop=True), None)[0]

        return src.groupBy(*group).applyInPandas(alone, schema)

    types = dict(src.dtypes)
    exit_schema = ", ".join(f"`{k}` {types[k]}" for k in group) + ", exit binary"
    names = [c.split()[0].strip("`") for c in exit_schema.split(", ")]

    def entry_of(entries: pd.DataFrame):
        return pickle.loads(entries["entry"].iloc[0]) if len(entries) and entries["entry"].iloc[0] is not None else None

    def leave(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=names)
        state = fold(pdf.sort_values(order, kind="stable").reset_index(drop=True), entry_of(entries))[1]
        return pd.DataFrame([[*(pdf[g].iloc[0] for g in group), pickle.dumps(state)]], columns=names)

    def emit(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return fold(pdf.sort_values(order, kind="stable").reset_index(drop=True), entry_of(entries))[0]

    across = W.partitionBy(*keys).orderBy("_chunk")
    entries = src.select(*group).distinct().withColumn("entry", F.lit(None).cast("binary"))
    while True:
        exits = src.groupBy(*group).cogroup(entries.groupBy(*group)).applyInPandas(leave, exit_schema)
        fresh = durable(exits.select(*group, F.lag("exit").over(across).alias("entry")))
        moved = fresh.join(entries.withColumnRenamed("entry", "_was"), group, "left").where(~F.col("entry").eqNullSafe(F.col("_was")))
        settled = not moved.take(1)
        entries = fresh
        if settled:
            return src.groupBy(*group).cogroup(entries.groupBy(*group)).applyInPandas(emit, schema)
