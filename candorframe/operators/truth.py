"""Truth of files from fragments of their paths, where the fragments are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
GRAM = 4


def _plain(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _grams(text: Column, width: int) -> Column:
    """Distinct substrings of a text, ``width`` characters long; none where it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - width + 1)
    return F.when(F.length(text) >= width, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def label_by_fragment(media: DataFrame, path: str, truth: DataFrame) -> DataFrame:
    """``media`` with ``truth``: the label of the first row of ``truth`` (position, fragment, label), by position, whose fragment occurs in the path; NULL
    when none does, or the path is NULL. Both kinds of slashes are one; the empty fragment occurs in every path.

    A fragment can only occur where its rarest gram of four characters does, so paths and fragments meet on that gram by an equi-join, and the text is
    looked at afterwards. Fragments of fewer characters meet on themselves.
    """
    wanted = truth.where("fragment IS NOT NULL AND label IS NOT NULL").select("position", _plain(C("fragment")).alias("fragment"), "label")
    wanted = wanted.withColumn("width", F.least(F.length("fragment"), F.lit(GRAM)))
    paths = media.where(C(path).isNotNull()).select(_plain(C(path)).alias("_path")).distinct()
    cut = F.when(C("width") == 0, F.array(F.lit("")))
    for width in range(1, GRAM + 1):
        cut = cut.when(C("width") == width, _grams(C("fragment"), width))
    fragment_grams = wanted.select("position", "fragment", "label", "width", F.explode(cut).alias("gram"))
    # Widths that no fragment has are not cut out of the paths.
    widths = [r["width"] for r in wanted.select("width").distinct().collect()]  # at most GRAM + 1
    of_path = F.concat(F.array().cast("array<string>"), *[F.array(F.lit("")) if w == 0 else _grams(C("_path"), w) for w in widths])
    path_grams = paths.select("_path", F.explode(of_path).alias("gram")).join(fragment_grams.select("gram").distinct(), "gram", "left_semi")
    held = path_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("paths"))
    # A fragment with a gram that no path has occurs nowhere.
    rarest = fragment_grams.join(held, "gram", "left").groupBy("position", "fragment", "label").agg(F.min(F.struct(F.coalesce("paths", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    met = path_grams.join(rarest.select("position", "fragment", "label", C("g.gram").alias("gram")), "gram").where(F.contains("_path", "fragment"))
    first = met.groupBy("_path").agg(F.min(F.struct("position", "label"))["label"].alias("truth"))
    return media.withColumn("_path", _plain(C(path))).join(first, "_path", "left").drop("_path")
