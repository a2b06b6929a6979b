"""Histograms, running sums over them, and Otsu's threshold.

Pixels are aggregated once (partly before the shuffle) to at most 256 rows per image; everything after works on those, so
no window ever runs over pixels and one large image is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.functions.pixel import threshold
from pixelframe.operators.per_image import BROADCAST_ROWS, join_images

LEVELS = 256


def histogram(pixels: DataFrame, keys: list[str], value: str = "v", dense: bool = True) -> DataFrame:
    """(keys, v, n): pixels per level; `dense` adds the levels that do not occur, with n = 0."""
    counts = pixels.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    if not dense:
        return counts.where("v is not null")
    # the levels of an image as one row, exploded: no join against a generated grid, and still one shuffle
    table = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "n")))).alias("m"))
    every = table.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    return every.select(*keys, F.col("v").cast("int").alias("v"), F.coalesce(F.col("m")[F.col("v")], F.lit(0)).cast("long").alias("n"))


def weighted(hist: DataFrame) -> DataFrame:
    """The histogram with each level's intensity sum, v * n."""
    return hist.withColumn("s", F.col("v") * F.col("n"))


def cumulative(hist: DataFrame, keys: list[str], inclusive: bool = True) -> DataFrame:
    """The histogram with running sums cum_n and cum_s (of v * n) up to a level, itself included or not."""
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = weighted(hist)
    return out.select(*keys, "v", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("cum_n"), F.coalesce(F.sum("s").over(w), F.lit(0)).alias("cum_s"))


def _cuts(hist: DataFrame, keys: list[str]) -> DataFrame:
    everything = Window.partitionBy(*keys)
    cut = cumulative(hist, keys).withColumn("n1", F.col("cum_n")).withColumn("total", F.sum("n").over(everything)).withColumn("total_s", F.sum(F.col("v") * F.col("n")).over(everything))
    cut = cut.withColumn("n2", F.col("total") - F.col("n1"))
    filled = (F.col("n1") > 0) & (F.col("n2") > 0)
    apart = F.when(filled, F.col("cum_s") / F.col("n1") - (F.col("total_s") - F.col("cum_s")) / F.col("n2"))
    return cut.select(*keys, "v", "n1", "n2", (F.col("n1").cast("double") * F.col("n2").cast("double") * (apart * apart)).alias("variance"))


def between_class_variance(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, n1, n2, variance) for every cut v that leaves both classes filled: n1 n2 (mu1 - mu2)^2, class one being the
    levels up to v. Counts and sums are exact; each mean is divided once."""
    return _cuts(hist, keys).where("variance is not null")


def otsu_threshold(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, threshold): the first cut of greatest variance, 0 for an image with a single level or none."""
    cut = F.when(F.col("variance").isNotNull(), F.struct("variance", (-F.col("v")).alias("nv")))
    best = _cuts(histogram(pixels, keys, value), keys).groupBy(*keys).agg(F.max(cut).alias("b"))
    return best.select(*keys, F.coalesce(-F.col("b.nv"), F.lit(0)).cast("int").alias("threshold"))


def otsu_binarize(pixels: DataFrame, keys: list[str], value: str = "v", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pixels with `bw`, 255 above their image's threshold and 0 elsewhere (and where there is no value)."""
    cuts = otsu_threshold(pixels, keys, value).withColumnRenamed("threshold", "__cut")
    return join_images(pixels, cuts, keys, ["__cut"], broadcast_rows).withColumn("bw", threshold(F.col(value), F.col("__cut"))).drop("__cut")
