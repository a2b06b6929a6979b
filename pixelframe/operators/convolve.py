"""Two-dimensional convolution of pixel tables.

A zero response is a positive zero. The window of a pixel begins at it and reaches right and down ([y, y + h) x [x, x + w)), is cut off at the right and lower
borders and is not weighed anew there. A pixel without a value counts as zero, and has a response like any other. Three
forms give the same numbers:

- `scatter`: each pixel is sent to the pixels whose windows hold it and summed there; any kernel, sparse images too. The
  sums are partly made before the shuffle.
- `separable`: for kernels of rank one on dense images, two passes of `lead`: along rows, then along columns. The shuffles
  carry one row per pixel, however large the kernel.
- `banded`: bands of rows as arrays, with the rows that the window reaches below repeated, handled in numpy; for large
  images, where a row per pixel is the cost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Sobel kernel for horizontal edges and its factors (down, across).
SOBEL_H = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
SOBEL_V = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
BOX = [[1, 1, 1], [1, 1, 1], [1, 1, 1]]


def factors(kernel: list[list[float]]) -> tuple[list[float], list[float]] | None:
    """(down, across) whose outer product is the kernel, or None if its rank is above one."""
    k = np.array(kernel, float)
    at = np.unravel_index(np.abs(k).argmax(), k.shape)
    if not k[at]:
        return [0.0] * k.shape[0], [0.0] * k.shape[1]
    across = k[at[0]] / k[at]
    down = k[:, at[1]]
    if not np.array_equal(np.outer(down, across), k):
        return None
    return down.tolist(), across.tolist()


def scatter(pixels: DataFrame, keys: list[str], kernel: list[list[float]], value: str = "v") -> DataFrame:
    """(keys, y, x, g): the convolution at every pixel of the input."""
    # the pixel's own place takes part with weight zero if the kernel has none, so that every pixel has a row
    taps = [(dy, dx, float(k)) for dy, row in enumerate(kernel) for dx, k in enumerate(row) if k or (dy, dx) == (0, 0)]
    parts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(k).alias("k")) for dy, dx, k in taps])
    sent = pixels.select(*keys, "y", "x", F.coalesce(F.col(value), F.lit(0)).alias("__v"), F.explode(parts).alias("t"))
    at = sent.select(*keys, (F.col("y") - F.col("t.dy")).alias("y"), (F.col("x") - F.col("t.dx")).alias("x"), (F.col("__v") * F.col("t.k")).alias("p"), ((F.col("t.dy") == 0) & (F.col("t.dx") == 0)).alias("own"))
    return at.groupBy(*keys, "y", "x").agg((F.sum("p") + F.lit(0.0)).alias("g"), F.max("own").alias("own")).where("own").drop("own")


def separable(pixels: DataFrame, keys: list[str], down: list[float], across: list[float], value: str = "v") -> DataFrame:
    """(keys, y, x, g) by a pass along rows and one along columns. Rows and columns are separate partitions, so the work is
    spread however large one image is. Needs a dense grid."""

    def reach(column: str, weights: list[float], w) -> Column:
        terms = [F.coalesce(F.lead(column, i).over(w) if i else F.col(column), F.lit(0)) * float(k) for i, k in enumerate(weights) if k]
        return sum(terms[1:], terms[0]) if terms else F.lit(0.0)

    rows = pixels.withColumn("__h", reach(value, across, Window.partitionBy(*keys, "y").orderBy("x")))
    return rows.withColumn("g", reach("__h", down, Window.partitionBy(*keys, "x").orderBy("y")) + F.lit(0.0)).select(*keys, "y", "x", "g")


def banded(pixels: DataFrame, keys: list[str], kernel: list[list[float]], value: str = "v", band: int = 64) -> DataFrame:
    """(keys, y, x, g) from bands of `band` rows; the rows below a band that its windows reach are sent to it as well. A
    task holds one band at a time."""
    k = np.array(kernel, float)
    h, w = k.shape
    own = F.floor(F.col("y") / band).cast("int")
    above = F.floor((F.col("y") - (h - 1)) / band).cast("int")
    placed = pixels.select(*keys, "y", "x", F.coalesce(F.col(value), F.lit(0)).cast("double").alias("__v"), F.explode(F.array_distinct(F.sequence(F.greatest(F.lit(0), above), own))).alias("__band"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["__band"].iloc[0]) * band
        y, x = pdf["y"].to_numpy() - first, pdf["x"].to_numpy()
        x0 = x.min()
        grid = np.zeros((max(y.max() + 1, 1) + h, x.max() - x0 + 1 + w))
        there = np.zeros(grid.shape, bool)
        grid[y, x - x0], there[y, x - x0] = pdf["__v"].to_numpy(), True
        rows, cols = min(band, grid.shape[0] - h), grid.shape[1] - w
        out = np.zeros((rows, cols))
        for i in range(h):
            for j in range(w):
                if k[i, j]:
                    out += k[i, j] * grid[i : i + rows, j : j + cols]
        ys, xs = np.nonzero(there[:rows, :cols])
        got = pd.DataFrame({"y": ys + first, "x": xs + x0, "g": out[ys, xs] + 0.0})
        for c in keys:
            got[c] = pdf[c].iloc[0]
        return got[[*keys, "y", "x", "g"]]

    shape = T.StructType([*(pixels.schema[c] for c in keys), pixels.schema["y"], pixels.schema["x"], T.StructField("g", T.DoubleType())])
    return placed.groupBy(*keys, "__band").applyInPandas(work, shape)


def convolve(pixels: DataFrame, keys: list[str], kernel: list[list[float]], value: str = "v", dense: bool = True) -> DataFrame:
    """The form that suits: separable for kernels of rank one on dense images, else scatter."""
    parts = factors(kernel) if dense else None
    return separable(pixels, keys, *parts, value) if parts else scatter(pixels, keys, kernel, value)


def edges(pixels: DataFrame, keys: list[str], kernel: list[list[float]] = SOBEL_H, value: str = "v", overflow: str = "wrap", dense: bool = True) -> DataFrame:
    """(keys, y, x, mag, edge): the response's magnitude and its eight-bit form."""
    from pixelframe.functions.pixel import narrow

    g = convolve(pixels, keys, kernel, value, dense)
    return g.select(*keys, "y", "x", F.abs("g").alias("mag"), narrow(F.col("g"), overflow).alias("edge"))
