"""Distance transform, local maxima and connected components of pixel tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelframe.operators.per_image import by_image, grid, join_images
from pixelframe.tables import written


def distance_transform(mask: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, y, x, d2, dist): squared and plain Euclidean distance to the nearest zero pixel; null in an image without one.

    The distance along columns comes from windows (last and next zero). Along rows the least of (x - x')^2 + g(x')^2 is
    taken with a row as one array, so that a row is one record and no pair of pixels is ever a row of its own."""
    w = Window.partitionBy(*keys, "x").orderBy("y")
    zero = F.when(F.col(value) == 0, F.col("y"))
    up = F.col("y") - F.last(zero, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(zero, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("y")
    columns = mask.select(*keys, "y", "x", F.least(up, down).cast("long").alias("g"))
    rows = columns.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", "g"))).alias("row"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def least(xs: pd.Series, gs: pd.Series) -> pd.Series:
        far = 1 << 40

        def one(x: np.ndarray, g: np.ndarray) -> list:
            x = np.asarray(x, np.int64)
            g2 = np.array([far if v is None or v != v else int(v) ** 2 for v in g], np.int64)
            out = np.empty(len(x), np.int64)
            for at in range(0, len(x), 512):
                out[at : at + 512] = ((x[at : at + 512, None] - x[None, :]) ** 2 + g2[None, :]).min(1)
            return [None if v >= far else int(v) for v in out]

        return pd.Series([one(x, g) for x, g in zip(xs, gs, strict=True)])

    done = rows.select(*keys, "y", F.col("row.x").alias("xs"), least("row.x", "row.g").alias("ds"))
    flat = done.select(*keys, "y", F.explode(F.arrays_zip("xs", "ds")).alias("p"))
    return flat.select(*keys, "y", F.col("p.xs").alias("x"), F.col("p.ds").alias("d2"), F.sqrt(F.col("p.ds").cast("double")).alias("dist"))


def max_filter(pixels: DataFrame, keys: list[str], radius: int, value: str = "v") -> DataFrame:
    """The pixels with `top`, the greatest value within `radius` rows and columns: two passes, along rows and columns."""
    along_x = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-radius, radius)
    along_y = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-radius, radius)
    return pixels.withColumn("__t", F.max(value).over(along_x)).withColumn("top", F.max("__t").over(along_y)).drop("__t")


def local_maxima(pixels: DataFrame, keys: list[str], radius: int, value: str = "v", above: float = 0, *, border: int = 0, label: str | None = None) -> DataFrame:
    """The pixels that are the greatest within `radius` and exceed `above`. Those nearer than `border` to the first or last
    row or column of their image are left out. With `label`, a pixel is compared with those of its own label only, and
    pixels of label 0 are left out; an image is then one task's work."""
    if label is None:
        out = max_filter(pixels, keys, radius, value).where((F.col(value) == F.col("top")) & (F.col(value) > above)).drop("top")
    else:

        def work(image: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            y, x = image["y"], image["x"]
            peak = np.zeros(len(y), bool)
            for k in np.unique(image[label][image[label] != 0]):
                own = image[label] == k
                top = grid(image, np.where(own, image[value], -np.inf), -np.inf)
                for axis in (0, 1):
                    wide = np.pad(top, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
                    top = np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1, axis).max(-1)
                peak |= own & (image[value] == top[y, x]) & (image[value] > above)
            return {"__peak": peak.astype(np.int32)}

        found = by_image(pixels, keys, [value, label], work, "__peak int").where("__peak = 1").drop("__peak")
        on = [*[pixels[k].eqNullSafe(found[k]) for k in keys], pixels["y"] == found["y"], pixels["x"] == found["x"]]
        out = pixels.join(found, on, "left_semi")
    if border:  # an image's size comes from all its pixels, one row per image
        size = pixels.groupBy(*keys).agg(F.max("y").alias("__y"), F.max("x").alias("__x"))
        out = join_images(out, size, keys, ["__y", "__x"])
        out = out.where((F.col("y") >= border) & (F.col("x") >= border) & (F.col("y") <= F.col("__y") - border) & (F.col("x") <= F.col("__x") - border)).drop("__y", "__x")
    return out


def _label(y: np.ndarray, x: np.ndarray, eight: bool) -> np.ndarray:
    """Labels from 1 of places in the order of (y, x), in the order of each component's first. Runs of a row are joined to
    those of the row above that they touch."""
    new = np.ones(len(y), bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] - x[:-1] > 1)
    first = np.nonzero(new)[0]
    of, last = np.cumsum(new) - 1, np.append(first[1:], len(y)) - 1
    rows, left, right = y[first].tolist(), x[first].tolist(), x[last].tolist()
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach, above = int(eight), 0
    for i in range(len(first)):
        while rows[above] < rows[i] - 1 or (rows[above] == rows[i] - 1 and right[above] + reach < left[i]):
            above += 1
        j = above
        while rows[j] == rows[i] - 1 and left[j] <= right[i] + reach:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
            j += 1
    roots = np.array([root(i) for i in range(len(first))])
    return (np.unique(roots, return_inverse=True)[1] + 1)[of]


def connected_components(mask: DataFrame, keys: list[str], value: str = "v", eight: bool = True) -> DataFrame:
    """(keys, y, x, label): components of the nonzero pixels of each image, numbered by their first pixel. An image is one
    task's work; images too large for that go through `components_of_large`."""
    return by_image(mask.where(F.col(value) != 0), keys, [], lambda image: {"label": _label(image["y"], image["x"], eight)}, "label int")


def components_of_large(mask: DataFrame, keys: list[str], folder: str | None = None, value: str = "v", eight: bool = True, band: int = 256) -> DataFrame:
    """(keys, y, x, root): components of images of any size; root is the least (y << 32) + x of the component.

    Tiles of `band` by `band` pixels are labelled each in one task, and only the pixels on tile borders, with their tile
    labels, take part in the iteration: the least label among touching ones goes around until nothing changes. Rounds are
    written to `folder` (the shared one unless given), which all executors must see."""
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    same = lambda a, b, *more: [*[F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys], *more]
    of = lambda a: [F.col(f"{a}.{c}").alias(c) for c in keys]

    def tile(image: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        first = np.full(len(image["y"]) + 1, np.iinfo(np.int64).max)
        label, code = _label(image["y"], image["x"], eight), image["y"].astype(np.int64) * (1 << 32) + image["x"]
        np.minimum.at(first, label, code)
        return {"part": first[label]}

    tiles = mask.where(F.col(value) != 0).select(*keys, F.col("y").cast("int"), F.col("x").cast("int"), F.floor(F.col("y") / band).alias("__ty"), F.floor(F.col("x") / band).alias("__tx"))
    parts = written(by_image(tiles, [*keys, "__ty", "__tx"], [], tile, "part long").drop("__ty", "__tx"), folder)
    border = parts.where((F.col("y") % band).isin(0, band - 1) | (F.col("x") % band).isin(0, band - 1))
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("s")
    sent = border.select(*keys, "y", "x", F.col("part").alias("a"), near).select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "a")
    met = sent.alias("p").join(border.alias("q"), same("p", "q", F.col("p.y") == F.col("q.y"), F.col("p.x") == F.col("q.x")))
    links = written(met.select(*of("p"), "a", F.col("q.part").alias("b")).where("a <> b").distinct(), folder)
    both = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    roots = written(both.select(*keys, F.col("a").alias("part"), F.col("a").alias("root")).distinct(), folder)
    while True:
        heard = both.alias("p").join(roots.alias("q"), same("p", "q", F.col("p.b") == F.col("q.part"))).select(*of("p"), F.col("p.a").alias("part"), "q.root")
        least = roots.unionByName(heard).groupBy(*keys, "part").agg(F.min("root").alias("root"))
        # jump: a part takes the root of its root
        jumped = least.alias("p").join(least.alias("q"), same("p", "q", F.col("p.root") == F.col("q.part")))
        new = written(jumped.select(*of("p"), F.col("p.part").alias("part"), F.col("q.root").alias("root")), folder)
        moved = new.alias("p").join(roots.alias("q"), same("p", "q", F.col("p.part") == F.col("q.part"))).where("p.root <> q.root").limit(1).count()
        roots = new
        if not moved:
            break
    out = parts.alias("p").join(roots.alias("q"), same("p", "q", F.col("p.part") == F.col("q.part")), "left")
    return out.select(*of("p"), "p.y", "p.x", F.coalesce("q.root", "p.part").alias("root"))


def segment_count(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segments): distinct labels above zero."""
    return labels.groupBy(*keys).agg(F.countDistinct(F.when(F.col("label") > 0, F.col("label"))).alias("segments"))
