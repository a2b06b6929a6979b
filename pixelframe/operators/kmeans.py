"""K-means on colors with a fixed number of rounds.

Starting centroids are the pixels at index i * (n div k) in the given order, or drawn from all pixels by a seed. A pixel goes to the nearest centroid by color,
ties to the lowest id; all coordinates of a centroid become its pixels' means, zeros if it has none. The last assignment
is the one before the last update. Means are doubles, or cut to whole numbers each round (mean="int").

Assignment depends on color alone, so pixels are first summed up by color (exact sums of places), and rounds run over
distinct colors. Up to ONE_TASK of them, counted, one task does all rounds in numpy; with more, a round is one aggregation
of k rows. k centroids are all that the driver sees. If a round changes nothing, the rest cannot either, and the loop ends. Up to LITERAL centroids are compared inside generated code; more go
through a blocked numpy function, whose memory is bounded by the block.

`k_means` spreads one image over all tasks. `k_means_by_image` is for many images: each is one task's work, over its
distinct colors.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.pixel import color_distance
from pixelframe.operators.per_image import by_image

LITERAL = 64
#: Distinct colors, of 48 bytes each, that one task takes for all rounds.
ONE_TASK = 1 << 18
COORDINATES = ("x", "y", "r", "g", "b")


@dataclasses.dataclass
class Result:
    """centroids: (x, y, r, g, b) after the last update; before: the ones that the last assignment used."""

    centroids: list[tuple[float, ...]]
    before: list[tuple[float, ...]]
    rounds: int


def nearest(r: Column, g: Column, b: Column, centroids: list[tuple[float, ...]]) -> Column:
    """The id of the nearest centroid by color."""
    if len(centroids) <= LITERAL:
        each = [F.struct(color_distance(r, g, b, tuple(F.lit(float(v)) for v in c[2:])).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centroids)]
        return F.array_min(F.array(*each))["c"]
    table = np.array([c[2:] for c in centroids], float)

    @F.pandas_udf("int")
    def blocked(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        p, out = np.column_stack([r, g, b]).astype(float), np.empty(len(r), np.int32)
        for at in range(0, len(p), 1024):
            d = p[at : at + 1024, None, :] - table[None, :, :]
            out[at : at + 1024] = (d[..., 0] ** 2 + d[..., 2] ** 2 + d[..., 1] ** 2).argmin(1)
        return pd.Series(out)

    return blocked(r, g, b)


def initial(pixels: DataFrame, k: int, order: str, n: int | None = None, seed: int | None = None) -> list[tuple[float, ...]]:
    """The pixels at index i * (n div k), or with a seed k drawn from all, a pixel possibly more than once; `order` is a
    dense index from 0."""
    n = pixels.count() if n is None else n
    if k < 1 or n < k:
        raise ValueError("k is at least 1 and at most the number of pixels")
    wanted = [i * (n // k) for i in range(k)] if seed is None else np.random.default_rng(seed).integers(0, n, k).tolist()
    got = {row[order]: tuple(float(row[c]) for c in COORDINATES) for row in pixels.where(F.col(order).isin(wanted)).select(order, *COORDINATES).collect()}
    return [got[i] for i in wanted]


def compact(pixels: DataFrame) -> DataFrame:
    """(r, g, b, n, sx, sy): distinct colors with their pixels and the sums of their places."""
    return pixels.groupBy("r", "g", "b").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("sx"), F.sum(F.col("y").cast("long")).alias("sy"))


def sums(colors: DataFrame, centroids: list[tuple[float, ...]]) -> DataFrame:
    """(cluster, n, x, y, r, g, b): counts and exact sums of the colors nearest to each centroid."""
    c = nearest(F.col("r"), F.col("g"), F.col("b"), centroids)
    whole = lambda name: F.sum(F.col(name).cast("long") * F.col("n")).alias(name)
    return colors.withColumn("cluster", c).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("sx").alias("x"), F.sum("sy").alias("y"), whole("r"), whole("g"), whole("b"))


def update(colors: DataFrame, centroids: list[tuple[float, ...]], mean: str = "double") -> list[tuple[float, ...]]:
    """The next centroids."""
    got = {row["cluster"]: row for row in sums(colors, centroids).collect()}
    cut = (lambda s, n: float(s // n)) if mean == "int" else (lambda s, n: s / n)
    return [tuple(cut(got[i][c], got[i]["n"]) for c in COORDINATES) if i in got else (0.0,) * 5 for i in range(len(centroids))]


def k_means(pixels: DataFrame, k: int, rounds: int, *, order: str, mean: str = "double", compacted: bool = True, seed: int | None = None) -> Result:
    """Run `rounds` rounds; pixels: x, y, r, g, b and the dense index `order`."""
    if mean not in ("double", "int"):
        raise ValueError("mean is 'double' or 'int'")
    now = before = initial(pixels, k, order, seed=seed)
    colors = (compact(pixels) if compacted else pixels.select("r", "g", "b", F.lit(1).alias("n"), F.col("x").cast("long").alias("sx"), F.col("y").cast("long").alias("sy"))).persist()
    done = 0
    try:
        if rounds > 0 and colors.count() <= ONE_TASK:
            return _in_one_task(colors, now, rounds, mean)
        for _ in range(rounds):
            before, now = now, update(colors, now, mean)
            done += 1
            if now == before:
                break
    finally:
        colors.unpersist()
    return Result(now, before, done)


def _rounds(colors: np.ndarray, counts: np.ndarray, totals: np.ndarray, now: np.ndarray, rounds: int, mean: str) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(centroids, those before, rounds done, each color's cluster) from distinct colors, their pixels, and the sums of the
    pixels' coordinates; centroids are rows of COORDINATES."""
    chosen, before = np.empty(len(colors), np.int64), now
    for done in range(1, rounds + 1):
        for at in range(0, len(colors), 1024):
            d = colors[at : at + 1024, None, :] - now[None, :, 2:]
            chosen[at : at + 1024] = (d[..., 0] ** 2 + d[..., 2] ** 2 + d[..., 1] ** 2).argmin(1)
        sums = np.zeros((len(now), 5), np.int64)
        np.add.at(sums, chosen, totals)
        members = np.zeros(len(now), np.int64)
        np.add.at(members, chosen, counts)
        members = np.maximum(1, members)[:, None]
        before, now = now, (sums // members).astype(float) if mean == "int" else sums / members
        if (now == before).all():
            break
    return now, before, done, chosen


def _in_one_task(colors: DataFrame, now: list[tuple[float, ...]], rounds: int, mean: str) -> Result:
    names = ["done", *[f"{a}{c}" for a in ("n", "b") for c in COORDINATES]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows])
        column = lambda c: held.column(c).to_numpy().astype(np.int64)
        rgb, n = np.stack([column(c) for c in "rgb"], 1), column("n")
        totals = np.concatenate([np.stack([column("sx"), column("sy")], 1), rgb * n[:, None]], 1)
        new, old, done, _ = _rounds(rgb, n, totals, np.array(now, float), rounds, mean)
        values = [np.full(len(new), done, float), *new.T, *old.T]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(new)), pa.int32()), *(pa.array(v, pa.float64()) for v in values)], ["cluster", *names])

    rows = colors.coalesce(1).mapInArrow(run, "cluster int, " + ", ".join(f"{n} double" for n in names)).orderBy("cluster").collect()
    side = lambda a: [tuple(r[f"{a}{c}"] for c in COORDINATES) for r in rows]
    return Result(side("n"), side("b"), int(rows[0]["done"]))


def k_means_by_image(pixels: DataFrame, keys: list[str], k: int, rounds: int, *, mean: str = "double", seed: int | None = None) -> DataFrame:
    """(keys, y, x, cluster, cx, cy, cr, cg, cb): each pixel's cluster, and the cluster's centroid after the last update.
    Pixels are numbered by (y, x) in their image; one with fewer than k pixels has as many centroids as pixels."""
    if mean not in ("double", "int") or k < 1 or rounds < 1:
        raise ValueError("mean is 'double' or 'int', and there is at least one centroid and one round")

    def work(image: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(image["y"])
        own = min(k, n)
        at = np.arange(own) * (n // own) if seed is None else np.random.default_rng(seed).integers(0, n, own)
        colors, of = np.unique(np.stack([image[c] for c in "rgb"], 1).astype(np.int64), axis=0, return_inverse=True)
        of = of.reshape(-1)
        counts = np.bincount(of, minlength=len(colors))
        places = np.stack([np.bincount(of, image[c], len(colors)) for c in "xy"], 1).astype(np.int64)
        totals = np.concatenate([places, colors * counts[:, None]], 1)
        start = np.stack([image[c][at] for c in COORDINATES], 1).astype(float)
        now, _, _, chosen = _rounds(colors, counts, totals, start, rounds, mean)
        cluster = chosen[of]
        return {"cluster": cluster} | {f"c{c}": now[cluster, i] for i, c in enumerate(COORDINATES)}

    return by_image(pixels, keys, ["r", "g", "b"], work, "cluster int, cx double, cy double, cr double, cg double, cb double")


def painted(clustered: DataFrame) -> DataFrame:
    """What `k_means_by_image` gives as pixels in their centroid's color, fractions cut off."""
    return clustered.withColumns({c: F.col(f"c{c}").cast("int") for c in "rgb"}).drop(*[f"c{c}" for c in COORDINATES])


def assign(pixels: DataFrame, centroids: list[tuple[float, ...]]) -> DataFrame:
    """The pixels with `cluster`."""
    return pixels.withColumn("cluster", nearest(F.col("r"), F.col("g"), F.col("b"), centroids))


def repaint(pixels: DataFrame, result: Result) -> DataFrame:
    """The pixels in their centroid's color: the last assignment, the centroids after it, fractions cut off."""
    out = assign(pixels, result.before)
    spark = pixels.sparkSession
    paint = spark.createDataFrame([(i, *(int(v) for v in c[2:])) for i, c in enumerate(result.centroids)], "cluster int, pr int, pg int, pb int")
    joined = out.drop("r", "g", "b").join(F.broadcast(paint), "cluster")  # k rows
    return joined.withColumnsRenamed({"pr": "r", "pg": "g", "pb": "b"})


def centroid_table(spark, centroids: list[tuple[float, ...]]) -> DataFrame:
    """(cluster, x, y, r, g, b, x_ref), x_ref being three times the column, the place counted in channel bytes."""
    return spark.createDataFrame([(i, *c, 3.0 * c[0]) for i, c in enumerate(centroids)], "cluster int, x double, y double, r double, g double, b double, x_ref double")


def masked(pixels: DataFrame, cluster: int) -> DataFrame:
    """The pixels with every value zero, and count zero, outside one cluster."""
    inside = F.col("cluster") == cluster
    return pixels.withColumns({c: F.when(inside, F.col(c)).otherwise(0) for c in COORDINATES} | {"count": inside.cast("int")})
