"""Watershed segmentation: flooding from markers, and the pipeline that makes the markers.

Flooding takes one pixel after another from a heap, so within an image it is one task's work; images run in parallel.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.pixel import gray_float
from pixelframe.operators.histogram import otsu_binarize
from pixelframe.operators.morphology import connected_components, distance_transform, local_maxima
from pixelframe.operators.per_image import by_image, grid

NEAR_4 = [(-1, 0), (0, -1), (0, 1), (1, 0)]
NEAR_8 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
#: Pixels of an image up to which mean shift compares all with all; larger images are gone over by offsets.
PAIRWISE = 1 << 12


def flood(pixels: DataFrame, keys: list[str], value: str = "bw", marker: str = "marker", offsets: list[tuple[int, int]] = NEAR_4) -> DataFrame:
    """(keys, y, x, label): brightest first, a pixel takes the label of its labelled neighbours if they agree.

    The neighbours of the markers are queued first. A pixel taken from the heap looks around: neighbours with a label and
    a value other than zero vote; those without a label are queued, once ever. One label among the votes is taken; several
    leave the pixel as it was (the watershed's line); none leaves it without a label. Equal values go by (y, x)."""

    def work(image: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        there = grid(image, True, False, bool)
        (h, w), light, label = there.shape, grid(image, image[value]).tolist(), grid(image, image[marker], 0, np.int64).tolist()
        around = {(y, x): [(y + dy, x + dx) for dy, dx in offsets if 0 <= y + dy < h and 0 <= x + dx < w and there[y + dy, x + dx]] for y, x in zip(image["y"].tolist(), image["x"].tolist(), strict=True)}
        heap: list[tuple[float, int, int]] = []
        marked = [(y, x) for y, x in around if label[y][x] > 0]
        queued = set(marked)
        for place in marked:
            for y, x in around[place]:
                if (y, x) not in queued:
                    queued.add((y, x))
                    heap.append((-light[y][x], y, x))
        heapq.heapify(heap)
        while heap:
            _, y, x = heapq.heappop(heap)
            votes = set()
            for ny, nx in around[y, x]:
                if label[ny][nx]:
                    if light[ny][nx]:
                        votes.add(label[ny][nx])
                elif (ny, nx) not in queued:
                    queued.add((ny, nx))
                    heapq.heappush(heap, (-light[ny][nx], ny, nx))
            if len(votes) == 1:
                label[y][x] = votes.pop()
        return {"label": np.array(label)[image["y"], image["x"]]}

    return by_image(pixels, keys, [value, marker], work, "label int")


def marker_watershed(pixels: DataFrame, keys: list[str], level: str = "level", marker: str = "marker", mask: str = "mask", offsets: list[tuple[int, int]] = NEAR_4) -> DataFrame:
    """(keys, y, x, label): markers grow over the mask in the order of the lowest level, first come first served; 0 outside."""

    def work(image: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        inside = grid(image, image[mask] != 0, False, bool)
        height, first = grid(image, image[level]).tolist(), grid(image, image[marker], 0, np.int64)
        first[~inside] = 0
        label, (h, w) = first.tolist(), inside.shape
        heap = [(height[y][x], i, y, x) for i, (y, x) in enumerate(np.argwhere(first).tolist())]
        heapq.heapify(heap)
        age = len(heap)
        while heap:
            _, _, y, x = heapq.heappop(heap)
            for dy, dx in offsets:
                ny, nx = y + dy, x + dx
                if 0 <= ny < h and 0 <= nx < w and inside[ny, nx] and not label[ny][nx]:
                    label[ny][nx] = label[y][x]
                    heapq.heappush(heap, (height[ny][nx], age, ny, nx))
                    age += 1
        return {"label": np.array(label)[image["y"], image["x"]]}

    return by_image(pixels, keys, [level, marker, mask], work, "label int")


def _near_pairs(places: np.ndarray, colors: np.ndarray, cy: np.ndarray, cx: np.ndarray, c: np.ndarray, space: int, color: float) -> tuple[np.ndarray, np.ndarray]:
    """(n, sums of y, x, r, g, b) of the pixels near each center, comparing all with all in blocks."""
    n, sums = np.zeros(len(cy)), np.zeros((len(cy), 5))
    values = np.concatenate([places, colors], 1)
    for at in range(0, len(cy), 512):
        own = slice(at, at + 512)
        d = colors[None, :, :] - c[own, None, :]
        near = (d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2 <= color * color) & (np.abs(places[None, :, 0] - np.rint(cy[own, None])) <= space) & (np.abs(places[None, :, 1] - np.rint(cx[own, None])) <= space)
        n[own], sums[own] = near.sum(1), near @ values
    return n, sums


def _near_offsets(image: np.ndarray, there: np.ndarray, cy: np.ndarray, cx: np.ndarray, c: np.ndarray, space: int, color: float) -> tuple[np.ndarray, np.ndarray]:
    """The same by going over the window's offsets, each for all centers at once."""
    n, sums = np.zeros(len(cy)), np.zeros((len(cy), 5))
    y0, x0 = np.rint(cy).astype(int), np.rint(cx).astype(int)
    h, w = there.shape
    for dy in range(-space, space + 1):
        for dx in range(-space, space + 1):
            y, x = y0 + dy, x0 + dx
            k = np.nonzero((y >= 0) & (x >= 0) & (y < h) & (x < w))[0]
            k = k[there[y[k], x[k]]]
            part = image[y[k], x[k]]
            d = part - c[k]
            near = d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2 <= color * color
            k, part = k[near], part[near]
            n[k] += 1
            sums[k] += np.stack([y[k], x[k], part[:, 0], part[:, 1], part[:, 2]], 1)
    return n, sums


def mean_shift(pixels: DataFrame, keys: list[str], space: int = 21, color: float = 51, rounds: int = 5) -> DataFrame:
    """The color pixels after mean-shift filtering: each moves to the mean of the pixels within `space` and `color` of it,
    up to `rounds` times or until it stands still. Libraries differ in pyramids and stopping rules; so may low bits."""

    def work(image: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        colors = np.stack([image[c] for c in "rgb"], 1).astype(float)
        places = np.stack([image["y"], image["x"]], 1).astype(float)
        small = len(places) <= PAIRWISE
        if not small:
            there, full = grid(image, True, False, bool), np.stack([grid(image, image[c]) for c in "rgb"], axis=-1)
        cy, cx, c = places[:, 0].copy(), places[:, 1].copy(), colors.copy()
        moving = np.arange(len(places))
        for _ in range(rounds):
            at = (cy[moving], cx[moving], c[moving])
            n, sums = _near_pairs(places, colors, *at, space, color) if small else _near_offsets(full, there, *at, space, color)
            moving, sums = moving[n > 0], (sums / np.maximum(n, 1)[:, None])[n > 0]
            moved = np.abs(sums[:, 0] - cy[moving]) + np.abs(sums[:, 1] - cx[moving]) + np.abs(sums[:, 2:] - c[moving]).sum(1)
            cy[moving], cx[moving], c[moving] = sums[:, 0], sums[:, 1], sums[:, 2:]
            moving = moving[moved >= 1]
            if not len(moving):
                break
        out = np.rint(c)
        return {"r": out[:, 0], "g": out[:, 1], "b": out[:, 2]}

    return by_image(pixels, keys, ["r", "g", "b"], work, "r int, g int, b int")


def from_mask(mask: DataFrame, keys: list[str], value: str = "v", min_distance: int = 20, border: int = 0) -> DataFrame:
    """(keys, y, x, label): distance transform of the mask, its peaks' components as markers, watershed on its negative.
    Peaks nearer than `border` to the image's border are left out; all of the mask counts as one label."""
    dist = distance_transform(mask, keys, value)
    peaks = local_maxima(dist, keys, min_distance, "dist", border=border).withColumn("v", F.lit(1))
    markers = connected_components(peaks, keys).withColumnRenamed("label", "marker")
    at = [*keys, "y", "x"]
    levels = dist.select(*at, (-F.coalesce("dist", F.lit(0.0))).alias("level"))
    full = _beside(_beside(mask.select(*at, F.col(value).alias("mask")), levels, at, "inner"), markers, at, "left").fillna(0, ["marker"])
    return marker_watershed(full, keys)


def _beside(left: DataFrame, right: DataFrame, at: list[str], how: str) -> DataFrame:
    """A join of pixels on their place, in which a null image key is an image like any other."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in at})
    joined = left.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in at], how)
    return joined.drop(*[f"__{c}" for c in at])


def pipeline(pixels: DataFrame, keys: list[str], *, smooth: bool = True, min_distance: int = 20, border: int = 0) -> DataFrame:
    """(keys, y, x, label) from color pixels: mean shift, gray, Otsu, distance transform, peaks, markers, watershed."""
    source = mean_shift(pixels, keys) if smooth else pixels
    light = source.select(*keys, "y", "x", gray_float(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    return from_mask(otsu_binarize(light, keys).select(*keys, "y", "x", "bw"), keys, "bw", min_distance, border)
