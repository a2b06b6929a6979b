"""What operators on single images share: work in numpy on one image after another, and joins with one row per image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows, one per image, that come to the driver and are broadcast from there; more are joined on the image.
BROADCAST_ROWS = 100_000


def join_images(pixels: DataFrame, images: DataFrame, keys: list[str], names: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pixels with the columns `names` of their image; null keys are an image like any other. Up to `broadcast_rows`
    images are broadcast, so that pixels are not shuffled and the images' rows are computed once."""
    spark, side = pixels.sparkSession, images.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *names)
    found = side.limit(broadcast_rows + 1).toArrow()
    side = F.broadcast(spark.createDataFrame(found, side.schema)) if found.num_rows <= broadcast_rows else side.hint("merge")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return (pixels.join(side, on) if on else pixels.crossJoin(side)).select(*[pixels[c] for c in pixels.columns], *names)


class Images:
    """Some whole images of one task: the columns of their rows, and where each begins and ends."""

    def __init__(self, parts: list[pa.RecordBatch], keys: list[str]) -> None:
        self.table = pa.Table.from_batches(parts).combine_chunks()
        self.starts = starts(self.table, keys) if self.table.num_rows else np.empty(0, np.int64)

    def each(self, columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
        """One image after another, nulls as zero."""
        values = {c: np.nan_to_num(self.table.column(c).to_numpy()) for c in columns}
        for a, b in zip(self.starts, [*self.starts[1:], self.table.num_rows], strict=True):
            yield {c: v[a:b] for c, v in values.items()}


def starts(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows at which images begin."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        column = table.column(k)
        codes = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.nonzero(new)[0]


def whole_images(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[Images]:
    """Batches of rows that stand together by image, cut anew so that no image is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(starts(batch, keys)[-1])
        goes_on = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if last:
            yield Images([*held, batch.slice(0, last)], keys)
            held = [batch.slice(last)]
        elif goes_on:
            held.append(batch)
        else:
            if held:
                yield Images(held, keys)
            held = [batch]
    if held:
        yield Images(held, keys)


def together(pixels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, y, x, columns) with each image's rows in one partition, in the order of (y, x)."""
    src = pixels.select(*keys, "y", "x", *columns)
    return (src.repartition(*keys) if keys else src.coalesce(1)).sortWithinPartitions(*keys, "y", "x")


def by_image(pixels: DataFrame, keys: list[str], columns: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], fields: str) -> DataFrame:
    """(keys, y, x, fields): `work` gets one image's y, x and columns in the order of (y, x), nulls as zero, and gives the
    fields of each pixel. Many small images go through one call; a large one is held whole by one task."""
    dealt, more = together(pixels, keys, columns), T.StructType.fromDDL(fields).fields
    kinds = {f.name: pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32() for f in more}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for images in whole_images(batches, keys):
            got, out = [work(i) for i in images.each(["y", "x", *columns])], images.table.select([*keys, "y", "x"])
            for name, kind in kinds.items():
                out = out.append_column(name, pa.array(np.concatenate([g[name] for g in got]), kind))
            yield from out.to_batches(max_chunksize=50_000)

    return dealt.mapInArrow(run, T.StructType([*(dealt.schema[c] for c in (*keys, "y", "x")), *more]))


def grid(image: dict[str, np.ndarray], values: np.ndarray | int, fill: float = 0, kind: type = float) -> np.ndarray:
    """An image's values as an array from place (0, 0)."""
    out = np.full((int(image["y"].max()) + 1, int(image["x"].max()) + 1), fill, kind)
    out[image["y"], image["x"]] = values
    return out


def flip_vertical(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels with rows counted from below, each image by its own height."""
    last = pixels.groupBy(*keys).agg(F.max("y").alias("__last"))
    return join_images(pixels, last, keys, ["__last"]).withColumn("y", (F.col("__last") - F.col("y")).cast("int")).drop("__last")
