"""Streams of image files: new files in a folder are decoded, segmented and written as they come.

Images are independent of each other, so no state is kept between batches; the checkpoint holds which files are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pixelframe.operators.histogram import otsu_binarize
from pixelframe.sources.images import decoded, pixels

#: Fixed value: the columns of the binaryFile source, which a stream must be told.
FILES = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Image rows of the files that arrive in the folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return decoded(files)


def binarized(batch: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of a batch of image rows, each image split at its own Otsu threshold."""
    gray = pixels(batch, 1)
    return otsu_binarize(gray, ["image_id"]).selectExpr("image_id", "y", "x", "bw as v")


def segment_stream(images: DataFrame, out: str, checkpoint: str, segment: Callable[[DataFrame], DataFrame] = binarized, once: bool = True) -> StreamingQuery:
    """Write what `segment` makes of each batch as Parquet under `out`, one folder per batch: a batch that is run again
    replaces its own folder, so results are there exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        segment(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    started = images.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()
