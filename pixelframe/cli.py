"""Command line: segment image files with one of the operators.

    python -m pixelframe.cli otsu IN OUT
    python -m pixelframe.cli threshold IN OUT --level 100
    python -m pixelframe.cli edges IN OUT --overflow saturate
    python -m pixelframe.cli kmeans IN OUT --k 3 --rounds 20 --format jpg
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pixelframe.functions.pixel import threshold
from pixelframe.operators import convolve, histogram, kmeans
from pixelframe.sources import images, writers


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pixelframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("operator", choices=["otsu", "threshold", "edges", "kmeans"])
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--level", type=int, default=100)
    p.add_argument("--overflow", choices=["wrap", "saturate"], default="wrap")
    p.add_argument("--k", type=int, default=3)
    p.add_argument("--rounds", type=int, default=20)
    p.add_argument("--seed", type=int, help="draw starting centroids at random")
    p.add_argument("--format", choices=sorted(writers.FORMATS), default="png")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("pixelframe").getOrCreate()
    began = time.perf_counter()
    found = images.read_any(spark, a.source)
    keys = ["image_id"]
    if a.operator == "kmeans":
        out = kmeans.painted(kmeans.k_means_by_image(images.pixels(found, 3), keys, a.k, a.rounds, seed=a.seed)).drop("cluster")
    else:
        gray = images.pixels(found, 1)
        if a.operator == "otsu":
            out = histogram.otsu_binarize(gray, keys).select("image_id", "y", "x", F.col("bw").alias("v"))
        elif a.operator == "threshold":
            out = gray.withColumn("v", threshold(F.col("v"), a.level))
        else:
            out = convolve.edges(gray, keys, overflow=a.overflow).select("image_id", "y", "x", F.col("edge").alias("v"))
    writers.save(out, a.target, a.format)
    print(f"{time.perf_counter() - began:.3f} s")


if __name__ == "__main__":
    main()
