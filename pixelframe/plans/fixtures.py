"""Images made from the driver tables, in Spark and in SQL.

`gray`: events as one image 100 pixels wide; `rgb`: the same in color; `batch`: embeddings as small gray images, 8 pixels
wide; `mask`: the same places as black and white; `rgb_batch`: the same in made colors; `gray_batch`: color images of gray.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
GRAY, BATCH = ["image_id"], ["image_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {"y": F.expr(f"event_id div {WIDTH}").cast("int"), "x": (F.col("event_id") % WIDTH).cast("int"), "image_id": F.lit("events")}
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumns(place)


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("image_id", "y", "x", F.least(F.lit(255), F.floor("value")).cast("int").alias("v"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("image_id", "y", "x", F.least(F.lit(255), F.floor("value")).cast("int").alias("r"), (F.col("user_id") % 256).cast("int").alias("g"), F.second("ts").cast("int").alias("b"), F.col("event_id").alias("i"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("image_id", F.expr("p div 8").cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("e").cast("double").alias("e"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("image_id", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e") + 1) * 127.5))).cast("int").alias("v"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("image_id", "y", "x", F.when(F.col("e") > -0.1, 255).otherwise(0).alias("v"))


def rgb_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small color images; `i` numbers an image's pixels."""
    b = batch(spark, sf_dir)
    color = {"r": F.col("v"), "g": (F.col("v") * 7 + F.col("x") * 31) % 256, "b": (F.col("y") * 37 + F.col("x") * 11 + F.col("v")) % 256, "i": F.col("y") * 8 + F.col("x")}
    return b.select("image_id", "y", "x", *[c.cast("int").alias(n) for n, c in color.items()])


def gray_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).select("image_id", "y", "x", *[F.col("v").alias(c) for c in "rgb"])


SQL = f"""
gray AS (SELECT 'events' AS image_id, (event_id // {WIDTH})::INT AS y, (event_id % {WIDTH})::INT AS x, least(255, floor(value))::INT AS v FROM events),
rgb AS (SELECT 'events' AS image_id, (event_id // {WIDTH})::INT AS y, (event_id % {WIDTH})::INT AS x, least(255, floor(value))::INT AS r,
        (user_id % 256)::INT AS g, second(ts)::INT AS b, event_id AS i FROM events),
cells AS (SELECT image_id, (p // 8)::INT AS y, (p % 8)::INT AS x, e::DOUBLE AS e
          FROM (SELECT vec_id AS image_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS p FROM embeddings)),
batch AS (SELECT image_id, y, x, greatest(0, least(255, floor((e + 1) * 127.5::DOUBLE)))::INT AS v FROM cells),
mask AS (SELECT image_id, y, x, CASE WHEN e > -0.1::DOUBLE THEN 255 ELSE 0 END AS v FROM cells),
rgb_batch AS (SELECT image_id, y, x, v AS r, (v * 7 + x * 31) % 256 AS g, (y * 37 + x * 11 + v) % 256 AS b, y * 8 + x AS i FROM batch),
gray_batch AS (SELECT image_id, y, x, v AS r, v AS g, v AS b FROM batch)
"""
