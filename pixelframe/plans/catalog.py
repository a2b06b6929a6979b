"""The registry of queries and their SQL.

Each entry of `_entries` is (name, query, SQL after the fixtures' WITH clause, or None where SQL cannot say it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions import pixel as P
from pixelframe.operators import convolve, histogram, kmeans, morphology, per_image, report, watershed
from pixelframe.plans import fixtures
from pixelframe.plans.fixtures import SQL
from pixelframe.sources import images, writers

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["image_id"]
THRESHOLD, K, ROUNDS = 100, 3, 5
SHARP = [[0, -1, 0], [-1, 5, -1], [0, -1, 0]]

_HIST = "h AS (SELECT g.image_id, l.v::INT AS v, count(p.v) AS n FROM (SELECT DISTINCT image_id FROM {t}) g CROSS JOIN range(256) l(v) LEFT JOIN {t} p ON p.image_id = g.image_id AND p.v = l.v GROUP BY ALL)"
_CUTS = """c AS (SELECT *, sum(n) OVER up AS n1, sum(v * n) OVER up AS s1, sum(n) OVER everything AS nt, sum(v * n) OVER everything AS st FROM h
 WINDOW up AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), everything AS (PARTITION BY image_id)),
var AS (SELECT image_id, v, n1, nt - n1 AS n2, n1::DOUBLE * (nt - n1)::DOUBLE * ((s1::DOUBLE / n1 - (st - s1)::DOUBLE / (nt - n1)) * (s1::DOUBLE / n1 - (st - s1)::DOUBLE / (nt - n1))) AS variance
 FROM c WHERE n1 > 0 AND nt - n1 > 0),
t AS (SELECT i.image_id, coalesce(b.v, 0)::INT AS threshold FROM (SELECT DISTINCT image_id FROM h) i
 LEFT JOIN (SELECT image_id, v FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY variance DESC, v) AS k FROM var) WHERE k = 1) b USING (image_id))"""


def _with(*more: str, then: str) -> str:
    return f"WITH {SQL}, " + ", ".join(more) + f" {then}" if more else f"WITH {SQL} {then}"


def _conv_sql(kernel: list[list[float]], table: str = "gray") -> str:
    """The convolution as a sum over the taps' joins."""
    taps = ", ".join(f"({i}, {j}, {float(k)}::DOUBLE)" for i, row in enumerate(kernel) for j, k in enumerate(row) if k)
    return f"g AS (SELECT a.image_id, a.y, a.x, sum(coalesce(b.v, 0) * k.k) AS g FROM {table} a CROSS JOIN (VALUES {taps}) k(dy, dx, k) LEFT JOIN {table} b ON b.image_id = a.image_id AND b.y = a.y + k.dy AND b.x = a.x + k.dx GROUP BY ALL)"


def _kmeans_sql(rounds: int, mean: str = "double") -> str:
    """Centroids m0, m1, … and the assignments a1, a2, … between them."""
    out = [f"n AS (SELECT count(*) AS n FROM rgb), m0 AS (SELECT (i // (n // {K}))::INT AS cluster, x::DOUBLE AS x, y::DOUBLE AS y, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM rgb, n WHERE i IN (SELECT j * (n // {K}) FROM range({K}) t(j)))"]
    for t in range(1, rounds + 1):
        d = "(p.r - m.r) * (p.r - m.r) + (p.b - m.b) * (p.b - m.b) + (p.g - m.g) * (p.g - m.g)"
        out.append(f"a{t} AS (SELECT i, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.r) AS r, any_value(p.g) AS g, any_value(p.b) AS b, (min({{'d': {d}, 'c': m.cluster}})).c AS cluster FROM rgb p, m{t - 1} m GROUP BY i)")
        div = (lambda c: f"(coalesce(sum(a.{c}), 0) // greatest(count(a.i), 1))::DOUBLE AS {c}") if mean == "int" else (lambda c: f"coalesce(sum(a.{c}), 0)::DOUBLE / greatest(count(a.i), 1) AS {c}")
        out.append(f"m{t} AS (SELECT m.cluster, {', '.join(div(c) for c in 'xyrgb')} FROM m{t - 1} m LEFT JOIN a{t} a ON a.cluster = m.cluster GROUP BY m.cluster)")
    return ", ".join(out)


def _kmeans(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS, mean: str = "double") -> tuple[DataFrame, kmeans.Result]:
    px = fixtures.rgb(spark, sf_dir)
    return px, kmeans.k_means(px, K, rounds, order="i", mean=mean)


def _edge(px: DataFrame, **options) -> DataFrame:
    return convolve.edges(px, KEYS, **options)


def _labels(s: SparkSession, d: str) -> DataFrame:
    return morphology.connected_components(fixtures.mask(s, d), KEYS)


def _edt(s: SparkSession, d: str) -> DataFrame:
    return morphology.distance_transform(fixtures.mask(s, d), KEYS)


def _flood(s: SparkSession, d: str) -> DataFrame:
    px = fixtures.batch(s, d)
    seeds = F.when((F.col("y") == 1) & (F.col("x") == 1), 1).when((F.col("y") == 6) & (F.col("x") == 6), 2).otherwise(0)
    return watershed.flood(px.withColumn("marker", seeds), KEYS, "v")


def _pipeline(s: SparkSession, d: str) -> DataFrame:
    return watershed.pipeline(fixtures.gray_batch(s, d), KEYS, min_distance=2)


def _files(px: DataFrame, fmt: str, depth: int | str = 8) -> DataFrame:
    """Image rows of the pixels as files of a format, made and read in one plan."""
    return images.decoded(writers.encode(px, fmt).selectExpr("image_id AS path", "file AS content"), depth=depth)


def _kmeans_by_sql(rounds: int) -> str:
    out = [f"n AS (SELECT image_id, count(*) AS n FROM rgb_batch GROUP BY image_id), m0 AS (SELECT image_id, (i // (n // {K}))::INT AS cluster, x::DOUBLE AS x, y::DOUBLE AS y, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM rgb_batch JOIN n USING (image_id) WHERE i % (n // {K}) = 0 AND i // (n // {K}) < {K})"]
    for t in range(1, rounds + 1):
        d = "(p.r - m.r) * (p.r - m.r) + (p.b - m.b) * (p.b - m.b) + (p.g - m.g) * (p.g - m.g)"
        out.append(f"a{t} AS MATERIALIZED (SELECT p.image_id, i, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.r) AS r, any_value(p.g) AS g, any_value(p.b) AS b, (min({{'d': {d}, 'c': m.cluster}})).c AS cluster FROM rgb_batch p JOIN m{t - 1} m USING (image_id) GROUP BY p.image_id, i)")
        means = ", ".join(f"coalesce(sum(a.{c}), 0)::DOUBLE / greatest(count(a.i), 1) AS {c}" for c in "xyrgb")
        out.append(f"m{t} AS MATERIALIZED (SELECT m.image_id, m.cluster, {means} FROM m{t - 1} m LEFT JOIN a{t} a ON a.cluster = m.cluster AND a.image_id = m.image_id GROUP BY m.image_id, m.cluster)")
    return ", ".join(out)


def _shift_sql(t: str, rounds: int = 5, color: int = 51) -> str:
    """`shifted`: mean shift of images no larger than the window; s0, s1, … are the centers after each round."""
    out = [f"s0 AS MATERIALIZED (SELECT image_id, y, x, y::DOUBLE AS cy, x::DOUBLE AS cx, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, false AS still FROM {t})"]
    for k in range(1, rounds + 1):
        near = f"(p.r - s.r) * (p.r - s.r) + (p.g - s.g) * (p.g - s.g) + (p.b - s.b) * (p.b - s.b) <= {color * color}"
        mean = ", ".join(f"sum(p.{c})::DOUBLE / count(*) AS n{c}" for c in "yxrgb")
        moved = "abs(ny - cy) + abs(nx - cx) + ((abs(nr - r) + abs(ng - g)) + abs(nb - b)) < 1"
        out.append(f"n{k} AS MATERIALIZED (SELECT s.image_id, s.y, s.x, {mean} FROM s{k - 1} s JOIN {t} p ON p.image_id = s.image_id AND NOT s.still AND {near} GROUP BY s.image_id, s.y, s.x)")
        out.append(f"s{k} AS MATERIALIZED (SELECT s.image_id, s.y, s.x, coalesce(ny, cy) AS cy, coalesce(nx, cx) AS cx, coalesce(nr, r) AS r, coalesce(ng, g) AS g, coalesce(nb, b) AS b, n.image_id IS NULL OR {moved} AS still FROM s{k - 1} s LEFT JOIN n{k} n ON n.image_id = s.image_id AND n.y = s.y AND n.x = s.x)")
    return ", ".join(out) + f", shifted AS MATERIALIZED (SELECT image_id, y, x, round_even(r, 0)::INT AS r, round_even(g, 0)::INT AS g, round_even(b, 0)::INT AS b FROM s{rounds})"


#: Images of 8 by 8 as lists of 64; each step takes the next place of a heap that is held as lists.
_FLOOD = """start AS (SELECT image_id, list(v ORDER BY y, x) AS light FROM batch GROUP BY image_id),
marked AS (SELECT image_id, light, [CASE i WHEN 9 THEN 1 WHEN 54 THEN 2 ELSE 0 END FOR i IN range(64)] AS lab, [(CASE WHEN i IN (1, 8, 10, 17, 46, 53, 55, 62) THEN 1 ELSE 0 END) FOR i IN range(64)] AS queued,
 [0 FOR i IN range(64)] AS done FROM start),
f AS (SELECT image_id, light, lab, [CASE WHEN i IN (9, 54) THEN 1 ELSE queued[i + 1] END FOR i IN range(64)] AS queued, [CASE WHEN i IN (9, 54) THEN 1 ELSE 0 END FOR i IN range(64)] AS done, 0 AS step FROM marked
 UNION ALL
 SELECT image_id, light, CASE WHEN len(votes) = 1 THEN [CASE WHEN i = p THEN votes[1] ELSE lab[i + 1] END FOR i IN range(64)] ELSE lab END,
  [CASE WHEN list_contains(nb, i) AND lab[i + 1] = 0 THEN 1 ELSE queued[i + 1] END FOR i IN range(64)], [CASE WHEN i = p THEN 1 ELSE done[i + 1] END FOR i IN range(64)], step + 1
 FROM (SELECT *, list_distinct([lab[j + 1] FOR j IN nb IF lab[j + 1] > 0 AND light[j + 1] <> 0]) AS votes FROM
  (SELECT *, [j FOR j IN range(64) IF abs(j // 8 - p // 8) + abs(j % 8 - p % 8) = 1] AS nb FROM
   (SELECT *, list_min([(255 - light[i + 1]) * 64 + i FOR i IN range(64) IF queued[i + 1] = 1 AND done[i + 1] = 0]) % 64 AS p FROM f) WHERE p IS NOT NULL))),
last AS (SELECT image_id, arg_max(lab, step) AS lab FROM f GROUP BY image_id)"""
_GROW = """start AS (SELECT m.image_id, list(-coalesce(e.dist, 0.0::DOUBLE) ORDER BY m.y, m.x) AS height, list(m.v <> 0 ORDER BY m.y, m.x) AS inside,
  list(coalesce(l.label, 0) ORDER BY m.y, m.x) AS lab FROM mask2 m JOIN e USING (image_id, y, x) LEFT JOIN l USING (image_id, y, x) GROUP BY m.image_id),
w AS (SELECT image_id, height, inside, lab, [CASE WHEN lab[i + 1] > 0 THEN i + 1 ELSE 0 END FOR i IN range(64)] AS age, [0 FOR i IN range(64)] AS done, 100 AS nxt FROM start
 UNION ALL
 SELECT image_id, height, inside, [CASE WHEN list_contains(nb, i) THEN lab[p + 1] ELSE lab[i + 1] END FOR i IN range(64)], [CASE WHEN list_contains(nb, i) THEN nxt + list_position(nb, i) ELSE age[i + 1] END FOR i IN range(64)],
  [CASE WHEN i = p THEN 1 ELSE done[i + 1] END FOR i IN range(64)], nxt + 10
 FROM (SELECT *, [j FOR j IN range(64) IF abs(j // 8 - p // 8) + abs(j % 8 - p % 8) = 1 AND inside[j + 1] AND lab[j + 1] = 0] AS nb FROM
  (SELECT *, (list_sort([{'h': height[i + 1], 'a': age[i + 1], 'p': i} FOR i IN range(64) IF age[i + 1] > 0 AND done[i + 1] = 0])[1]).p AS p FROM w) WHERE p IS NOT NULL)),
last AS (SELECT image_id, arg_max(lab, nxt) AS lab FROM w GROUP BY image_id)"""
_SPREAD = "SELECT image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, lab[i + 1]::INT AS label FROM (SELECT image_id, lab, unnest(range(64)) AS i FROM last)"


_DIST = """d AS (SELECT a.image_id, a.y, a.x, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2
 FROM {t} a LEFT JOIN {t} b ON a.image_id = b.image_id AND b.v = 0 GROUP BY ALL),
e AS (SELECT image_id, y, x, d2::BIGINT AS d2, sqrt(d2::DOUBLE) AS dist FROM d)"""
_TOP = "top AS (SELECT a.image_id, a.y, a.x, any_value(a.{c}) AS {c}, max(b.{c}) AS top FROM {t} a JOIN {t} b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.image_id, a.y, a.x)"
_PARTS = """RECURSIVE_r AS (SELECT image_id, y, x, y * 8 + x AS f FROM {t} WHERE v <> 0
 UNION SELECT m.image_id, m.y, m.x, r.f FROM RECURSIVE_r r JOIN {t} m ON m.image_id = r.image_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1 AND m.v <> 0 AND r.f < m.y * 8 + m.x),
l AS (SELECT image_id, y, x, (dense_rank() OVER (PARTITION BY image_id ORDER BY f))::INT AS label FROM (SELECT image_id, y, x, min(f) AS f FROM RECURSIVE_r GROUP BY ALL))"""


def _parts_sql(then: str) -> str:
    return f"WITH RECURSIVE {SQL}, {_PARTS.format(t='mask')} {then}"


def _pipeline_sql() -> str:
    steps = [
        _shift_sql("gray_batch"), "light AS MATERIALIZED (SELECT image_id, y, x, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)::INT AS v FROM shifted)",
        _HIST.format(t="light"), _CUTS, "mask2 AS MATERIALIZED (SELECT light.image_id, y, x, CASE WHEN light.v > threshold THEN 255 ELSE 0 END AS v FROM light JOIN t USING (image_id))",
        _DIST.format(t="mask2"), _TOP.format(t="e", c="dist"), "peaks AS MATERIALIZED (SELECT image_id, y, x, 1 AS v FROM top WHERE dist = top AND dist > 0)", _PARTS.format(t="peaks"), _GROW,
    ]
    return f"WITH RECURSIVE {SQL}, {', '.join(steps)} {_SPREAD}"


def _entries() -> list[tuple[str, Query, str | None]]:
    f, h, e = fixtures, histogram, F.col
    hist, batch_hist = _HIST.format(t="gray"), _HIST.format(t="batch")
    row = ("image_id", "y", "x")
    place = "image_id, y, x"
    return [
        ("threshold_fixed", lambda s, d: f.gray(s, d).select(*row, P.threshold(e("v"), THRESHOLD).alias("bw")), _with(then=f"SELECT {place}, CASE WHEN v > {THRESHOLD} THEN 255 ELSE 0 END AS bw FROM gray")),
        ("gray_from_rgb", lambda s, d: f.rgb(s, d).select(*row, P.gray(e("r"), e("g"), e("b")).alias("v")), _with(then=f"SELECT {place}, (77 * r + 150 * g + 29 * b) >> 8 AS v FROM rgb")),
        ("gray_from_rgb_float", lambda s, d: f.rgb(s, d).select(*row, P.gray_float(e("r"), e("g"), e("b")).alias("v")), _with(then=f"SELECT {place}, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)::INT AS v FROM rgb")),
        ("channels_convert", lambda s, d: f.gray(s, d).select(*row, *[c.alias(n) for c, n in zip(P.channels(1, 4, [e("v")]), "rgba", strict=True)]), _with(then=f"SELECT {place}, v AS r, v AS g, v AS b, 255 AS a FROM gray")),
        ("depth_convert", lambda s, d: f.gray(s, d).select(*row, P.to_16_bit(e("v")).alias("v16"), P.to_8_bit(P.to_16_bit(e("v"))).alias("v8")), _with(then=f"SELECT {place}, v * 257 AS v16, (v * 257) >> 8 AS v8 FROM gray")),
        ("flip_vertical", lambda s, d: images.pixels(_files(f.batch(s, d), "pnm"), 1, flip=True), _with(then="SELECT image_id::VARCHAR AS image_id, max(y) OVER (PARTITION BY image_id) - y AS y, x, v FROM batch")),
        ("flip_pixels", lambda s, d: per_image.flip_vertical(f.batch(s, d), KEYS), _with(then="SELECT image_id, max(y) OVER (PARTITION BY image_id) - y AS y, x, v FROM batch")),
        *[(f"{fmt}_round_trip", lambda s, d, fmt=fmt: images.pixels(_files(f.rgb_batch(s, d), fmt), 3), _with(then="SELECT image_id::VARCHAR AS image_id, y, x, r, g, b FROM rgb_batch")) for fmt in ("png", "pnm", "tga")],
        ("read_16_bit", lambda s, d: images.pixels(_files(f.batch(s, d), "png", 16), 1, depth=16), _with(then="SELECT image_id::VARCHAR AS image_id, y, x, v * 257 AS v FROM batch")),
        ("image_metadata", lambda s, d: images.metadata(_files(f.rgb_batch(s, d), "png")), _with(then="SELECT image_id::VARCHAR AS path, max(y) + 1 AS height, max(x) + 1 AS width, 3 AS channels FROM batch GROUP BY image_id")),
        ("color_distance", lambda s, d: f.rgb(s, d).select(*row, P.color_distance(e("r"), e("g"), e("b"), (10, 20, 30)).alias("d2"), P.spatial_distance(e("x"), e("y"), (50, 50)).alias("s2")), _with(then=f"SELECT {place}, (r - 10) * (r - 10) + (b - 30) * (b - 30) + (g - 20) * (g - 20) AS d2, (x - 50) * (x - 50) + (y - 50) * (y - 50) AS s2 FROM rgb")),
        ("histogram_256", lambda s, d: h.histogram(f.gray(s, d), KEYS), _with(hist, then="SELECT * FROM h")),
        ("histogram_weighted", lambda s, d: h.weighted(h.histogram(f.gray(s, d), KEYS)).groupBy("image_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), _with(hist, then="SELECT image_id, sum(n)::BIGINT AS n, sum(v * n)::BIGINT AS s FROM h GROUP BY image_id")),
        ("cumhist_inclusive", lambda s, d: h.cumulative(h.histogram(f.gray(s, d), KEYS), KEYS), _with(hist, then="SELECT *, (sum(n) OVER w)::BIGINT AS cum_n, (sum(v * n) OVER w)::BIGINT AS cum_s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)")),
        ("cumhist_exclusive", lambda s, d: h.cumulative(h.histogram(f.gray(s, d), KEYS), KEYS, False), _with(hist, then="SELECT *, coalesce(sum(n) OVER w, 0)::BIGINT AS cum_n, coalesce(sum(v * n) OVER w, 0)::BIGINT AS cum_s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")),
        ("otsu_variance", lambda s, d: h.between_class_variance(h.histogram(f.gray(s, d), KEYS), KEYS), _with(hist, _CUTS, then="SELECT image_id, v, n1::BIGINT AS n1, n2::BIGINT AS n2, variance FROM var")),
        ("otsu_threshold", lambda s, d: h.otsu_threshold(f.gray(s, d), KEYS), _with(hist, _CUTS, then="SELECT * FROM t")),
        ("otsu_binarize", lambda s, d: h.otsu_binarize(f.gray(s, d), KEYS), _with(hist, _CUTS, then="SELECT g.*, CASE WHEN g.v > threshold THEN 255 ELSE 0 END AS bw FROM gray g JOIN t USING (image_id)")),
        ("otsu_batch_by_image", lambda s, d: h.otsu_threshold(f.batch(s, d), KEYS), _with(batch_hist, _CUTS, then="SELECT * FROM t")),
        ("sobel_onepass", lambda s, d: convolve.scatter(f.gray(s, d), KEYS, convolve.SOBEL_H), _with(_conv_sql(convolve.SOBEL_H), then="SELECT * FROM g")),
        ("sobel_separable", lambda s, d: convolve.convolve(f.gray(s, d), KEYS, convolve.SOBEL_H), _with(_conv_sql(convolve.SOBEL_H), then="SELECT * FROM g")),
        ("sobel_banded", lambda s, d: convolve.banded(f.gray(s, d), KEYS, convolve.SOBEL_H), _with(_conv_sql(convolve.SOBEL_H), then="SELECT * FROM g")),
        ("sobel_vertical", lambda s, d: convolve.convolve(f.gray(s, d), KEYS, convolve.SOBEL_V), _with(_conv_sql(convolve.SOBEL_V), then="SELECT * FROM g")),
        ("sobel_batch", lambda s, d: convolve.convolve(f.batch(s, d), KEYS, convolve.SOBEL_H), _with(_conv_sql(convolve.SOBEL_H, "batch"), then="SELECT * FROM g")),
        ("sobel_u8_wrap", lambda s, d: _edge(f.gray(s, d)), _with(_conv_sql(convolve.SOBEL_H), then=f"SELECT {place}, abs(g) AS mag, abs(g)::INT & 255 AS edge FROM g")),
        ("sobel_u8_saturate", lambda s, d: _edge(f.gray(s, d), overflow="saturate"), _with(_conv_sql(convolve.SOBEL_H), then=f"SELECT {place}, abs(g) AS mag, least(abs(g)::INT, 255) AS edge FROM g")),
        ("box_filter", lambda s, d: convolve.convolve(f.gray(s, d), KEYS, convolve.BOX), _with(_conv_sql(convolve.BOX), then="SELECT * FROM g")),
        ("sharpen_rank_two", lambda s, d: convolve.convolve(f.gray(s, d), KEYS, SHARP), _with(_conv_sql(SHARP), then="SELECT * FROM g")),
        ("kmeans_init", lambda s, d: kmeans.centroid_table(s, kmeans.initial(f.rgb(s, d), K, "i")), _with(_kmeans_sql(0), then="SELECT *, 3.0::DOUBLE * x AS x_ref FROM m0")),
        ("kmeans_assign_1", lambda s, d: (lambda px: kmeans.assign(px, kmeans.initial(px, K, "i")).select("i", "cluster"))(f.rgb(s, d)), _with(_kmeans_sql(1), then="SELECT i, cluster FROM a1")),
        ("kmeans_centroids_5", lambda s, d: kmeans.centroid_table(s, _kmeans(s, d)[1].centroids), _with(_kmeans_sql(ROUNDS), then=f"SELECT *, 3.0::DOUBLE * x AS x_ref FROM m{ROUNDS}")),
        ("kmeans_int_centroids_5", lambda s, d: kmeans.centroid_table(s, _kmeans(s, d, mean="int")[1].centroids), _with(_kmeans_sql(ROUNDS, "int"), then=f"SELECT *, 3.0::DOUBLE * x AS x_ref FROM m{ROUNDS}")),
        ("kmeans_repaint", lambda s, d: kmeans.repaint(*_kmeans(s, d)).select("i", "cluster", "r", "g", "b"), _with(_kmeans_sql(ROUNDS), then=f"SELECT i, cluster, trunc(m.r)::INT AS r, trunc(m.g)::INT AS g, trunc(m.b)::INT AS b FROM a{ROUNDS} a JOIN m{ROUNDS} m USING (cluster)")),
        ("cluster_sum_count", lambda s, d: (lambda px: kmeans.sums(kmeans.compact(px), kmeans.initial(px, K, "i")))(f.rgb(s, d)), _with(_kmeans_sql(1), then="SELECT cluster, count(*) AS n, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM a1 GROUP BY cluster")),
        ("mask_cluster_sum", lambda s, d: (lambda px: kmeans.masked(kmeans.assign(px, kmeans.initial(px, K, "i")), 1))(f.rgb(s, d)).agg(F.sum("count").alias("n"), *[F.sum(c).alias(c) for c in "xyrgb"]), _with(_kmeans_sql(1), then="SELECT count(*) AS n, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM a1 WHERE cluster = 1")),
        ("edt", _edt, _with(_DIST.format(t="mask"), then=f"SELECT {place}, d2, dist FROM e")),
        ("max_filter", lambda s, d: morphology.max_filter(f.batch(s, d), KEYS, 2), _with(_TOP.format(t="batch", c="v"), then="SELECT * FROM top")),
        ("local_maxima", lambda s, d: morphology.local_maxima(_edt(s, d), KEYS, 2, "dist"), _with(_DIST.format(t="mask"), _TOP.format(t="e", c="dist"), then=f"SELECT {place}, e.d2, top.dist FROM top JOIN e USING ({place}) WHERE top.dist = top AND top.dist > 0")),
        ("connected_components", _labels, _parts_sql("SELECT * FROM l")),
        ("components_of_large", lambda s, d: morphology.components_of_large(f.mask(s, d), KEYS, band=3), _parts_sql("SELECT image_id, y, x, (min(f) // 8)::BIGINT * 4294967296 + min(f) % 8 AS root FROM RECURSIVE_r GROUP BY image_id, y, x")),
        ("segment_count", lambda s, d: morphology.segment_count(_labels(s, d), KEYS), _parts_sql("SELECT image_id, count(DISTINCT label) AS segments FROM l GROUP BY image_id")),
        ("speedup", lambda s, d: report.speedup(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value"), _with(then="SELECT user_id, event_id, value, CASE WHEN value <> 0 THEN first(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / value END AS speedup FROM events")),
        ("kmeans_by_image", lambda s, d: kmeans.painted(kmeans.k_means_by_image(f.rgb_batch(s, d), KEYS, K, ROUNDS)), _with(_kmeans_by_sql(ROUNDS), then=f"SELECT a.image_id, y, x, cluster, trunc(m.r)::INT AS r, trunc(m.g)::INT AS g, trunc(m.b)::INT AS b FROM (SELECT image_id, y, x, cluster FROM a{ROUNDS}) a JOIN (SELECT image_id, cluster, r, g, b FROM m{ROUNDS}) m USING (image_id, cluster)")),
        ("mean_shift", lambda s, d: watershed.mean_shift(f.rgb_batch(s, d), KEYS), _with(_shift_sql("rgb_batch"), then="SELECT * FROM shifted")),
        ("local_maxima_inside", lambda s, d: morphology.local_maxima(_edt(s, d), KEYS, 2, "dist", border=2), _with(_DIST.format(t="mask"), _TOP.format(t="e", c="dist"), then=f"SELECT {place}, e.d2, top.dist FROM top JOIN e USING ({place}) WHERE top.dist = top AND top.dist > 0 AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")),
        ("watershed_flood", _flood, f"WITH RECURSIVE {SQL}, {_FLOOD} {_SPREAD}"),
        ("watershed_pipeline", _pipeline, _pipeline_sql()),
    ]


def queries() -> dict[str, Query]:
    return {name: query for name, query, _ in _entries()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _entries() if sql}
