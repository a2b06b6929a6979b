"""Image operators against plain loops on small grids."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelframe.functions import pixel
from pixelframe.operators import convolve, histogram, kmeans, morphology, per_image, watershed

KEYS = ["image_id"]


def pixels(spark, *grids, name="v"):
    rows = [(f"i{k}", y, x, int(v)) for k, g in enumerate(grids) for (y, x), v in np.ndenumerate(np.array(g))]
    return spark.createDataFrame(rows, f"image_id string, y int, x int, {name} int")


def grid(df, column, shape, image="i0"):
    out = np.full(shape, -999.0)
    for r in df.where(F.col("image_id") == image).collect():
        out[r["y"], r["x"]] = np.nan if r[column] is None else r[column]
    return out


def otsu_loop(values):
    hist = np.bincount(np.ravel(values), minlength=256)
    best, cut = -1.0, 0
    for t in range(256):
        n1, n2 = int(hist[: t + 1].sum()), int(hist[t + 1 :].sum())
        if n1 and n2:
            s1, s2 = int((np.arange(t + 1) * hist[: t + 1]).sum()), int((np.arange(t + 1, 256) * hist[t + 1 :]).sum())
            var = float(n1) * float(n2) * ((s1 / n1 - s2 / n2) * (s1 / n1 - s2 / n2))
            if var > best:
                best, cut = var, t
    return cut


def conv_loop(g, k):
    g, k = np.array(g, float), np.array(k, float)
    out = np.zeros_like(g)
    for y in range(g.shape[0]):
        for x in range(g.shape[1]):
            for i in range(k.shape[0]):
                for j in range(k.shape[1]):
                    if y + i < g.shape[0] and x + j < g.shape[1]:
                        out[y, x] += k[i, j] * g[y + i, x + j]
    return out


def test_threshold_is_strict(spark):
    got = pixels(spark, [[99, 100, 101]]).select("x", pixel.threshold(F.col("v"), 100).alias("b")).orderBy("x")
    assert [r["b"] for r in got.collect()] == [0, 0, 255]


def test_color_functions(spark):
    row = spark.createDataFrame([(255, 10, 3)], "r int, g int, b int")
    c = [F.col(x) for x in "rgb"]
    got = row.select(pixel.gray(*c).alias("y"), *[x.alias(n) for n, x in zip("abcd", pixel.channels(3, 4, c), strict=True)], pixel.narrow(F.lit(-300.7)).alias("w"), pixel.narrow(F.lit(-300.7), "saturate").alias("s")).first()
    assert tuple(got) == ((77 * 255 + 150 * 10 + 29 * 3) >> 8, 255, 10, 3, 255, 300 & 255, 255)
    with pytest.raises(ValueError, match="overflow"):
        pixel.narrow(F.lit(1), "clip")


def test_squared_distances_beyond_int(spark):
    row = spark.createDataFrame([(65535, 65535, 0, 3, 59999, 1.5)], "r int, g int, b int, x int, y int, f double")
    r, g, b, x, y, f = (F.col(c) for c in row.columns)
    got = row.select(
        pixel.color_distance(r, g, b, (10, 20, 30)).alias("d"), pixel.spatial_distance(x, y, (50, 50)).alias("s"), pixel.spatial_distance(x, y, (b, b)).alias("c"),
        pixel.color_distance(r, g, b, (0.5, 0.5, 0.5)).alias("e"), pixel.spatial_distance(f, x, (1, 1)).alias("f"), pixel.spatial_distance(F.lit(None).cast("int"), y, (50, 50)).alias("n"),
    )
    assert tuple(got.first()) == (65525**2 + 30**2 + 65515**2, 47**2 + 59949**2, 3**2 + 59999**2, 2 * 65534.5**2 + 0.25, 0.25 + 4.0, None)
    assert [kind for _, kind in got.dtypes] == ["bigint", "bigint", "bigint", "double", "double", "bigint"]


def test_histogram_is_dense_and_running_sums_agree(spark):
    h = histogram.histogram(pixels(spark, [[0, 0, 7], [255, 7, 7]]), KEYS)
    counts = {r["v"]: r["n"] for r in h.collect()}
    assert len(counts) == 256 and sum(counts.values()) == 6 and (counts[0], counts[7], counts[255]) == (2, 3, 1)
    inc = {r["v"]: (r["cum_n"], r["cum_s"]) for r in histogram.cumulative(h, KEYS).collect()}
    exc = {r["v"]: (r["cum_n"], r["cum_s"]) for r in histogram.cumulative(h, KEYS, inclusive=False).collect()}
    assert inc[255] == (6, 21 + 255) and exc[0] == (0, 0) and exc[8] == inc[7] == (5, 21)


def test_otsu_by_image(spark):
    rng = np.random.default_rng(1)
    grids = [rng.integers(0, 256, (9, 7)), np.full((3, 3), 5), [[10, 10], [200, 200]], [[0]], rng.integers(100, 140, (2, 11))]
    px = pixels(spark, *grids)
    got = {r["image_id"]: r["threshold"] for r in histogram.otsu_threshold(px, KEYS).collect()}
    assert got == {f"i{k}": otsu_loop(g) for k, g in enumerate(grids)}
    assert got["i1"] == 0
    bw = histogram.otsu_binarize(px, KEYS)
    assert (grid(bw, "bw", (3, 3), "i1") == 255).all()
    assert (grid(bw, "bw", (9, 7)) == np.where(grids[0] > got["i0"], 255, 0)).all()
    assert histogram.otsu_threshold(px.drop("image_id"), []).count() == 1


@pytest.mark.parametrize("kernel", [convolve.SOBEL_H, convolve.SOBEL_V, convolve.BOX, [[0, -1, 0], [-1, 5, -1], [0, -1, 0]], [[2]], [[1, 2]]])
def test_forms_of_convolution_agree(spark, kernel):
    grids = [np.random.default_rng(2).integers(0, 256, (11, 6)), [[7]], [[1, 2]], [[3], [4]]]
    px = pixels(spark, *grids)
    forms = [convolve.scatter(px, KEYS, kernel), convolve.banded(px, KEYS, kernel, band=4), convolve.convolve(px, KEYS, kernel)]
    for form in forms:
        for k, g in enumerate(grids):
            assert (grid(form, "g", np.array(g).shape, f"i{k}") == conv_loop(g, kernel)).all()


def test_scatter_takes_sparse_images(spark):
    px = pixels(spark, [[1, 2], [3, 4]]).where("not (x = 1 and y = 0)")
    got = {(r["y"], r["x"]): r["g"] for r in convolve.scatter(px, KEYS, convolve.BOX).collect()}
    assert got == {(0, 0): 8.0, (1, 0): 7.0, (1, 1): 4.0}


def test_factors():
    assert convolve.factors(convolve.SOBEL_H) is not None
    assert convolve.factors([[0, -1, 0], [-1, 5, -1], [0, -1, 0]]) is None
    assert convolve.factors([[0, 0], [0, 0]]) == ([0.0, 0.0], [0.0, 0.0])


def kmeans_loop(px, k, rounds, cut):
    n = len(px)
    means = [px[i * (n // k)] for i in range(k)]
    for _ in range(rounds):
        own = [min(range(k), key=lambda c: ((p[2] - means[c][2]) ** 2 + (p[4] - means[c][4]) ** 2 + (p[3] - means[c][3]) ** 2, c)) for p in px]
        means = [tuple((lambda s, m: float(s // m) if cut else s / m)(sum(p[a] for p, o in zip(px, own, strict=True) if o == c), max(1, own.count(c))) for a in range(5)) for c in range(k)]
    return means, own


@pytest.mark.parametrize("one_task", [1 << 18, 0])
@pytest.mark.parametrize("mean", ["double", "int"])
def test_k_means(spark, monkeypatch, mean, one_task):
    monkeypatch.setattr(kmeans, "ONE_TASK", one_task)
    rng = np.random.default_rng(3)
    px = [(int(i % 6), int(i // 6), *map(int, rng.integers(0, 4, 3) * 60)) for i in range(48)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(px)], "i int, x int, y int, r int, g int, b int")
    for rounds in (1, 4):
        means, own = kmeans_loop(px, 4, rounds, mean == "int")
        for compacted in (True, False):
            got = kmeans.k_means(df, 4, rounds, order="i", mean=mean, compacted=compacted)
            assert got.centroids == means
        assert [r["cluster"] for r in kmeans.assign(df, got.before).orderBy("i").collect()] == own
    fixed, many = kmeans.k_means(df, 4, 40, order="i", mean=mean), kmeans_loop(px, 4, 40, mean == "int")[0]
    assert fixed.centroids == many and fixed.rounds < 40
    painted = kmeans.repaint(df, fixed).orderBy("i").collect()
    assert all((r["r"], r["g"], r["b"]) == tuple(int(v) for v in fixed.centroids[r["cluster"]][2:]) for r in painted)


@pytest.mark.parametrize("one_task", [1 << 18, 0])
def test_k_means_with_many_centroids_and_empty_ones(spark, monkeypatch, one_task):
    monkeypatch.setattr(kmeans, "ONE_TASK", one_task)
    px = spark.createDataFrame([(i, i, 0, i % 5, i % 3, 0) for i in range(140)], "i int, x int, y int, r int, g int, b int")
    means, own = kmeans_loop([tuple(r)[1:] for r in px.orderBy("i").collect()], 70, 2, cut=False)
    got = kmeans.k_means(px, 70, 2, order="i")
    assert got.centroids == means
    assert [r["cluster"] for r in kmeans.assign(px, got.before).orderBy("i").collect()] == own
    with pytest.raises(ValueError, match="k is"):
        kmeans.initial(px, 141, "i")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([0, 255]), min_size=5, max_size=5), min_size=1, max_size=6))
def test_distances_maxima_and_components(spark, rows):
    g = np.array(rows)
    px = pixels(spark, g)
    zeros = np.argwhere(g == 0)
    d2 = np.array([[min(((zeros - [y, x]) ** 2).sum(1)) if len(zeros) else np.nan for x in range(g.shape[1])] for y in range(g.shape[0])], float)
    got = grid(morphology.distance_transform(px, KEYS), "d2", g.shape)
    assert np.array_equal(got, d2, equal_nan=True)
    top = grid(morphology.max_filter(px, KEYS, 1), "top", g.shape)
    assert all(top[y, x] == g[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max() for y in range(g.shape[0]) for x in range(g.shape[1]))
    labels = np.zeros(g.shape, int)
    n = 0
    for y, x in np.argwhere(g):
        if not labels[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < g.shape[0] and 0 <= b < g.shape[1] and g[a, b] and not labels[a, b]:
                    labels[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    got = grid(morphology.connected_components(px, KEYS), "label", g.shape)
    assert (np.where(got < 0, 0, got) == labels).all()


def test_components_of_large_images(spark, tmp_path):
    rng = np.random.default_rng(5)
    g = (rng.random((20, 23)) < 0.55) * 255
    px = pixels(spark, g, g.T)
    small = grid(morphology.connected_components(px, KEYS), "label", g.shape)
    large = grid(morphology.components_of_large(px, KEYS, str(tmp_path), band=6), "root", g.shape)
    pairs = {(a, b) for a, b in zip(small[g > 0], large[g > 0], strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    nameless = morphology.components_of_large(px.where("image_id = 'i0'").withColumn("image_id", F.lit(None).cast("string")), KEYS, str(tmp_path), band=6)
    assert {(r["y"], r["x"], r["root"]) for r in nameless.collect()} == {(y, x, large[y, x]) for y, x in np.argwhere(g).tolist()}


def test_flood(spark):
    # two seeds in bright basins with a dark line between
    light = [[9, 8, 1, 8, 9], [9, 8, 1, 8, 9]]
    px = pixels(spark, light).withColumn("marker", F.when(F.col("x") == 0, 1).when(F.col("x") == 4, 2).otherwise(0))
    got = grid(watershed.flood(px, KEYS, "v"), "label", (2, 5))
    assert got.tolist() == [[1, 1, 0, 2, 2], [1, 1, 0, 2, 2]]


def test_watershed_of_a_mask_separates_two_discs(spark):
    yy, xx = np.mgrid[:15, :29]
    g = (((yy - 7) ** 2 + (xx - 8) ** 2 <= 36) | ((yy - 7) ** 2 + (xx - 19) ** 2 <= 36)) * 255
    got = grid(watershed.from_mask(pixels(spark, g), KEYS, min_distance=4), "label", g.shape)
    assert (got[g == 0] == 0).all() and (got[g > 0] > 0).all()
    assert len(set(got[g > 0])) == 2 and got[7, 8] != got[7, 19]


def test_watershed_pipeline_on_color(spark):
    g = np.zeros((9, 9), int)
    g[2:7, 2:7] = 220
    px = pixels(spark, g).selectExpr("image_id", "y", "x", "v as r", "v as g", "v as b")
    got = grid(watershed.pipeline(px, KEYS, min_distance=3), "label", g.shape)
    assert ((got > 0) == (g > 0)).all()


def with_nulls(spark):
    """Three images, one without a name, each with a pixel that has no value."""
    rows = [(name, y, x, None if (y, x) == (1, 1) else 10 * y + 40 * x + k) for k, name in enumerate(["a", None, "b"]) for y in range(3 + k) for x in range(4)]
    return rows, spark.createDataFrame(rows, "image_id string, y int, x int, v int")


def test_null_values_and_null_images(spark):
    rows, px = with_nulls(spark)
    hist = histogram.histogram(px, KEYS)
    assert {r["image_id"]: r["n"] for r in hist.groupBy("image_id").agg(F.sum("n").alias("n")).collect()} == {"a": 11, None: 15, "b": 19}
    assert histogram.histogram(px, KEYS, dense=False).where("v is null").count() == 0
    cuts = {r["image_id"]: r["threshold"] for r in histogram.otsu_threshold(px, KEYS).collect()}
    assert cuts == {k: otsu_loop([v for i, _, _, v in rows if i == k and v is not None]) for k in ("a", None, "b")}
    for most in (100, 0):  # broadcast and merged
        bw = {(r["image_id"], r["y"], r["x"]): r["bw"] for r in histogram.otsu_binarize(px, KEYS, broadcast_rows=most).collect()}
        assert bw == {(i, y, x): 255 if v is not None and v > cuts[i] else 0 for i, y, x, v in rows}
    empty = px.where("v is null")
    assert {r["threshold"] for r in histogram.otsu_threshold(empty, KEYS).collect()} == {0}
    assert histogram.otsu_threshold(px.limit(0), KEYS).count() == 0 and histogram.otsu_threshold(px.limit(0), []).first()["threshold"] == 0


@pytest.mark.parametrize("kernel", [convolve.SOBEL_H, convolve.BOX, [[0, -1, 0], [-1, 5, -1], [0, -1, 0]]])
def test_forms_of_convolution_agree_on_nulls(spark, kernel):
    rows, px = with_nulls(spark)
    want = {}
    for k, name in enumerate(["a", None, "b"]):
        g = np.array([0 if v is None else v for i, _, _, v in rows if i == name]).reshape(3 + k, 4)
        want |= {(name, y, x): v for (y, x), v in np.ndenumerate(conv_loop(g, kernel))}
    for form in (convolve.scatter(px, KEYS, kernel), convolve.banded(px, KEYS, kernel, band=2), convolve.convolve(px, KEYS, kernel)):
        assert {(r["image_id"], r["y"], r["x"]): r["g"] for r in form.collect()} == want


def test_flip_by_each_image_s_height(spark):
    rows, px = with_nulls(spark)
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in per_image.flip_vertical(px, KEYS).collect()}
    height = {"a": 3, None: 4, "b": 5}
    assert got == {(i, height[i] - 1 - y, x): v for i, y, x, v in rows}
    assert per_image.flip_vertical(px.limit(0), KEYS).count() == 0


def test_images_that_span_batches(spark):
    # one image over many Arrow batches beside many small ones, in one task
    rows = [("big", y, x, 1) for y in range(60) for x in range(60)] + [(f"s{i}", 0, x, x % 2) for i in range(300) for x in range(5)] + [(None, 0, 0, 1)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, v int").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = per_image.by_image(px, KEYS, ["v"], lambda image: {"n": np.full(len(image["y"]), len(image["y"])), "s": np.full(len(image["y"]), image["v"].sum() / 2)}, "n long, s double")
        assert {(r["image_id"], r["n"], r["s"]) for r in got.collect()} == {("big", 3600, 1800.0), (None, 1, 0.5), *((f"s{i}", 5, 1.0) for i in range(300))}
        labels = morphology.connected_components(px, KEYS)
        assert {r["image_id"]: r["n"] for r in labels.groupBy("image_id").agg(F.max("label").alias("n")).collect()} == {"big": 1, None: 1, **{f"s{i}": 2 for i in range(300)}}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("mean", ["double", "int"])
def test_k_means_by_image(spark, mean):
    rng = np.random.default_rng(13)
    shapes = {"a": (6, 8), "b": (5, 5), None: (2, 1), "d": (7, 6)}
    images = {k: [(x, y, *map(int, rng.integers(0, 4, 3) * 60)) for y in range(h) for x in range(w)] for k, (h, w) in shapes.items()}
    df = spark.createDataFrame([(k, *p) for k, px in images.items() for p in px], "image_id string, x int, y int, r int, g int, b int").repartition(3)
    for rounds in (1, 5, 40):
        got = {(r["image_id"], r["y"], r["x"]): r for r in kmeans.k_means_by_image(df, KEYS, 4, rounds, mean=mean).collect()}
        for name, px in images.items():
            means, own = kmeans_loop(px, min(4, len(px)), rounds, mean == "int")
            for p, c in zip(px, own, strict=True):
                r = got[name, p[1], p[0]]
                assert (r["cluster"], tuple(r[f"c{a}"] for a in "xyrgb")) == (c, means[c])
    painted = kmeans.painted(kmeans.k_means_by_image(df, KEYS, 4, 5, mean=mean))
    assert painted.columns == ["image_id", "y", "x", "cluster", "r", "g", "b"]
    one, two = (sorted(map(repr, kmeans.k_means_by_image(df, KEYS, 4, 5, seed=3).collect())) for _ in range(2))
    assert one == two


def test_k_means_from_seeded_pixels(spark):
    px = [(i % 6, i // 6, (i * 37) % 256, (i * 91) % 256, (i * 11) % 256) for i in range(48)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(px)], "i int, x int, y int, r int, g int, b int")
    first = kmeans.initial(df, 5, "i", seed=9)
    assert first == kmeans.initial(df, 5, "i", seed=9) != kmeans.initial(df, 5, "i", seed=10) and set(first) <= {tuple(map(float, p)) for p in px}
    assert kmeans.k_means(df, 5, 3, order="i", seed=9).centroids == kmeans.k_means(df, 5, 3, order="i", seed=9).centroids


def shift_loop(image, space, color, rounds):
    out = image.astype(float).copy()
    h, w = image.shape[:2]
    for y in range(h):
        for x in range(w):
            cy, cx, c = float(y), float(x), image[y, x].astype(float)
            for _ in range(rounds):
                near = [(j, i) for j in range(h) for i in range(w) if abs(j - round(cy)) <= space and abs(i - round(cx)) <= space and ((image[j, i] - c) ** 2).sum() <= color * color]
                if not near:
                    break
                ny, nx = np.mean([p[0] for p in near]), np.mean([p[1] for p in near])
                nc = np.mean([image[p] for p in near], 0)
                moved = abs(ny - cy) + abs(nx - cx) + np.abs(nc - c).sum()
                cy, cx, c = ny, nx, nc
                if moved < 1:
                    break
            out[y, x] = np.rint(c)
    return out


@pytest.mark.parametrize("pairwise", [1 << 12, 0])
def test_mean_shift(spark, monkeypatch, pairwise):
    import pixelframe.operators.watershed as module

    image = np.random.default_rng(11).integers(0, 120, (7, 9, 3))
    image[:, 4:] += 100
    rows = [("i0", y, x, *map(int, image[y, x])) for y in range(7) for x in range(9)]
    df = spark.createDataFrame(rows, "image_id string, y int, x int, r int, g int, b int")
    want = shift_loop(image, 2, 60, 4)
    # the choice of form is made in the task, so both are also held against each other here
    got = watershed.mean_shift(df, KEYS, 2, 60, 4)
    assert all((grid(got, c, (7, 9)) == want[..., k]).all() for k, c in enumerate("rgb"))
    places, colors = np.argwhere(np.ones((7, 9))).astype(float), image.reshape(-1, 3).astype(float)
    at = (places[:, 0] + 0.5, places[:, 1] - 0.25, colors + 3)
    for one, two in zip(module._near_pairs(places, colors, *at, 2, 60), module._near_offsets(image.astype(float), np.ones((7, 9), bool), *at, 2, 60), strict=True):
        assert (one == two).all()


def test_peaks_by_label_and_away_from_the_border(spark):
    g = np.random.default_rng(5).integers(1, 9, (9, 11))
    label = np.where(np.arange(11) < 5, 1, 2) * np.ones((9, 1), int)
    label[4] = 0
    rows = [("i0", y, x, int(g[y, x]), int(label[y, x])) for y in range(9) for x in range(11)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, v int, part int")

    def peaks(radius, border, by_label):
        out = set()
        for y in range(9):
            for x in range(11):
                if by_label and not label[y, x]:
                    continue
                near = [g[j, i] for j in range(max(0, y - radius), min(9, y + radius + 1)) for i in range(max(0, x - radius), min(11, x + radius + 1)) if not by_label or label[j, i] == label[y, x]]
                if g[y, x] == max(near) and g[y, x] > 2 and border <= y <= 8 - border and border <= x <= 10 - border:
                    out.add((y, x))
        return out

    for border in (0, 2):
        for part in (None, "part"):
            got = morphology.local_maxima(px, KEYS, 2, "v", 2, border=border, label=part)
            assert got.columns == px.columns and {(r["y"], r["x"]) for r in got.collect()} == peaks(2, border, part is not None)


def test_watershed_of_images_without_a_name(spark):
    g = np.zeros((9, 9), int)
    g[2:7, 2:7] = 255
    px = pixels(spark, g).withColumn("image_id", F.lit(None).cast("string"))
    got = watershed.from_mask(px, KEYS, min_distance=3).collect()
    assert len(got) == 81 and all((r["label"] > 0) == (g[r["y"], r["x"]] > 0) for r in got)


@pytest.mark.parametrize("args", [["otsu"], ["threshold", "--level", "60"], ["edges", "--overflow", "saturate"], ["kmeans", "--k", "2", "--rounds", "3"], ["kmeans", "--k", "2", "--seed", "4", "--format", "pnm"]])
def test_command_line(spark, tmp_path, capsys, args):
    from pixelframe import cli
    from pixelframe.sources import images, writers

    (tmp_path / "in").mkdir()
    px = np.random.default_rng(3).integers(0, 256, (6, 5, 3))
    (tmp_path / "in" / "a.png").write_bytes(writers.png(px))
    (tmp_path / "in" / "b.ppm").write_bytes(writers.pnm(px[::-1]))
    cli.main([args[0], str(tmp_path / "in"), str(tmp_path / "out"), *args[1:]])
    fmt = "pnm" if "pnm" in args else "png"
    assert {f.name for f in (tmp_path / "out").iterdir() if f.suffix == f".{fmt}"} == {f"a.{fmt}", f"b.{fmt}"}
    values = images.pixels(images.read_any(spark, str(tmp_path / "out")), 1 if args[0] != "kmeans" else 3).where("image_id not like '%/.%'")
    assert values.count() == 60 and capsys.readouterr().out.strip().endswith("s")
    if args[0] == "kmeans":
        assert values.groupBy("image_id").agg(F.count_distinct("r", "g", "b").alias("n")).where("n > 2").count() == 0
