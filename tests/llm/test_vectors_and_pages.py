"""Top-k search and HTML extraction against brute force and made pages."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pixelframe.llm import html_text, topk


def search_loop(rows, k, every):
    ok = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for q, a in {(i, v) for i, v in ok if i % every == 0}:
        ranked = sorted((-sum(x * y for x, y in zip(whole(a), whole(b), strict=True)), c) for c, b in ok if c != q and len(a) == len(b))
        out += [(q, r, c, -s) for r, (s, c) in enumerate(ranked[:k], 1)]
    return sorted(out)


SIZES = ("QUERY_BYTES", "QUERY_ROWS", "ROW_BLOCK", "SEEDS", "QUERY_CHUNK", "CHUNK", "FEW")
WAYS = [(8 << 20, 16384, 65536, 2048, 512, 2048, 1 / 32), (8 << 20, 16384, 65536, 3, 2, 7, 0.5), (0, 2, 16, 2048, 3, 7, 0.9)]  # sent, in small steps, in blocks


@pytest.mark.parametrize("way", WAYS)
def test_top_k(spark, monkeypatch, way):
    for name, value in zip(SIZES, way, strict=True):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=20).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(120, 150)]  # ties
    rows += [(150, None), (200, [1.0, None] + [0.0] * 18), (250, [math.nan] * 20), (300, [math.inf] * 20), (350, [1.0, 2.0]), (351, [3.0, 4.0]), (None, [1.0] * 20), (400, []), (2, rows[2][1])]
    df = spark.createDataFrame([(i, v, i, i) for i, v in rows], "vec_id long, embedding array<float>, score long, q long")
    got = topk.top_k(df, 5, every=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == search_loop(rows, 5, 10)


def test_pruning_leaves_few_pairs_and_the_best(monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 100)
    # clusters: the coarse resolution drops other clusters, finer ones most of the own
    r = np.random.default_rng(4)
    centers = np.repeat(r.normal(size=(20, 4)), 16, axis=1) * 300
    rows = np.floor(np.concatenate([c + r.normal(size=(100, 64)) * 80 for c in centers]))
    queries, ids = rows[::50], np.arange(len(rows))
    search = topk.Search(queries, ids[::50], 5, topk.floors(queries, ids[::50], queries, ids[::50], 5))
    search.show(rows, ids)
    assert search.survivors[0] < 0.6 * search.pairs and search.survivors[2] < 0.2 * search.pairs
    exact = queries @ rows.T
    exact[np.arange(len(queries)), ids[::50]] = -np.inf
    want = [(i, int(j), int(exact[i, j])) for i in range(len(queries)) for j in np.lexsort((ids, -exact[i]))[:5]]
    assert sorted(search.results()) == sorted(want)


def test_top_k_of_large_numbers_and_nothing(spark):
    rows = [(0, [1e6, -3.0]), (1, [2e6, 1.0]), (2, [-5e7, 0.5]), (3, [1e5, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, 2, every=1).collect())) == search_loop(rows, 2, 1)
    huge = spark.createDataFrame([(0, [3e38]), (1, [3e38])], "vec_id long, embedding array<float>")
    assert {r["score"] for r in topk.top_k(huge, 1, every=1).collect()} == {(1 << 63) - 1}
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("way", WAYS)
def test_top_k_of_repeated_rows(spark, monkeypatch, way):
    for name, value in zip(SIZES, way, strict=True):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=20).astype(np.float32).tolist()) for i in range(60)]
    best = sorted(range(1, 60), key=lambda i: -sum(a * b for a, b in zip(rows[0][1], rows[i][1], strict=True)))
    rows += [rows[i] for i in best[:3] for _ in range(5)]  # each of the best comes more than k times
    other = [x + 2**-12 if x * 256 % 1 < 0.9 else x for x in rows[best[0]][1]]  # the same id and score, another vector
    rows += [(best[0], other), (7, [0.0] * 20), (7, [-0.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, 5, every=10).collect())) == search_loop(rows, 5, 10)
    large = [(0, [1e6, 1.0]), (1, [9e6, 0.0]), (1, [9e6, 0.0]), (2, [8e6, 0.0]), (3, [7e6, 0.0])]
    df = spark.createDataFrame(large, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, 2, every=5).collect())) == search_loop(large, 2, 5)


def test_bounds_hold():
    r = np.random.default_rng(3)
    a, b = np.floor(r.normal(size=(30, 37)) * 256), np.floor(r.normal(size=(40, 37)) * 256)
    exact = a @ b.T
    last = None
    for s in (*topk.SEGMENTS, 1):
        upper = topk.statistics(a, s) @ topk.statistics(b, s).T
        assert (upper >= exact - 1e-6).all()
        assert last is None or upper.mean() <= last + 1e-6
        last = upper.mean()


FRAME = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>{}<footer>&copy; Site</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>one<p>two<br>three", "one two three"),
        (FRAME.format("<article><h1>Head</h1><p>Some <b>bo</b>ld &lt;x&gt;\n\n text.<p>More<div class='ad'>Buy</div></article>"), "Head Some bold <x> text. More"),
        (FRAME.format("<div id=sidebar>side</div><div class='post-content'><p>Body</p><ul><li>a<li>b</ul><form>f</form><section class=comments><p>c</p></section></div>"), "Body a b"),
        (FRAME.format("<main><aside>x</aside><p>Main</p><!-- gone --><div class='cookie-notice'>ok?</div><table><tr><td>1<td>2</table></main>"), "Main 1 2"),
        (FRAME.format("<article><p>open</article>"), "open"), ("<article>a<script>x", "a"), ("<article>1 < 2 & 3 > 2</article>", "1 < 2 & 3 > 2"),
        ("<article><header class='entry-header'><h2>Title</h2></header><p title=\"a>b\">t</p></article>", "Title t"),
        ("<article>a<svg width=1 /><p>b</p></article>", "a b"), ("<article>a<iframe src=x /><p>b</p></article>", "a b"),
        ("<article>a<button>Go<p>b</p></article>", "a Go b"), ("<article>a<button>Go</button><p>b</p></article>", "a b"),
        ("<article>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</article>", "Let x=1 be"),
        ("<article><p>Some<span class=ad>Buy <span>now</span></span> words</p><span class=x>more</span></article>", "Some words more"),
        (FRAME.format("<div class='legal'><article><p>Terms</p></article></div>"), "Terms"),
        (FRAME.format("<article><p>Short</p></article><section class=comments><article class=comment><p>" + "chat " * 99 + "</p></article></section>"), "Short"),
        (FRAME.format("<div class=comments><article class=comment><p>only chat</p></article></div>"), ""),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page or "") == want


def flat(tree, parent=-1, out=None):
    out = [] if out is None else out
    at = len(out)
    out.append(f"{parent} {tree[0]}")
    for c in tree[1:]:
        flat(c, at, out)
    return out


def test_tree_matching():
    a, b = ["", ["x", ["y"], ["z", ["w"]]]], ["", ["x", ["q"], ["y"], ["z"]]]
    a, b = ("\n".join(flat(t)) for t in (a, b))
    assert html_text.match(a, b) == [0, 1, 3, 4, -1]
    assert html_text.match(b, a) == [0, 1, -1, 2, 3]


def most_pairs(a, b):
    """Simple tree matching by its definition: all order-preserving pairings of children."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + most_pairs(x[0], y[0])) if x and y else 0

    return 1 + best(a[1:], b[1:])


def test_tree_matching_against_all_pairings():
    r = random.Random(12)
    grow = lambda depth: [r.choice("ab"), *(grow(depth - 1) for _ in range(r.randrange(4) if depth else 0))]
    for _ in range(150):
        a, b = ["", *grow(3)[1:]], ["", *grow(3)[1:]]
        fa, fb = flat(a), flat(b)
        found = html_text._match("\n".join(fa), "\n".join(fb))
        assert sum(k >= 0 for k in found) == most_pairs(a, b)
        used = [k for k in found if k >= 0]
        assert used == sorted(set(used)) and found[0] == 0
        (la, pa_), (lb, pb) = html_text.read_shape("\n".join(fa)), html_text.read_shape("\n".join(fb))
        assert all(la[i] == lb[k] and (i == 0 or found[pa_[i]] == pb[k]) for i, k in enumerate(found) if k >= 0)


def test_pages_of_any_depth_and_width(spark):
    deep = "<div>" * 5000 + "<p>in the deep</p>" + "</div>" * 5000
    wide = "<article>" + "".join(f"<h2>h{i}</h2><p class=c{'abcdefgh'[i % 8]}>p{i}</p>" for i in range(3000)) + "</article>"
    long = f"<article><p>{'word ' * 300_000}</p></article>"
    rows = [(i, "http://d.example/", FRAME.format(x)) for i, x in enumerate([deep, wide, long, deep, wide.replace("h1", "g1"), "<article><p>x</p></article>"])]
    got = {g["page_id"]: g["text"] for g in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[3] == "in the deep" and got[1] == " ".join(f"h{i} p{i}" for i in range(3000))
    assert got[2] == " ".join(["word"] * 300_000) and got[5] == "x"


def test_the_wrapper_finds_content_without_names(spark):
    # no tag or class names the content; notices and teasers are bare divs, and every page has the same call at its end
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        title, text = say(4), [say(r.choice([20, 60])) for _ in range(r.choice([2, 5]))]
        body = f"<h2>{title}</h2>" + "".join(f"<p>{t}</p>" for t in text)
        house = "<div class=top><p>House of words, open all day long for every visitor who comes along the road</p></div>"
        rows.append((i, "https://h.example/x", f"<body>{house}<div class=left><p>{say(3)}</p></div><div class=mid><div class=in>{body}<p>Call us today!</p></div></div><div class=end><p>{say(5)}</p></div></body>"))
        want[i] = " ".join([title, *text])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got, alone = ({g["page_id"]: g["text"] for g in html_text.extract(df, wrapped=w).collect()} for w in (True, False))
    assert got == want and sum(alone[i] != want[i] for i in want) == 30


def test_extract(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        body = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.choice([3, 40])))
        inner = f"<div class=frame><div class=w{'x' * (i % 3 == 0)}><p>{body} {i}</p></div></div><div class=legalbox><span>Always the same words of the house</span></div>"
        rows.append((i, f"http://{'a' if i < 30 else 'b'}.example/{i}", FRAME.format(inner)))
        want[i] = f"{body} {i}"
    rows += [(100, None, None), (101, "http://a.example/", ""), (102, "no url", "<article>x</article>"), (102, "no url", "<article>x</article>")]
    df = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string").repartition(3)
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(g["n_chars"] == len(g["text"]) for g in got)
    by = {g["page_id"]: g["text"] for g in got}
    assert (by[100], by[101], by[102]) == ("", "", "x")
    assert {i: by[i] for i in want if i < 30} == {i: t for i, t in want.items() if i < 30}
    assert html_text.extract(df.limit(0)).count() == 0


def test_a_host_that_repeats_one_article_keeps_it(spark):
    page = lambda i: FRAME.format(f"<div class=ad>{i}</div><article><h1>Same</h1><p>Same text</p></article>")
    df = spark.createDataFrame([(i, "http://c.example/", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert {g["text"] for g in html_text.extract(df).collect()} == {"Same Same text"}
