"""Registered queries against their SQL, and the pipeline against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from conftest import DATA
from test_documents import host_rates, language_loop, mix_copies, near_loop, rules

from pixelframe.llm import common, language, queries

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda rows, cols: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in (r[cols.index(c)] for c in order)) for r in rows), key=repr)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def spoken(spark, rows):
    """{id: (label, score)} of all rows, by plain loops, and the model."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.held_out(docs["doc_id"])))
    return {i: language_loop(model, r["text"]) for i, r in rows.items()}, model


def test_language_query_equals_loops(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, _ = spoken(spark, rows)
    got = queries.op7_language(spark, SF).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g["lang_pred"] == want[g["doc_id"]][0] and math.isclose(g["score"], want[g["doc_id"]][1], abs_tol=1e-3)
        assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2)
    held = [g for g in got if g["held_out"] and rows[g["doc_id"]]["lang"]]
    assert sum(g["lang_pred"] == rows[g["doc_id"]]["lang"] for g in held) >= 0.97 * len(held)


class ArticleText(HTMLParser):
    """The blocks of a page's article, for pages that have just one and no other parts in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.blocks.append("") if tag != "br" else self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_query_equals_a_plain_reader(spark):
    pages, n = spark.read.parquet(f"{SF}/pages.parquet").collect(), 0
    got = {g["page_id"]: g for g in queries.op8_html(spark, SF).collect()}
    assert len(got) == len(pages)
    for page in pages:
        reader = ArticleText()
        reader.feed(page["html"] or "")
        want = " ".join(x for b in reader.blocks if (x := " ".join(b.split())))
        if want:
            n += 1
            assert got[page["page_id"]]["text"] == want and got[page["page_id"]]["n_chars"] == len(want)
    assert n >= 0.5 * len(pages)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels, model = spoken(spark, rows)
    ids = set()
    for i, (label, _) in labels.items():
        found = language.features(rows[i]["text"])
        if label != "und" and float(np.dot(found[0], model.centers[label].mean)) >= model.centers[label].least[int(found[1]).bit_length()]:
            ids.add(i)
    stage = p.language_id(spark, docs, SF)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == ids and len(ids) >= 0.98 * len(rows)
    failed = {i: rules(rows[i]["text"])[5] for i in ids}
    rate = host_rates([(rows[i]["source"], f) for i, f in failed.items()])
    left = sorted(i for i, f in failed.items() if not f and rate[rows[i]["source"]] <= 0.75)
    alone = sorted({c for _, _, c in near_loop([(i, rows[i]["text"]) for i in left], 5, 80)})
    copies, _ = mix_copies([(i, rows[i]["text"], None, rows[i]["source"]) for i in alone])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for i, n in copies.items():
        found = t.encode(rows[i]["text"], add_special_tokens=False).ids
        shown = t.decode(found, skip_special_tokens=False)
        want[i, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()] += n
    out = p.run(spark, SF)
    assert Counter(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == +want
    base = common.tables(spark).removeprefix("file:")
    assert not [x for x in os.listdir(base) if x.startswith("scratch")]


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    rows = [(None, None, None, None, None, 1, "c"), (1, "", "en", "s", 0, 2, "c"), (2, "7 7 7", "en", None, 5, 3, "c"), (2, "7 7 7", "en", None, 5, 3, "c")]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long, `__row` int, row string")
        for name, stage in p.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns and got.count() <= len(given), name
        assert p.STAGES[-1][1](spark, docs, SF).count() == len(given)
