"""Quality, licences, language, mixing, sharding and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelframe.llm import components, language, licenses, minhash, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + extra)


def texts(seed=1, n=40):
    r = random.Random(seed)
    out = [" ".join(r.choice(VOCABULARY) for _ in range(r.choice([1, 3, 60, 200]))) for _ in range(n)]
    out += [None, "", " \n\t ", "a b c a b c a b c", "x\nx\n\nx \n \ny\ny", "## $$ a|b <c> & %", "é ü\x1cz w\x0bq", "one two three", "a b c d a b c", "k " * 30 + "\n" + "k " * 30, "😀 a 😀 a 😀 a"]
    return out


def rules(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, rep = len(words), len(again)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def host_rates(failed):
    """Each host's shrunk rate of failures, from (host, failed) of all rows."""
    hosts = defaultdict(list)
    for s, f in failed:
        hosts[s].append(f)
    n = len(failed)
    m = sum(map(sum, hosts.values())) / n
    spread = sum(sum(x) ** 2 / len(x) for x in hosts.values()) / n - m * m - m * (1 - m) * len(hosts) / n
    strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return {s: (sum(x) + m * strength) / (len(x) + strength) for s, x in hosts.items()}


def test_quality(spark, monkeypatch):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}") for i, t in enumerate(texts())]
    rows += [(900 + i, "bad", "en", "junk") for i in range(60)] + [(990, " ".join(VOCABULARY), "en", "junk"), (990, " ".join(VOCABULARY), "en", "junk")]
    for place in (24, 1):  # with one bit, long texts compare all windows as text
        monkeypatch.setattr(quality, "PLACE", place)
        got = quality.report(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        want = {i: rules(t) for i, t, _, _ in rows}
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        for r in got:
            assert tuple(r[c] for c in names) == want[r["doc_id"]], rows[r["doc_id"]] if r["doc_id"] < len(rows) else r
    rate = host_rates([(s, want[i][5]) for i, _, _, s in rows])
    kept = {i: not want[i][5] and rate[s] <= 0.75 for i, _, _, s in rows}
    assert {r["doc_id"]: r["kept"] for r in got} == kept and not kept[990] and rate["junk"] > 0.75
    stays = quality.keep(frame(spark, [(*r, 1, "c", 2, 3, 4) for r in rows], ", __words int, n_words string, __host int, __row int, __base_failed int"))
    assert Counter(r["doc_id"] for r in stays.collect()) == Counter(i for i, *_ in rows if kept[i]) and stays.columns[-1] == "__base_failed"
    assert {tuple(r)[4:] for r in stays.collect()} == {(1, "c", 2, 3, 4)}


def test_quality_of_nothing(spark):
    none = frame(spark, [])
    assert quality.report(none).count() == 0 and quality.keep(none).count() == 0


def test_licenses(spark):
    mit = next(t for k, t in licenses.KNOWN if k == "MIT")
    rows = [
        (1, mit, "en", "s"), (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace("\n", "  \n").replace("SUBLICENSE", "SUB-LICENCE"), "en", "s"),
        (3, mit + " and more", "en", "s"), (4, None, "en", None), (5, "", None, "s"), (6, "released under the MIT licence", "en", "s"),
        (7, "© 2021 X\nLicensed under the Apache License, v2.0", "en", "s"), (7, "© 2021 X\nLicensed under the Apache License, v2.0", "en", "s"),
        (8, "plain text", "en", "s"),
    ]
    got = licenses.scan(frame(spark, [(*r, "x") for r in rows], ", license_id string")).collect()
    assert Counter((r["doc_id"], r["license_id"]) for r in got) == Counter({(1, "MIT"): 1, (2, "MIT"): 1, (3, None): 1, (4, None): 1, (5, None): 1, (6, "MIT"): 1, (7, "Apache-2.0"): 2, (8, None): 1})
    assert {r["canonical_sha256"] for r in got if r["doc_id"] in (4, 5)} == {hashlib.sha256(b"").hexdigest()}
    assert licenses.scan(frame(spark, [])).count() == 0


def test_licenses_in_lines_and_paragraphs(spark):
    isc = next(t for k, t in licenses.KNOWN if k == "ISC").replace("\n\n", "\n")
    rows = [
        (1, "prose of a page\nReleased under the MIT License.", "en", "s"), (1, "prose of a page\nReleased under the MIT License.", "en", "s"),
        (2, "Licensed under CC BY-NC 4.0.\r\nprose\r\n\r\nSPDX-License-Identifier: MIT\r\nmore", "en", "s"),
        (3, f"prose\n \t\n{isc}\n\nprose", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, "\n\n", "en", "s"), (7, "© 2020 X\n\n\n", "en", "s"),
        (8, "it was released under the MIT License.", "en", "s"), (9, "w " * 50000 + "\nReleased under the MIT License", "en", "s"),
    ]
    got = licenses.parts(frame(spark, [(*r, "x") for r in rows], ", part string")).collect()
    want = {(1, "line", 2, "MIT"): 2, (2, "line", 1, "CC-BY-NC-4.0"): 1, (2, "line", 4, "MIT"): 1, (3, "paragraph", 2, "ISC"): 1, (9, "line", 2, "MIT"): 1}
    assert Counter(map(tuple, got)) == Counter(want)
    assert licenses.parts(frame(spark, [])).count() == 0


def test_wrapped_and_one_line_licenses(spark):
    import textwrap

    of = {k: t for k, t in reversed(licenses.KNOWN) if len(t) > 200}
    wrap = lambda t, n: "\n\n".join(textwrap.fill(x, n) for x in t.split("\n\n"))
    isc = of["ISC"].removeprefix("ISC License\n\n").replace("copyright notice and", "\ncopyright notice and")
    one = " ".join(of["MIT"].split())
    cases = [(isc, "ISC"), (isc.replace("\n", "\r\n"), "ISC"), (f"Copyright (c) 2020 X Y {one}", "MIT"), (f"© 2020, X and Y. All rights reserved. {one}", "MIT")]
    cases += [(wrap(t, n), k) for k, t in of.items() for n in (24, 40, 72)]
    cases += [(f"ISC License\nCopyright 2019-2020 A. Person,\nB. Person\nCopyright The Authors\n\n{isc}", "ISC"), (f"MIT License\nCopyright Jane Doe\n\n{one.removeprefix('MIT License ')}", "MIT")]
    cases += [("/*\n * Copyright (C) 2020 X\n *\n" + "\n".join(f" * {x}" for x in wrap(of["BSD-3-Clause"], 60).split("\n")) + "\n */", "BSD-3-Clause")]
    cases += [("Licensed under the Apache License, Version\n2.0.", "Apache-2.0"), ("Copyright notice " + one, None), ("Copyright 2020 X", None)]
    got = licenses.scan(frame(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(cases)])).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {i: k for i, (_, k) in enumerate(cases)}


def test_full_texts_and_given_licenses(spark, monkeypatch):
    from pixelframe.llm import common

    texts = licenses.built_in()
    mit = licenses.KNOWN[0][1].removeprefix("MIT License").strip()
    cases = [(mit, "MIT"), ("The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + mit, "MIT"), ("My own terms,\nversion 1", "Own")]
    cases += [(" \n" + t.replace("\n", "\r\n"), k) for k, t in texts if len(t) > 5000] + [(None, None), ("", None)]
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0"} <= {k for _, k in cases}
    df = frame(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(cases)])
    more = spark.createDataFrame([("Own", "my own terms, version 1"), ("Empty", ""), ("Null", None), ("ZMIT", mit)], "license_id string, text string")
    for limit in (common.BROADCAST_BYTES, 0):  # broadcast and merged
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        assert {r["doc_id"]: r["license_id"] for r in licenses.scan(df, more=more).collect()} == {i: k for i, (_, k) in enumerate(cases)}
    lines = frame(spark, [(1, "prose\nMy own terms, v1", "en", "s")])
    assert [tuple(r) for r in licenses.parts(lines, more=more).collect()] == [(1, "line", 2, "Own")]


SAMPLE = {
    "en": "the quick brown fox jumps over the lazy dog and this is what they would have thought about with their friends",
    "de": "der schnelle braune fuchs springt über den faulen hund und das ist was sie mit ihren freunden gedacht hätten",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et ce est ce que ils auraient pensé avec leurs amis",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y esto es lo que habrían pensado con sus amigos mañana",
}


def test_language(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        lang = r.choice(list(SAMPLE))
        words = SAMPLE[lang].split()
        rows.append((i, " ".join(r.choice(words) for _ in range(r.choice([8, 30, 100]))), lang, "s"))
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !?", "en", "s"), (903, rows[0][1], None, None), (903, rows[0][1], None, None), (None, rows[1][1], "xx", "s")]
    df = frame(spark, [(*x, "p", "q") for x in rows + odd], ", lang_pred string, score string").repartition(3)
    got = language.report(df).collect()
    assert len(got) == len(rows) + len(odd)
    for g in got:
        key = "" if g["doc_id"] is None else str(g["doc_id"])
        assert g["held_out"] == (zlib.crc32(key.encode()) % 4 == 2) and 0 <= g["score"] <= 1
    by = {g["doc_id"]: g for g in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    held = [(by[i]["lang_pred"], lang) for i, _, lang, _ in rows if by[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    more = spark.createDataFrame([(1000, "漢字だけの文章はどのラベルにも似ていない" * 9), (1001, "ქართული ენა არ არის ნასწავლი და არც ერთს ჰგავს " * 9), (1002, " ".join(SAMPLE["fr"].split() * 9000))], "doc_id long, text string")
    mixed = df.withColumnsRenamed({"lang_pred": "__lang", "score": "row"}).unionByName(more, allowMissingColumns=True)
    kept = language.keep(mixed)
    assert {r["doc_id"] for r in kept.collect()} == {*(i for i, *_ in rows), 903, None, 1002}
    assert kept.columns == mixed.columns and {(r["__lang"], r["row"]) for r in kept.collect() if r["doc_id"] == 5} == {("p", "q")}


def language_loop(model, text):
    """(label, score) of a text by plain loops over its n-grams, from the model's weights."""
    m = 1 << 32
    low = [c if c.isalpha() else " " for c in (text or "").lower()]
    if not any(c != " " for c in low):
        return "und", 0.0
    low = [c for i, c in enumerate(low) if i == 0 or c != " " or low[i - 1] != " "]
    a = [ord(c) * 0x9E3779B1 % m for c in [" ", *low, " "]]
    b = [(x ^ (y >> 7)) * 0x85EBCA6B % m for x, y in zip(a, a[1:], strict=False)]
    c = [(x ^ (y >> 11)) * 0xC2B2AE35 % m for x, y in zip(b, a[2:], strict=False)]
    counts = Counter((x ^ (x >> 15)) * 0x27D4EB2F % m >> 19 for x in [*a, *b, *c])
    total = sum(counts.values())
    vector = {k: math.sqrt(n / total) for k, n in counts.items()}
    chance = lambda w: 1 / (1 + math.exp(-4 * (sum(float(w[k]) * v for k, v in vector.items()) + float(w[-1]))))
    families = {f: 1.0 if len(model.families.labels) == 1 else chance(w) for f, w in zip(model.families.labels, model.families.weights, strict=True)}
    family = max(families, key=families.get)
    inner = model.within[family]
    scores = dict.fromkeys(inner.labels, 0.0 if len(inner.labels) > 1 else 1.0)
    for (i, j), w in zip(inner.pairs, inner.weights, strict=True):
        p = chance(w) / (len(inner.labels) - 1)
        scores[inner.labels[i]] += p
        scores[inner.labels[j]] += 1 / (len(inner.labels) - 1) - p
    label = max(scores, key=scores.get)
    return label, scores[label] * families[family]


def test_language_with_copies_and_with_many_labels(spark):
    r = random.Random(6)
    say = lambda lang, n: " ".join(r.choice(SAMPLE[lang].split()) for _ in range(n))
    rows = [(i, SAMPLE["fr"] if i % 2 else say("fr", 25) if i % 100 == 0 else SAMPLE["fr"], "fr", "s") for i in range(6000)]
    rows += [(10_000 + i, say("en", 25), "en", "s") for i in range(300)] + [(20_000 + i, say("de", 25), "de", "s") for i in range(300)]
    df = frame(spark, rows).repartition(4)
    model = language.fit(df, train_rows=60)
    assert sorted(model.centers) == ["de", "en", "fr"]
    assert model.predict([SAMPLE["fr"], SAMPLE["en"], SAMPLE["de"], None, "7"])[0] == ["fr", "en", "de", "und", "und"]
    # 150 labels, each with an alphabet of its own; none is left out
    labels = [f"x{k}" for k in range(150)]
    word = lambda k: "".join(chr(0x4E00 + 40 * k + r.randrange(40)) for _ in range(4))
    many = [(k * 100 + i, " ".join(word(k) for _ in range(12)), labels[k], "s") for k in range(150) for i in range(6)]
    model = language.fit(frame(spark, many).repartition(4))
    assert sorted(model.centers) == sorted(labels)
    assert np.mean([a == b for a, b in zip(model.predict([" ".join(word(k) for _ in range(12)) for k in range(150)])[0], labels, strict=True)]) > 0.9


def test_language_does_not_learn_from_held_out_rows(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "completely different words", "zz", "s") for i in held] + [(i, SAMPLE["en"], "en", "s") for i in range(400) if i not in held]
    assert {r["lang_pred"] for r in language.report(frame(spark, rows)).collect()} == {"en"}


def test_language_without_rows_or_labels(spark):
    assert language.report(frame(spark, [])).count() == 0
    assert language.report(frame(spark, [(1, "words", None, "s")])).first()["lang_pred"] == "und"


def mix_loop(rows):
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in rows}
    by = defaultdict(int)
    for i, _, _, s in rows:
        by[s] += size[i]
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(by.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * by[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 3 * by[s]}
        if not over:
            break
        capped |= over
    return size, by, {s: 3.0 * by[s] if s in capped else weight[s] * level for s in order}


def mix_copies(rows):
    """(copies, ranks) by id: the mix by sorting each source by its Pareto ranks."""
    size, by, target = mix_loop(rows)
    text, source = {i: t for i, t, _, _ in rows}, {i: s for i, _, _, s in rows}
    filled = Counter(s for i, s in source.items() if size[i])
    copies, ranks = {}, {}
    for s in by:
        base = math.floor(target[s] / by[s]) if by[s] else 0
        want = target[s] - base * by[s]
        own = [i for i, of in source.items() if of == s]
        copies |= dict.fromkeys(own, base)
        if want <= 1e-6:
            continue
        for i in own:
            bits = int(hashlib.md5(f"{i}:{hashlib.md5((text[i] or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16)
            u, p = (bits + 0.5) / 2**52, want / by[s]
            ranks[i] = u / (1 - u) / (p / (1 - p) * math.sqrt(by[s] / filled[s] / max(size[i], 1)))
        order = sorted(own, key=ranks.__getitem__)
        sums = [0]
        for i in order:
            sums.append(sums[-1] + size[i])
        for i in order[: min(range(len(sums)), key=lambda k: abs(sums[k] - want))]:
            copies[i] += 1
    return copies, ranks


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{(i * i) % 7}") for i, t in enumerate(texts(5, 400))]
    rows += [(5000, "tiny text", "en", "z1"), (5001, None, "en", "z2"), (5002, " ".join(r.choice(VOCABULARY) for _ in range(4000)), "en", "big")]
    got = mixing.report(frame(spark, rows)).collect()
    size, by, target = mix_loop(rows)
    source = {i: s for i, _, _, s in rows}
    taken = defaultdict(int)
    largest = defaultdict(int)
    for g in got:
        s = source[g["doc_id"]]
        assert (g["size"], g["source_size"]) == (size[g["doc_id"]], by[s]) and math.isclose(g["target"], target[s], rel_tol=1e-9)
        assert g["taken"] == g["copies"] * g["size"] and 0 <= g["copies"] <= 3
        assert not by[s] or g["copies"] in (math.floor(target[s] / by[s]), math.ceil(target[s] / by[s]))
        taken[s] += g["taken"]
        largest[s] = max(largest[s], g["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in by)
    # the same sample by sorting: odds differ between documents of a source, and the least ranks are taken
    copies, ranks = mix_copies(rows)
    assert all(g["copies"] == copies[g["doc_id"]] for g in got if g["size"])
    assert len(ranks) > 50 and all(math.isclose(g["pareto"], ranks[g["doc_id"]], rel_tol=1e-6) for g in got if g["doc_id"] in ranks)
    again = mixing.report(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    clashing = ", copies int, __size int, __u int, __s int, size int, row int, pareto int"
    mix = mixing.take(frame(spark, [(*x, 1, 2, 3, 4, 5, 6, 7) for x in rows], clashing))
    assert Counter(m["doc_id"] for m in mix.collect()) == Counter({g["doc_id"]: g["copies"] for g in got if g["copies"]})
    assert mix.columns[4:] == ["copies", "__size", "__u", "__s", "size", "row", "pareto"] and {tuple(m)[4:] for m in mix.collect()} == {(1, 2, 3, 4, 5, 6, 7)}


def test_mixing_of_nothing(spark):
    assert mixing.report(frame(spark, [])).count() == 0
    empty = mixing.report(frame(spark, [(1, None, "en", None), (None, "", "en", "a")])).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 for r in empty)
    same = mixing.report(frame(spark, [(1, "a b", "en", "s")] * 6 + [(2, "c d e f", "en", "t")])).collect()
    assert len({r["taken"] for r in same if r["doc_id"] == 1}) == 1


def test_sharding(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(3, 200))] + [(7000, "y" * 9000, "en", "s")] + [(8000, "same " * 60, "en", "s")] * 40 + [(None, None, None, None)]
    limit = 4000
    df = frame(spark, [(*r, "d") for r in rows], ", shard string")
    got = sharding.assign_shards(df, limit).collect()
    assert len(got) == len(rows)
    held = defaultdict(list)
    for g in got:
        assert g["depth"] == len(g["shard"])
        held[g["shard"]].append(g)
    for shard, inside in held.items():
        assert sum(g["n_bytes"] for g in inside) == inside[0]["shard_bytes"] and len(inside) == inside[0]["shard_rows"]
        assert inside[0]["shard_bytes"] <= limit or (len(inside) == 1 and inside[0]["over_limit"])
        assert not any(other != shard and other.startswith(shard) for other in held)
    # only prefixes above the limit were split
    for shard in held:
        if shard:
            parent = sum(g["n_bytes"] for s, inside in held.items() if s.startswith(shard[:-1]) for g in inside)
            assert parent > limit
    assert sharding.assign_shards(df, 1 << 30).first()["shard"] == ""
    assert sharding.assign_shards(frame(spark, []), limit).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(*r, 1, "x", 2) for r in [(i, t, "en", "s") for i, t in enumerate(texts(6, 60))]]
    df = frame(spark, rows, ", __row int, shard_bits string, rid int")
    name = sharding.write_shards(df, str(tmp_path / "out"), 3000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard_bits" and back.drop(name).columns == df.columns
    assert Counter(map(tuple, back.drop(name).collect())) == Counter(map(tuple, df.collect()))
    sizes = back.selectExpr(name, "coalesce(octet_length(text), 0) AS b").groupBy(name).agg({"b": "sum", name: "count"}).toDF("s", "b", "n").collect()
    assert len(sizes) > 3 and all(r["b"] <= 3000 or r["n"] == 1 for r in sizes)


def near_loop(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k]:
            least[root(k)] = min(least.get(root(k), 1 << 60), i)
    return [(i, len(s), least[root(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_rows():
    r = random.Random(8)
    rows = []
    base = [r.choice(VOCABULARY) for _ in range(220)]
    for _ in range(60):  # copies of one text with more and more changes
        b = list(base)
        for _ in range(r.choice([0, 1, 3, 5, 8, 12])):
            b[r.randrange(220)] = r.choice(VOCABULARY)
        rows.append(" ".join(b))
    for _ in range(15):
        own = " ".join(r.choice(VOCABULARY) for _ in range(90))
        rows += [own, own.upper().replace(" ", "\n"), own + " tail"]
    rows += [None, "", " \n", "One two", "one TWO", "a", "a", "b c d e f g h", "é é é é é é"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(components, "GATHERED", 0)
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "k", i) for i, t in rows], "doc_id long, text string, kept string, component_id int")
    got = sorted((g["doc_id"], g["n_shingles"], g["component_id"], g["kept"]) for g in minhash.near_duplicates(df, width=3, percent=85).collect())
    assert got == [(i, n, c, i == c) for i, n, c in near_loop(rows, 3, 85)]


def test_members_of_components_that_leaders_miss_meet_in_blocks(spark, monkeypatch):
    # all buckets are large and every leader is useless: only the last pass can find the links
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    real = minhash._candidates

    def blind(classes):
        pairs, weighed = real(classes)
        return pairs.where("false"), weighed

    monkeypatch.setattr(minhash, "_candidates", blind)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((g["doc_id"], g["n_shingles"], g["component_id"]) for g in minhash.near_duplicates(df, width=3, percent=85).collect())
    assert got == near_loop(rows, 3, 85)


def test_deduplicated(spark):
    rows = near_rows()[:60]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, "only null ids here"), (None, "only null ids here")]
    df = spark.createDataFrame([(i, t, [str(i)], i) for i, t in rows], "doc_id long, text string, tags array<string>, rid long")
    out = minhash.deduplicated(df, width=3, percent=85)
    got = out.collect()
    assert out.columns == df.columns
    want = {c for i, n, c in near_loop([(i, t) for i, t in rows if i is not None], 3, 85) if n}
    empty = [i for i, t in rows if not (t or "").strip()]
    assert sorted(g["doc_id"] for g in got if g["doc_id"] is not None) == sorted([*want, *empty])
    assert sum(g["doc_id"] is None for g in got) == 1
    by = dict(rows)
    assert all(g["text"] == by[g["doc_id"]] and g["tags"] == [str(g["doc_id"])] for g in got if g["doc_id"] is not None)
    assert minhash.deduplicated(df.limit(0)).count() == 0


def test_banding_and_batches():
    for percent in (50, 80, 85, 95):
        bands, rows = minhash.banding(percent)
        assert bands * rows <= minhash.HASHES and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    for n, m in minhash.least_matches(0.85):
        tail = sum(math.comb(n + 1, j) * 0.85**j * 0.15 ** (n + 1 - j) for j in range(m + 1))
        assert tail >= minhash.MISS and tail - math.comb(n + 1, m) * 0.85**m * 0.15 ** (n + 1 - m) < minhash.MISS


@pytest.mark.parametrize("gathered", [1 << 18, 0])  # at once and in rounds
def test_components(spark, monkeypatch, gathered):
    monkeypatch.setattr(components, "GATHERED", gathered)
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    odd = [(None, 5), (7, None), (3, 3), links[0], links[0]]
    got = {g["node"]: g["root"] for g in components.components(spark.createDataFrame(links + odd, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_very_long_texts(spark):
    # a text of 400,000 words beside a near copy and short ones
    r = random.Random(5)
    words = [r.choice(SAMPLE["en"].split()) + str(r.randrange(5000)) for _ in range(400_000)]
    other = list(words)
    other[1000] = "changed"
    rows = [(1, " ".join(words), "en", "a"), (2, "\n".join(other), "en", "b"), (3, SAMPLE["fr"], "fr", "a"), (4, SAMPLE["en"], "en", "b")]
    df = frame(spark, rows).repartition(2)
    near = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in minhash.near_duplicates(df).collect()}
    assert near == {i: (n, c) for i, n, c in near_loop([(i, t) for i, t, _, _ in rows], 5, 80)} and near[2][1] == 1
    measured = {g["doc_id"]: g for g in quality.report(df).collect()}
    assert all((measured[i]["n_words"], measured[i]["n_repeat_words"], measured[i]["n_dup_lines"]) == (rules(t)[0], rules(t)[4], rules(t)[3]) for i, t, _, _ in rows)
    mixed = {g["doc_id"]: g for g in mixing.report(df).collect()}
    assert mixed[1]["size"] == 400_000 and {i: g["copies"] for i, g in mixed.items()} == mix_copies(rows)[0]
    model = language.fit(df.where(~language.held_out(df["doc_id"])))
    for g in language.report(df).collect():
        label, score = language_loop(model, {i: t for i, t, _, _ in rows}[g["doc_id"]])
        assert g["lang_pred"] == label and math.isclose(g["score"], score, abs_tol=1e-3)
    assert {g["doc_id"]: g["n_bytes"] for g in sharding.assign_shards(df, 1000).collect()} == {i: len(t.encode()) for i, t, _, _ in rows}
