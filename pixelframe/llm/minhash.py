r"""MinHash near-duplicates with sequential Bayesian verification.

Words are runs of `[^\x20\x09-\x0D]` of the text with A-Z in lower case; a text's set holds the 64-bit hashes of its
distinct shingles. Texts whose sets are equal form a class, so copies are compared once however many they are.

1. `signed`: each row's set size, set digest, MinHash signature and packed text, written once.
2. Banding: classes that agree in a few successive minima meet in a bucket. Bands are as many as it takes for a pair at
   the threshold t to miss all buckets with a probability (1 - t^rows)^bands of at most MISS.
3. Candidates of a bucket: all pairs if it has at most SMALL classes. In a larger one every class meets one leader, the
   class that shares the most bucket places with others.
4. Verification: one byte of each minimum is compared in batches; after each batch a pair goes if the posterior
   probability that its similarity reaches the threshold (uniform prior, n matches out of m) is below MISS. Survivors are
   verified exactly on their full sets.
5. Pairs are verified in three passes, each leaving out pairs that earlier links already put into one component: each
   class with its best leader; the other candidates; and, in large buckets that hold several components, members of
   different components, compared in blocks of bounded size, so that no pair that shares a bucket goes unseen and none
   of these pairs leaves its task.
6. Components of the links; each gets the smallest id among its rows.

No bucket is capped. What a task holds is bounded by block sizes and by single texts; hot digests and hot leaders are
skewed join keys, which AQE splits.

Defined results: null, empty and wordless texts have the empty set, link with nothing and are their own component;
repeated rows are copies of one class; a null id is no smallest id, and a component of null ids only has a null
component_id; kept compares null-safely. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelframe.llm.common import bounded_arrow, by_bytes, release, released, scratch, written
from pixelframe.llm.components import components

HASHES, BATCH = 128, 32
MISS = 1e-6
SMALL, BLOCK = 8, 1024
SLICE_BYTES = 2 << 20
_word_hashes: dict[bytes, int] = {}
_WORDS_HELD = 100_000


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(1 << 63, size=HASHES, dtype=np.uint64) * 2 + 1, r.integers(1 << 63, size=HASHES, dtype=np.uint64)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands fit the signature."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
        if bands * rows <= HASHES:
            return bands, rows
    return HASHES, 1


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) > _WORDS_HELD or len(_word_hashes) > _WORDS_HELD:
        _word_hashes.clear()
    for w in set(words):
        if w not in _word_hashes:
            _word_hashes[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        mixed = np.full(n, min(width, len(h)), np.uint64)
        for k in range(min(width, len(h))):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def forget() -> None:
    _word_hashes.clear()


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-shift hashes (upper 32 bits)."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096]
            low = np.minimum(low, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return low


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, matches needed) after each batch: with fewer, the posterior P(similarity >= threshold) is below `miss`.
    With a uniform prior and m of n matches that posterior is the binomial distribution function at m of n + 1 trials."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while (total := total + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return out


def survives(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Rows of a and b (bytes of minima) that pass all batches; each batch looks only at those still in."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, m in needed:
        matches[left] += (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(1)
        left = left[matches[left] >= m]
    return left


def signed(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, carry: list[str]) -> DataFrame:
    """(rid, id, n, d1, d2, bands, mini, packed, rest) of every row, written. rid tells rows apart; rest has the columns
    to carry along."""
    bounded_arrow(df.sparkSession)
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.struct(F.lit(True).alias("row"), *[df[c].alias(f"c{i}") for i, c in enumerate(carry)]).alias("rest"))
    n_bands, n_rows = banding(percent)
    id_type, rest_type = src.schema["id"].dataType, src.schema["rest"].dataType

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        a, b = _multipliers()
        rid, pack = TaskContext.get().partitionId() << 40, zstandard.ZstdCompressor(level=1).compress
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text, width)
                rid += 1
                if len(s):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    low = signature(s, a, b)
                    bands = [xxhash.xxh3_64_intdigest(low[i * n_rows : (i + 1) * n_rows].tobytes(), i) - (1 << 63) for i in range(n_bands)]
                    got = (rid, len(s), int(d[0]), int(d[1]), bands, low.astype(np.uint8).tobytes(), pack(text))
                else:
                    got = (rid, 0, None, None, None, None, None if text is None else pack(text))
                for c, x in zip(cols, got, strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([arrays[0], batch.column("id"), *arrays[1:], batch.column("rest")], ["rid", "id", "n", "d1", "d2", "bands", "mini", "packed", "rest"])

    kinds = T.StructType.fromDDL("rid long, i int, n long, d1 long, d2 long, bands array<long>, mini binary, packed binary")
    out = T.StructType([T.StructField("id", id_type) if f.name == "i" else f for f in kinds] + [T.StructField("rest", rest_type)])
    return written(src.mapInArrow(released(sign, forget), out), "signed")


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, best) candidates, `best` marking a class's best leader; (key, c) of large buckets; both written."""
    places = classes.select("c", F.explode("bands").alias("key"))
    counts = places.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    places = written(places.join(counts.hint("merge"), "key"), "places")
    small = places.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("c")).alias("m"))
    pairs = small.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("b"))
    large = places.where(F.col("size") > SMALL)
    weight = large.groupBy("c").agg(F.sum("size").alias("weight"))
    weighed = written(large.join(weight.hint("merge"), "c"), "weighed")
    lead = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("c")).alias("c"))).alias("l")).select("key", (-F.col("l.c")).alias("leader"), F.col("l.weight").alias("l_weight"))
    starred = weighed.join(lead.hint("merge"), "key").where("c <> leader")
    star = starred.groupBy("leader", "c").agg(F.max("l_weight").alias("l_weight"))
    best = star.groupBy("c").agg(F.max(F.struct("l_weight", (-F.col("leader")).alias("leader"))).alias("l")).select("c", (-F.col("l.leader")).alias("leader"), F.lit(True).alias("best"))
    star = star.join(best.hint("merge"), ["c", "leader"], "left")
    stars = star.select(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b"), F.coalesce("best", F.lit(False)).alias("best"))
    # of a small bucket's pairs the first class's are its first pass
    firsts = pairs.groupBy("a", "b").agg(F.lit(False).alias("best"))
    first_of = firsts.groupBy("b").agg(F.min("a").alias("a"), F.lit(True).alias("first"))
    firsts = firsts.join(first_of.hint("merge"), ["a", "b"], "left").select("a", "b", F.coalesce("first", F.lit(False)).alias("best"))
    out = stars.unionByName(firsts).groupBy("a", "b").agg(F.max("best").alias("best"))
    return written(out, "candidates"), weighed.select("key", "c")


def _exact(pairs: DataFrame, texts: DataFrame, minis: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): pairs that pass the batches and whose full sets reach the threshold."""
    needed = least_matches(percent / 100)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, HASHES) for x in ("ma", "mb"))
                yield batch.select(["a", "b"]).take(pa.array(survives(a, b, needed)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ta", "tb")), strict=True):
                if a not in held:
                    held = {a: shingle_set(unpack(ta), width)}  # rows come sorted by a
                sa, sb = held[a], shingle_set(unpack(tb), width)
                if percent * max(len(sa), len(sb)) > 100 * min(len(sa), len(sb)):
                    continue
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["u", "v"])

    side = lambda t, c, x, y: t.select(F.col("c").alias(x), F.col(c).alias(y)).hint("merge")
    near = pairs.join(side(minis, "mini", "a", "ma"), "a").join(side(minis, "mini", "b", "mb"), "b").select("a", "b", "ma", "mb")
    near = written(near.mapInArrow(released(prune), "a long, b long"), "survivors")
    full = near.join(side(texts, "packed", "b", "tb"), "b").join(side(texts, "packed", "a", "ta"), "a").select("a", "b", "ta", "tb")
    return written(full.sortWithinPartitions("a").mapInArrow(released(verify, forget), "u long, v long"), "verified")


def _blocked(placed: DataFrame, main: DataFrame) -> DataFrame:
    """(key, x, y, stray, c, root): members outside a bucket's largest component (strays) and all members, dealt so that
    every stray meets every member in one block of about BLOCK by BLOCK."""
    rows = placed.join(main.hint("merge"), "key")
    block = lambda n: F.pmod(F.xxhash64("c"), F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK))).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int") - 1))
    strays = rows.where("root <> main").withColumn("x", block("out")).withColumn("y", upto("all")).withColumn("stray", F.lit(True))
    others = rows.withColumn("y", block("all")).withColumn("x", upto("out")).withColumn("stray", F.lit(False))
    cols = ["key", "x", "y", "stray", "c", "root"]
    return strays.select(cols).unionByName(others.select(cols))


class Block:
    """The strays and others of one block, and which others a stray may be like."""

    def __init__(self, rows: pa.Table, percent: int) -> None:
        self.c, self.root, self.n, stray = (rows.column(x).to_numpy() for x in ("c", "root", "n", "stray"))
        self.strays, self.others = np.nonzero(stray)[0], np.nonzero(~stray)[0]
        self.mini = np.frombuffer(b"".join(rows.column("mini").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        self.at = int(np.nonzero(self.bands[0] == rows.column("key")[0].as_py())[0][0])
        self.percent, self.needed = percent, least_matches(percent / 100)

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of `among` that pass the batches beside stray i; pairs are looked at in the first bucket that they share."""
        n, mini, bands = self.n, self.mini, self.bands
        j = among[~(bands[i, : self.at] == bands[among, : self.at]).any(1) & (100 * np.minimum(n[i], n[among]) >= self.percent * np.maximum(n[i], n[among]))]
        return j[survives(np.broadcast_to(mini[i], (len(j), HASHES)), mini[j], self.needed)]


def _across(weighed: DataFrame, minis: DataFrame, texts: DataFrame, roots: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(u, v): verified links between members of different components that share a large bucket; None if no bucket holds
    several components. Blocks first see signatures alone and name the members that have a pair left; only those come
    again with their texts. Pairs stay inside their task: exact sets, and one link for components that meet."""
    placed = weighed.join(roots.select(F.col("node").alias("c"), "root").hint("merge"), "c", "left").select("key", "c", F.coalesce("root", "c").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("l"), F.sum("n").alias("all"), F.count("*").alias("k")).where("k > 1").select("key", F.col("l.root").alias("main"), "all", (F.col("all") - F.col("l.n")).alias("out"))
    main = written(main, "split-buckets")
    if not main.take(1):
        return None
    signs = minis.select("c", "n", "mini", "bands").hint("merge")

    def pruned(rows: pa.Table) -> pa.Table:
        block = Block(rows, percent)
        left: set[int] = set()
        for i in block.strays.tolist():
            near = block.near(i, block.others[block.root[block.others] != block.root[i]])
            if len(near):
                left.add(i)
                left.update(near.tolist())
        out = rows.select(["key", "x", "y", "stray", "c", "root"]).take(pa.array(sorted(left), pa.int64()))
        del block
        if rows.num_rows > BLOCK:
            release()
        return out

    shape = "key long, x int, y int, stray boolean, c long, root long"
    left = written(_blocked(placed, main).join(signs, "c").groupBy("key", "x", "y").applyInArrow(pruned, shape), "left-in-blocks")

    def compare(rows: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        block, packed = Block(rows, percent), rows.column("packed")
        c, root, mini = block.c, block.root, block.mini
        sets: dict[int, np.ndarray] = {}
        group = {r: r for r in root.tolist()}

        def held(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set(unpack(packed[k].as_py()), width)
            return sets[k]

        def top(r: int) -> int:
            while group[r] != r:
                r = group[r]
            return r

        links = []
        for i in block.strays.tolist():
            mine = top(int(root[i]))
            j = block.near(i, block.others[np.array([top(r) for r in root[block.others].tolist()], np.int64) != mine])
            for k in j[np.argsort(-(mini[j] == mini[i]).sum(1), kind="stable")].tolist():
                if top(int(root[k])) == top(int(root[i])):
                    continue
                a, b = held(i), held(k)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links.append((int(c[i]), int(c[k])))
                    group[top(int(root[i]))] = top(int(root[k]))
        u, v = zip(*links, strict=True) if links else ((), ())
        sets.clear()
        if rows.num_rows > BLOCK:
            forget()
            release()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    full = left.join(signs, "c").join(texts.hint("merge"), "c")
    return written(full.groupBy("key", "x", "y").applyInArrow(compare, "u long, v long"), "across")


def _grouped(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(rid, id, n, root, component_id, kept) of every signed row; root is null for the empty set."""
    with scratch(rows.sparkSession) as folder:
        known = written(_known(rows, width, percent), "components", folder)
    out = rows.select("rid", "id", "n", "d1", "d2").join(known.hint("merge"), ["d1", "d2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select("rid", "id", "n", "root", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _known(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(d1, d2, root, component_id) of every class."""
    filled = rows.where("n > 0")
    classes = written(filled.groupBy("d1", "d2").agg(F.min("rid").alias("c"), F.min("id").alias("least")), "classes")
    minis = written(filled.join(classes.select("c").hint("merge"), F.col("rid") == F.col("c")).select("c", "n", "bands", "mini"), "minis")
    pairs, weighed = _candidates(minis)

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")).hint("merge") for x in "ab")
        return pairs.join(ra, "a", "left").join(rb, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")

    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).unionByName(weighed.select("c")).distinct()
    texts = written(rows.select(F.col("rid").alias("c"), "packed").join(ends.hint("merge"), "c"), "texts")
    links = _exact(pairs.where("best"), texts, minis, width, percent)
    roots = components(links)
    links = links.unionByName(_exact(apart(pairs.where("not best"), roots), texts, minis, width, percent))
    roots = components(links)
    more = _across(weighed, minis, texts, roots, width, percent)
    if more is not None:
        roots = components(links.unionByName(more))

    joined = classes.join(roots.hint("merge"), F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c"))
    ends = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.select("d1", "d2", "root").join(ends.hint("merge"), "root")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: the id, n_shingles, component_id, kept."""
    out = _grouped(signed(df, id_col, text_col, width, percent, []), width, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def deduplicated(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with the columns of df: of the rows with the smallest id the one read first. Rows with
    the empty set all stay."""
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    rows = signed(df, id_col, text_col, width, percent, rest)
    got = _grouped(rows, width, percent).where("kept")
    stay = got.groupBy("root").agg(F.min("rid").alias("rid")).where("root is not null").select("rid").unionByName(got.where("root is null").select("rid"))
    kept = rows.select("rid", "id", "packed", "rest").join(stay.hint("merge"), "rid")
    flat = kept.select("id", "packed", *[F.col("rest")[f"c{i}"].alias(f"c{i}") for i in range(len(rest))])
    shape = T.StructType([flat.schema["id"], T.StructField("packed", T.StringType()), *flat.schema.fields[2:]])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                text = pa.array([None if x is None else plain(x).decode() for x in batch.column("packed").to_pylist()], pa.string())
                yield batch.set_column(batch.schema.get_field_index("packed"), "packed", text)

    out = flat.mapInArrow(released(unpack), shape)
    names = {id_col: "id", text_col: "packed"} | {c: f"c{i}" for i, c in enumerate(rest)}
    return out.select(*[F.col(names[c]).alias(c) for c in df.columns])


def oracle(width: int = 3, percent: int = 85) -> str:
    """Links by all shingles that documents share, and the least id of all that can be reached."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {width - 1}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM t WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(shingle)::BIGINT AS n_shingles FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id
), l AS (
  SELECT p.u, p.v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.u JOIN n y ON y.doc_id = p.v WHERE 100 * shared >= {percent} * (x.n_shingles + y.n_shingles - shared)
), c AS (
  SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT l.v, c.root FROM c JOIN l ON l.u = c.node
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN (SELECT node, min(root) AS component_id FROM c GROUP BY node) ON node = doc_id
"""
