"""Language identification by hierarchical discrimination.

A text's features are its letters' n-grams (one to three, spaces between words included) hashed to DIMS, as square roots of
their shares, so a text's length does not matter and every vector has length one. The language family is predicted first,
by linear support vector machines of one family against the rest; within it, one-versus-one machines separate the related
languages. Machines minimise the squared hinge loss. They are fitted on the driver from a bounded sample of labelled rows,
shared evenly by the labels: train_rows rows in all, but at least MIN_EACH for each label, and the most_labels labels with
the most distinct texts (what each gives is chosen by a hash of its text; equal texts count once, in the shares too).
Prediction is one pass in Arrow functions, over whole texts, without a shuffle.

A text is of no known language if it is less like the mean of its predicted label than SLACK times the least alike of that
label's sampled texts of at least its length class (classes double in letters; texts shorter than any class with
MIN_CLASS sampled texts are taken as known). `keep` uses this; `report` names a label for every text with letters.

Defined results: a null text, or one without letters, is `und` with score 0; with no labelled rows everything is `und`;
with one label everything with letters is that label. Repeated rows give repeated rows; very long texts are read whole; an
empty table gives an empty table. `keep` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import bounded_arrow, by_bytes, packed, release, released, unpacked

DIMS, TRAIN_ROWS, ROUNDS, PENALTY = 1 << 13, 2000, 150, 1e-3
MIN_EACH, MOST_LABELS = 20, 250
SLACK, MIN_CLASS = 0.7, 5
#: Text and rows that are looked at together; a row's vector has DIMS numbers.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256
#: Families of common languages (ISO 639-1). Any other label is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
}
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """True for code points that are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, int] | None:
    """The text's vector and its letters; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    n = int(is_letter.sum())
    if not n:
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    a = codes * np.uint32(0x9E3779B1)
    b = (a[:-1] ^ (a[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
    c = (b[:-1] ^ (a[2:] >> np.uint32(11))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    counts = sum(np.bincount((x ^ (x >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> shift, minlength=DIMS) for x in (a, b, c))
    return np.sqrt(counts / counts.sum()).astype(np.float32), n


def _machines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, one row for each column of y, the last a constant's: least penalised squared hinge loss by accelerated
    gradient steps. x has DIMS columns and one of ones; y is 1 or -1, or 0 for rows that a machine does not see; both its
    sides weigh the same."""
    sides = [np.where(side, 0.5 / np.maximum(1, side.sum(0)), 0) for side in (y > 0, y < 0)]
    pull = ((sides[0] + sides[1]) * y).astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    ahead, step = w, 1 / (PENALTY + 4)
    for t in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (PENALTY * ahead - 2 * (x.T @ (pull * slack)))
        ahead, w = new + t / (t + 3) * (new - w), new
    return w.T


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * margin, -50, 50)))


@dataclasses.dataclass
class Rest:
    """One machine for each label against the rest."""

    labels: list[str]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Rest:
        labels = sorted(set(y.tolist()))
        sides = np.where(y[:, None] == np.array(labels, dtype=object)[None, :], 1, -1).astype(np.float32)
        return cls(labels, _machines(x, sides) if len(labels) > 1 else np.zeros((1, DIMS + 1), np.float32))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(rows, labels): chances from the machines' margins."""
        if len(self.labels) == 1:
            return np.ones((len(x), 1))
        return _chance(x @ self.weights[:, :-1].T + self.weights[:, -1])


@dataclasses.dataclass
class Pairwise:
    """One machine for each pair of labels."""

    labels: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Pairwise:
        labels = sorted(set(y.tolist()))
        at = np.array([labels.index(v) for v in y])
        pairs = [(i, j) for i in range(len(labels)) for j in range(i)]
        sides = np.array([np.where(at == i, 1, np.where(at == j, -1, 0)) for i, j in pairs], np.float32).reshape(len(pairs), len(at)).T
        return cls(labels, pairs, _machines(x, sides) if pairs else np.zeros((0, DIMS + 1), np.float32))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(rows, labels): a label's mean chance against each other one."""
        if len(self.labels) == 1:
            return np.ones((len(x), 1))
        chance, out = _chance(x @ self.weights[:, :-1].T + self.weights[:, -1]), np.zeros((len(x), len(self.labels)))
        for k, (i, j) in enumerate(self.pairs):
            out[:, i] += chance[:, k]
            out[:, j] += 1 - chance[:, k]
        return out / (len(self.labels) - 1)


def length_class(n: int) -> int:
    return int(n).bit_length()


@dataclasses.dataclass
class Center:
    """A label's mean vector, and how alike a text of each length class has to be (0 where too few texts tell)."""

    mean: np.ndarray
    least: list[float]

    @classmethod
    def fit(cls, x: np.ndarray, n: np.ndarray) -> Center:
        mean = x.mean(0)
        mean /= max(float(np.linalg.norm(mean)), 1e-9)
        alike, classes = x @ mean, np.array([length_class(v) for v in n])
        least, found = [], 0.0
        for k in range(64):
            if (classes == k).sum() >= MIN_CLASS:
                found = SLACK * float(alike[classes >= k].min())
            least.append(found)
        return cls(mean, least)


@dataclasses.dataclass
class Model:
    families: Rest | None
    within: dict[str, Pairwise]
    centers: dict[str, Center]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Each text's label, score, and whether it is of a known language."""
        labels, scores, known = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        for at in range(0, len(texts), SLICE_ROWS):
            found = [(i, *v) for i, t in enumerate(texts[at : at + SLICE_ROWS], at) if self.families and t and (v := features(t)) is not None]
            if not found:
                continue
            x = np.stack([v for _, v, _ in found])
            family = self.families.scores(x)
            chosen = family.argmax(1)
            for f in set(chosen.tolist()):
                rows = np.nonzero(chosen == f)[0]
                machines = self.within[self.families.labels[f]]
                inner = machines.scores(x[rows])
                best = inner.argmax(1)
                for r, b, s in zip(rows, best, inner[np.arange(len(rows)), best], strict=True):
                    i, v, n = found[r]
                    labels[i], scores[i] = machines.labels[b], float(s * family[r, f])
                    center = self.centers[labels[i]]
                    known[i] = bool(v @ center.mean >= center.least[length_class(n)])
        return labels, scores, known


def family_of(label: str) -> str:
    return next((k for k, v in FAMILIES.items() if label in v.split()), label)


def fit(df: DataFrame, *, text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS, most_labels: int = MOST_LABELS) -> Model:
    """Machines from a bounded sample of the rows with a label. Counts go over all rows; the sample's vectors, a few KB
    each, come to the driver."""
    bounded_arrow(df.sparkSession)
    src = df.select(df[text_col].alias("text"), df[label_col].cast("string").alias("label")).where("label is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counts = {r["label"]: r["n"] for r in src.select("label", "h").distinct().groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels).collect()}
    if not counts:
        return Model(None, {}, {})
    each = max(MIN_EACH, train_rows // len(counts))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.5 * each + 50) / n))]), F.col("label"))
    hashed = src.where(F.col("label").isin(*counts)).where(F.pmod("h", F.lit((1 << 62) - 1)) < share * float(1 << 62))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            got = [features(t) for t in batch.column("text").to_pylist()]
            as_bytes = [None if v is None else np.nonzero(v[0])[0].astype(np.uint16).tobytes() + v[0][v[0] > 0].tobytes() for v in got]
            n = [None if v is None else v[1] for v in got]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array(as_bytes, pa.binary()), pa.array(n, pa.int64())], ["label", "h", "v", "n"])

    rows = hashed.mapInArrow(released(vectors), "label string, h long, v binary, n long").where("v is not null").groupBy("label", "h").agg(F.first(F.struct("v", "n")).alias("v"))
    w = Window.partitionBy("label").orderBy("h")
    rows = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).select("label", "v.v", "v.n").collect()
    if not rows:
        return Model(None, {}, {})
    rows.sort(key=lambda r: (r["label"], r["v"]))  # the order of sums, too, is then the same in every run
    x = np.zeros((len(rows), DIMS + 1), np.float32)
    x[:, DIMS] = 1
    for i, r in enumerate(rows):
        n = len(r["v"]) // 6
        x[i, np.frombuffer(r["v"], np.uint16, n)] = np.frombuffer(r["v"][2 * n :], np.float32)
    y, n = np.array([r["label"] for r in rows], dtype=object), np.array([r["n"] for r in rows])
    family = np.array([family_of(v) for v in y], dtype=object)
    del rows
    within = {f: Pairwise.fit(x[family == f], y[family == f]) for f in set(family.tolist())}
    model = Model(Rest.fit(x, family), within, {v: Center.fit(np.ascontiguousarray(x[y == v, :DIMS]), n[y == v]) for v in set(y.tolist())})
    del x
    release()
    return model


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Per row: the id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = fit(df.where(~held_out(df[id_col])), text_col=text_col, label_col=label_col)
    src = df.select(df[id_col].alias("__id"), held_out(df[id_col]).alias("held_out"), df[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", SLICE_BYTES):
            labels, scores, _ = model.predict(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    out = src.mapInArrow(released(run), f"id {src.schema['__id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of df in a known language: those without letters, and those unlike every text of their predicted label, go.
    Only texts go to Python; the other columns wait beside them."""
    model = fit(df.where(~held_out(df[id_col])), text_col=text_col, label_col=label_col)

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for array in arrays:
                parts = by_bytes([pa.RecordBatch.from_arrays([array], ["t"])], "t", SLICE_BYTES)
                yield pa.array([k for part in parts for k in model.predict(part.column("t").to_pylist())[2]], pa.bool_())

        yield from released(run)(texts)

    rows = df.select(packed(df).alias("row"), df[text_col].alias("text")).withColumn("known", known("text"))
    return unpacked(rows.where("known"), "row", df.columns)
