"""BPE encoding and decoding over a table of distinct words.

A word is a run without ASCII white space, less one full stop or comma that follows an ASCII letter at its end (that is a
word of its own), with A-Z in lower case. The tokenizer drops white space, never merges across it or between a letter and
punctuation, and lowers case itself, so a text's ids are its words' ids one after another. The steps:

1. `block_words`: rows are gathered, in the order they are read, into blocks of about BLOCK_BYTES of text. A block yields
   each of its distinct words once, in one packed row for each bucket of the words' hash. This pre-aggregation keeps a
   frequent word from being hot: it comes once per block, not once per occurrence.
2. `word_table`: a bucket's rows meet and follow one another; each distinct word is encoded once by the tokenizers library
   (beyond WORDS_HELD words a bucket's table starts anew), and ids go back to every block that has the word, in the order
   of its words, so neither words nor places travel.
3. `block_pieces`: a block's distinct ids are joined with the id-to-piece table (as large as the vocabulary, so bounded).
4. `encode`: a block's texts meet the ids of its words and the pieces of its ids, and both are put back by position.

Decoding puts the joined pieces together in order, as the tokenizer's decode() does for a file without a decoder: pieces
joined by one space. `decode` does the same for any table of ids.

A block's key is a hash of its texts and place, so that a block read twice in different orders (Spark promises none for
inputs that are not files) does not meet another block's words; a block that meets none of its own encodes its words
itself, so results don't depend on that.

Defined results: null text is empty (no ids, empty decoded text); repeated rows give repeated rows; a text longer than a
block is a block of its own and is encoded whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelframe.llm.common import bounded_arrow, by_bytes, release, released, written

BLOCK_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
#: Words whose ids a task holds for one bucket.
WORDS_HELD = 500_000
#: Buckets of words for each shuffle partition.
BUCKETS = 2
_tokenizers: dict = {}


def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        if t.decoder is not None or t.post_processor is not None:
            raise ValueError("word-wise BPE needs a tokenizer file without decoder and post-processor")
    return _tokenizers[path]


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces by id, added tokens included."""
    t = tokenizer_of(path)
    out = [""] * (max(t.get_vocab().values(), default=-1) + 1)
    for piece, i in t.get_vocab().items():
        out[i] = piece
    return out


def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """Ids of each word as little-endian unsigned integers, of 16 bits if the vocabulary fits."""
    t, out = tokenizer_of(path), []
    kind = id_kind(path)
    for i in range(0, len(words), 4096):
        out += [np.array(e.ids, kind).tobytes() for e in t.encode_batch_fast([w.decode() for w in words[i : i + 4096]], add_special_tokens=False)]
    return out


def id_kind(path: str) -> str:
    return "<u2" if tokenizer_of(path).get_vocab_size() <= 1 << 16 else "<u4"


def parts_of(run: bytes) -> tuple[bytes, ...]:
    """The words of a run without white space. Added tokens are told apart by case, so a run that may hold one keeps it."""
    if len(run) > 1 and run[-1] in b".," and (run[-2] | 32) in b"abcdefghijklmnopqrstuvwxyz":
        return (run[:-1] if b"<|" in run else run[:-1].lower()), run[-1:]
    return (run if b"<|" in run else run.lower(),)


def words_of(cut: list[tuple[bytes, ...]]) -> list[bytes]:
    """A block's distinct words in the order in which its distinct runs, given as their words, first have them."""
    return list(dict.fromkeys(itertools.chain.from_iterable(cut)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The partition's rows in blocks: (key, slices)."""
    import xxhash

    part, k, size, held, seen = TaskContext.get().partitionId(), 0, 0, [], xxhash.xxh3_64()
    for batch in by_bytes(batches, "__text", SLICE_BYTES):
        held.append(batch)
        size += batch.column("__text").nbytes
        for text in batch.column("__text").cast(pa.binary()):
            seen.update(text.as_buffer() if text.is_valid else b"\xff")
        if size >= BLOCK_BYTES:
            seen.update(f"{part} {k}")
            yield seen.intdigest() - (1 << 63), held
            k, size, held, seen = k + 1, 0, [], xxhash.xxh3_64()
    if held:
        seen.update(f"{part} {k}")
        yield seen.intdigest() - (1 << 63), held


def _runs(batches: list[pa.RecordBatch]) -> dict[bytes, None]:
    out: dict[bytes, None] = {}
    for batch in batches:
        for text in batch.column("__text").cast(pa.binary()).to_pylist():
            if text:
                out.update(dict.fromkeys(text.split()))
    return out


def bucketed(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): the words' order by bucket, and where each bucket's words end in it."""
    at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    return np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=buckets))


def block_words(src: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words): each distinct word of each block once; a word holds no blank, so blanks part them."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for block, held in _blocks(batches):
            got = words_of([parts_of(r) for r in _runs(held)])
            order, ends = bucketed(got, buckets)
            starts = [0, *ends[:-1].tolist()]
            rows = [(k, pack(b" ".join([got[i] for i in order[start:end]]))) for k, (start, end) in enumerate(zip(starts, ends.tolist(), strict=True)) if end > start]
            del got, order
            if rows:
                k, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([block] * len(k), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "block", "words"])

    return src.mapInArrow(released(words), "bucket int, block long, words binary")


def word_table(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """(block, bucket, coded, token_ids): the ids of a block's words in a bucket, in their order, and the distinct ones."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, now, known = zstandard.ZstdDecompressor().decompress, None, {}
        kind = id_kind(tokenizer_file)
        for batch in batches:
            coded, distinct = [], []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != now or len(known) > WORDS_HELD:
                    now, known = bucket, {}
                words = unpack(packed).split(b" ")
                new = [w for w in words if w not in known]
                known.update(zip(new, encode_words(tokenizer_file, new), strict=True))
                ids = [known[w] for w in words]
                coded.append(pack_ids(ids))
                distinct.append(np.unique(np.frombuffer(b"".join(ids), kind)).astype(np.int32))
            if coded:
                yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(coded, pa.binary()), pa.array(distinct, pa.list_(pa.int32()))], ["block", "bucket", "coded", "token_ids"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(encode), "block long, bucket int, coded binary, token_ids array<int>")


def pack_ids(ids: list[bytes]) -> bytes:
    """Lengths of the words' ids, and the ids, compressed."""
    import zstandard

    sizes = np.fromiter(map(len, ids), "<i4", len(ids))
    return zstandard.ZstdCompressor(level=3).compress(len(ids).to_bytes(4, "little") + sizes.tobytes() + b"".join(ids))


def unpack_ids(coded: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(coded)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<i4", n, 4))).tolist()
    return [raw[start:end] for start, end in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def block_ids(coded: dict[int, bytes], words: list[bytes], buckets: int) -> list[bytes] | None:
    """The ids of each word; None if the rows do not hold just these words."""
    order, ends = bucketed(words, buckets)
    parts = [unpack_ids(coded[k]) if k in coded else [] for k in range(buckets)]
    if [len(p) for p in parts] != np.diff(ends, prepend=0).tolist():
        return None
    out: list[bytes] = [b""] * len(words)
    for i, ids in zip(order.tolist(), (x for p in parts for x in p), strict=True):
        out[i] = ids
    return out


class Spans:
    """Values that belong to numbered runs, one run's after another's."""

    def __init__(self, values: np.ndarray, ends: np.ndarray) -> None:
        self.values, self.starts = values, np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.lengths = ends - self.starts if len(ends) else ends

    def of(self, runs: np.ndarray) -> np.ndarray:
        """The values of these runs, in their order."""
        n = self.lengths[runs]
        upto = np.cumsum(n)
        return self.values[np.repeat(self.starts[runs] - upto + n, n) + np.arange(upto[-1])] if len(n) else self.values[:0]


def in_place(cut: list[tuple[bytes, ...]], book: dict[bytes, bytes], kind: str, piece: dict[int, str] | None) -> tuple[Spans, Spans | None]:
    """The ids of the runs' words, and their pieces, each followed by a blank. An id without a piece decodes to nothing."""
    sizes, parts = np.empty(len(cut), np.int64), []
    for i, words in enumerate(cut):
        parts.append(b"".join([book[w] for w in words]))
        sizes[i] = len(parts[-1])
    every = np.frombuffer(b"".join(parts), kind)
    ends = np.cumsum(sizes) // every.itemsize
    if piece is None:
        return Spans(every, ends), None
    used, at = np.unique(every, return_inverse=True)
    said = [piece[i].encode() + b" " if i in piece else b"" for i in used.tolist()]
    upto = np.concatenate([[0], np.cumsum(np.array(list(map(len, said)), np.int64)[at])]) if len(said) else np.zeros(1, np.int64)
    text = b"".join(map(said.__getitem__, at.tolist()))
    return Spans(every, ends), Spans(np.frombuffer(text, np.uint8), upto[ends])


def block_pieces(coded: DataFrame, pieces: DataFrame) -> DataFrame:
    """(block, pieces): a block's distinct ids with their pieces. An id that the table lacks has no piece."""
    ids = coded.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("token_ids"))).alias("ids"))
    met = ids.select("block", F.explode("ids").alias("token_id")).join(F.broadcast(pieces), "token_id")
    return met.groupBy("block").agg(F.collect_list(F.struct("token_id", "piece")).alias("pieces"))


def block_texts(src: DataFrame) -> DataFrame:
    """(block, nth, rows): a block's ids and texts as compressed Arrow slices, which are small to move."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))
        for block, held in _blocks(batches):
            for nth, batch in enumerate(held):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
                    w.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([nth], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "nth", "rows"])

    return src.mapInArrow(released(pack), "block long, nth int, rows binary")


def encode(df: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: the id and `ids` (array of int). With `digests`, what the contract wants of the ids and of the decoded
    text instead, made block by block so that neither leaves its task: n_tokens, ids_sha256, decoded_sha256."""
    spark = df.sparkSession
    bounded_arrow(spark)
    src = df.select(df[id_col].alias("__id"), df[text_col].alias("__text"))
    id_type = src.schema["__id"].dataType.simpleString()
    fields = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>"]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "ids"]
    kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32())]
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def assembled(texts: pa.Table, coded: pa.Table) -> pa.Table:
        order = np.argsort(texts.column("nth").to_numpy())
        held = [batch for k in order for batch in pa.ipc.open_stream(texts.column("rows")[int(k)].as_buffer())]
        if not held:
            return pa.table([pa.array([], k) for k in [pa.int64(), *kinds]], names=names)
        runs = _runs(held)
        cut = [parts_of(r) for r in runs]
        words = words_of(cut)
        ids = block_ids({k: x for k, x in zip(coded.column("bucket").to_pylist(), coded.column("coded").to_pylist(), strict=True) if x is not None}, words, buckets)
        piece: dict[int, str] = {}
        if digests and ids is not None:
            piece = {p["token_id"]: p["piece"] for row in coded.column("pieces") if row.is_valid for p in row.as_py()}
        elif digests:
            piece = dict(enumerate(pieces_of(tokenizer_file)))
        book = dict(zip(words, encode_words(tokenizer_file, words) if ids is None else ids, strict=True))
        del words, ids
        wide, shown = in_place(cut, book, id_kind(tokenizer_file), piece if digests else None)
        del book, cut, piece
        number = dict(zip(runs, range(len(runs)), strict=True))
        del runs
        out: list[list] = [[] for _ in kinds]
        for batch in held:
            for text in batch.column("__text").cast(pa.binary()).to_pylist():
                parts = text.split() if text else []
                found = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
                got = wide.of(found).astype("<u4")
                if not digests:
                    out[0].append(got.astype(np.int32))
                    continue
                out[0].append(len(got))
                out[1].append(hashlib.sha256(got).hexdigest())
                out[2].append(hashlib.sha256(shown.of(found)[:-1]).hexdigest())
        ids_back = pa.chunked_array([b.column("__id") for b in held])
        return pa.table([ids_back, *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=names)

    def assemble(texts: pa.Table, coded: pa.Table) -> pa.Table:
        try:
            return assembled(texts, coded)
        finally:
            release()

    table = written(word_table(block_words(src, buckets), tokenizer_file), "word-ids")
    shape = "array<struct<token_id: int, piece: string>>"
    coded = table.select("block", "bucket", "coded", F.lit(None).cast(shape).alias("pieces"))
    if digests:
        pieces = block_pieces(table, piece_table(spark, tokenizer_file))
        coded = coded.unionByName(pieces.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("coded"), F.col("pieces").cast(shape)))
    got = block_texts(src).groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, f"id {id_type}, " + ", ".join(fields))
    return got.withColumnRenamed("id", id_col)


def piece_table(spark: SparkSession, tokenizer_file: str) -> DataFrame:
    """(token_id, piece), one row per id of the vocabulary."""
    return spark.createDataFrame(list(enumerate(pieces_of(tokenizer_file))), T.StructType([T.StructField("token_id", T.IntegerType()), T.StructField("piece", T.StringType())]))


def decode(df: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and `decoded`. Ids are joined to their pieces (the piece table is as large as the vocabulary, so it
    is broadcast) and put together by position. Rows are told apart by a row number, so repeated ids stay apart; null ids
    decode to the empty text, and an id outside the vocabulary to nothing, as the library does."""
    pieces = piece_table(df.sparkSession, tokenizer_file)
    src = df.select(df[id_col].alias("__id"), df[ids_col].alias("__ids"))

    # exploded ids of one row stay in its partition; the pieces are gathered by row
    rows = src.withColumn("__row", F.monotonically_increasing_id())
    flat = rows.select("__id", "__row", F.posexplode_outer("__ids").alias("pos", "token_id"))
    joined = flat.join(F.broadcast(pieces), "token_id", "left")
    out = joined.groupBy("__row", "__id").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("p"))
    return out.select(F.col("__id").alias(id_col), F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("decoded"))
