"""Token counts of whole texts: encoding in Arrow functions that return lengths only.

A batch is re-cut by bytes, so that its memory does not depend on how long its texts are, and every text is split at safe
boundaries before the tokenizer sees it. With byte-level BPE a new pre-token always begins at a single space that stands
between two non-space characters, and on both sides of a single line feed between two non-space characters; splitting
there changes no token. The pieces repeat a lot, so their lengths are kept in a table for the life of a task, bounded in
entries and in characters; only pieces not seen before are encoded, in batches, by the tokenizers library.

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows give repeated rows; very long texts are
counted whole, and a piece without any safe boundary is encoded whole; an empty table gives an empty table; columns other than the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelframe.llm.common import bounded_arrow, by_bytes, released

#: White space that the fast split does not handle: runs of two, or any other than space and line feed.
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]")
#: A safe boundary whatever surrounds it: before a space that a non-space follows.
_BEFORE_WORD = re.compile(r"(?= \S)")
#: Lengths kept by a task, about 100 bytes each, and the characters of their pieces.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 16 << 20
BATCH_BYTES = 4 << 20


class PieceLengths:
    """Token counts of pieces between safe boundaries."""

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.on_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}
        self.chars = 0

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """Pieces to count, and tokens already certain (line feeds and special strings)."""
        if self.on_special and (n := len(self.on_special.findall(text))):
            pieces = []
            for part in self.on_special.split(text):
                more, m = self._plain(part)
                pieces += more
                n += m
            return pieces, n
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> tuple[list[str], int]:
        if _ODD_SPACE.search(text):
            return _BEFORE_WORD.split(text), 0
        lines = text.split("\n")
        if len(lines) == 1:
            return text.replace(" ", "\0 ").split("\0") if "\0" not in text else _BEFORE_WORD.split(text), 0
        if "\0" in text:
            return [p for line in lines for p in _BEFORE_WORD.split(line)], len(lines) - 1
        return text.replace(" ", "\0 ").replace("\n", "\0").split("\0"), len(lines) - 1

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not known yet, one batch for all; a closing full stop or comma after a letter is a token of its own."""
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
            self.chars = sum(map(len, self.known))
        self.chars += sum(map(len, new))
        stems = {p: p[:-1] for p in new if len(p) > 1 and p[-1] in ".," and p[-2].isalpha()}
        to_encode = [p for p in {stems.get(p, p) for p in new} if p not in self.known]
        for i in range(0, len(to_encode), 4096):
            part = to_encode[i : i + 4096]
            self.known.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        self.known.update({p: self.known[s] + 1 for p, s in stems.items()})

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self._pieces(t) if t else ([], 0) for t in texts]
        self.learn({p for pieces, _ in cut for p in pieces})
        known = self.known.__getitem__
        return [sum(map(known, pieces)) + n for pieces, n in cut]


_held: dict[str, PieceLengths] = {}


def forget() -> None:
    """Empty the tables of pieces."""
    for held in _held.values():
        held.known, held.chars = {}, 0


def lengths_of(tokenizer_file: str) -> PieceLengths:
    """One per worker and file."""
    if tokenizer_file not in _held:
        _held[tokenizer_file] = PieceLengths(tokenizer_file)
    return _held[tokenizer_file]


def token_counts(df: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). No shuffle, no state between rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow.compute as pc

        held = lengths_of(tokenizer_file)
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            n = pa.array(held.count(batch.column("__text").to_pylist()), pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column("__text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), size, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    bounded_arrow(df.sparkSession)
    src = df.select(df[id_col].alias("__id"), df[text_col].alias("__text"))
    out = src.mapInArrow(released(count, forget), f"id {src.schema['__id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
