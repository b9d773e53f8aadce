"""Whole-corpus encoding with a public byte-level BPE vocabulary, by monoid tree reduction.

A text is cut into halves until a piece is short; pieces are encoded, and neighbours joined on the way up.
The join is exact because of a property of the pre-tokeniser's pattern: none of its matches contains a
character that is no white space followed by white space. So between such two characters there always is
a boundary, whatever surrounds them, and the tokens on either side of it never depend on each other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morbiscope.runtime import spread

TOKENIZER_DIR = os.environ.get("MORBISCOPE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
LEAF_CHARS = 4096
WINDOW = 64
_BATCH_CHARS = 2_000_000

# Fixed value: the pre-tokeniser's pattern of the public 50k byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TreeTokenizer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf_chars
        self.pieces = {i: b for b, i in ranks.items()}

    def encode(self, text: str | None) -> list[int]:
        """Token ids; null and empty texts have none; text like a special token is ordinary text."""
        if not text:
            return []
        return self.core.encode_ordinary(text) if len(text) <= self.leaf else self._reduce(text, 0, len(text))

    def _reduce(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.core.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._reduce(text, lo, mid), self._reduce(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of ``text[lo:hi]`` from those of its two parts, re-encoding only around ``mid``.

        The window grows on either side, doubling, until it ends at a certain boundary or at the text's end.
        """
        a, b, size = mid, mid, WINDOW
        while True:
            a = _boundary_before(text, max(lo, mid - size), mid)
            if a is not None or mid - size <= lo:
                break
            size *= 2
        a, size = lo if a is None else a, WINDOW
        while True:
            b = _boundary_after(text, mid, min(hi, mid + size))
            if b is not None or mid + size >= hi:
                break
            size *= 2
        b = hi if b is None else b
        enc = self.core.encode_ordinary
        drop_left, drop_right = len(enc(text[a:mid])), len(enc(text[mid:b]))
        return left[: len(left) - drop_left] + enc(text[a:b]) + right[drop_right:]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, concatenated up the same kind of tree."""

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= self.leaf:
                return b"".join(self.pieces[i] for i in ids[lo:hi])
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(ids)).decode("utf-8", errors="replace")


def _certain(text: str, i: int) -> bool:
    """A token boundary lies before ``text[i]`` in every context."""
    return text[i] in " \n\t\r" and not text[i - 1].isspace()


def _boundary_before(text: str, lo: int, mid: int) -> int | None:
    return next((i for i in range(mid - 1, lo, -1) if _certain(text, i)), None)


def _boundary_after(text: str, mid: int, hi: int) -> int | None:
    return next((i for i in range(mid + 1, hi) if _certain(text, i)), None)


@lru_cache(maxsize=4)
def tokenizer(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> TreeTokenizer:
    return TreeTokenizer(folder, vocabulary)


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most some million bytes of text, so that results stay small."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + _BATCH_CHARS, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row.

    Defined cases: null and empty texts have an empty list; blank texts are tokens like any other text;
    strings that look like special tokens are ordinary text; texts of any length are encoded whole; repeated
    rows stay repeated; an empty table gives an empty result; other columns are not read.

    Scale: no shuffle where the scan has a part per core; each task streams Arrow batches, cut again by text size. One text is handled by one
    task, whose work is linear in its length (a piece without any white space is re-encoded once per level).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [np.asarray(tok.encode(t), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def decode_documents(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and the ``text`` of every list of ids; a null list gives null, an empty one an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, vocabulary)
        for batch in batches:
            texts = [None if x is None else tok.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.select(F.col("id").alias(id_col), "text")
