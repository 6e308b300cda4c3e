"""Encoding of a corpus with a public byte-level BPE vocabulary.

A pair of bytes that occurs inside no token of the vocabulary can never be merged, so the text may be cut
between the two: the pieces are encoded alone and their ids joined. Pieces recur (they are about words), so
each task keeps the ids of those it has met. A cut must also leave the vocabulary's own splitting pattern as
it was: none is made after white space (the pattern looks ahead from it) or before an apostrophe (it starts
the contractions).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = os.environ.get("LONGSPAN_TOKENIZERS", "/opt/tokenizers")
#: The splitting pattern published with the 50k vocabularies; fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces longer than this are not kept, and no more pieces than this are: memory of a task stays bounded.
KEEP_BYTES, KEEP_PIECES = 64, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def cut_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Of 65,536 byte pairs, those between which a cut is certain and leaves the splitting pattern alone."""
    never = np.ones(65536, dtype=bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8).astype(np.int32)
            never[b[:-1] * 256 + b[1:]] = False
    never = never.reshape(256, 256)
    never[:, 0x80:0xC0] = False  # the right byte must begin a character
    never[:, ord("'")] = False
    for left in [*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]:  # ends of white space in UTF-8, and a few others
        never[left] = False
    return never.reshape(-1)


class Pieces(dict):
    """Ids of a piece as bytes of little-endian int32, encoded at the first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        super().__init__()
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self.encode(piece.decode("utf-8", "replace")), dtype="<i4").tobytes()
        if len(piece) <= KEEP_BYTES and len(self) < KEEP_PIECES:
            self[piece] = ids
        return ids


def pieces_of(data: bytes, cuts_at: np.ndarray) -> list[bytes]:
    """The pieces of one text between its certain cuts."""
    b = np.frombuffer(data, np.uint8)
    at = (np.flatnonzero(cuts_at[b[:-1].astype(np.uint16) * 256 + b[1:]]) + 1).tolist()
    return [data[i:j] for i, j in zip([0, *at], [*at, len(data)], strict=True)]


def text_slices(arr: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each string, or None, one after the other from the Arrow buffers."""
    arr = arr.cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    if not len(arr):
        return
    at = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8).tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    there = arr.is_valid().to_pylist() if arr.null_count else [True] * len(arr)
    for a, b, known in zip(at, at[1:], there, strict=False):
        yield view[a:b].tobytes() if known else None


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``(id_col, ids ARRAY<INT>)`` for every row, without special tokens.

    Null and empty texts have the empty list. Markers of special tokens in a text are ordinary text. Repeated
    rows give repeated rows; other columns of ``df`` are not read. One narrow stage: no shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(os.path.join(folder, vocabulary))
        cuts_at, known = cut_table(ranks), Pieces(ranks)
        get = known.__getitem__
        for batch in batches:
            ids, sizes = [], [0]
            for data in text_slices(batch.column(1)):
                own = b"".join(map(get, pieces_of(data, cuts_at))) if data else b""
                ids.append(own)
                sizes.append(len(own) // 4)
            flat = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
