"""Byte-level BPE with a local rank file.

``encode`` adds the token ids of every whole text, ``decode`` turns ids back into bytes.  Both are maps
over Arrow batches: nothing is shuffled, and each Python worker reads the rank file once.

Long texts are cut at safe boundaries and encoded piece by piece.  No match of the pre-splitting pattern
runs from a non-space character into white space, so a cut between the two changes no token.  A very long
run of white space is one match by itself (less its last character, if text follows) and is merged directly,
because the pattern engine keeps a stack entry for every character of it.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import map_columns

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts above this many characters are cut at safe boundaries.
PIECE = 1 << 16
#: Runs of white space above this length are merged without the pattern engine.
RUN = 1 << 14

# The characters the pattern engine counts as white space.
_SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{{RUN},}}")
_BOUNDARY = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


@functools.lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str):
    """The tiktoken encoding of a rank file; one per worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def pieces(text: str, most: int = PIECE):
    """Parts of ``text``, cut only between a non-space character and white space, of about ``most``
    characters; longer where no such boundary exists."""
    start = 0
    while len(text) - start > most:
        m = _BOUNDARY.search(text, start + most)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc, text: str | None) -> np.ndarray:
    """Ids of a whole text (null: none)."""
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) < RUN:
        return enc.encode_to_numpy(text, disallowed_special=())
    ids = []
    for piece in pieces(text):
        at = 0
        for m in _LONG_RUN.finditer(piece):
            end = m.end() - (m.end() < len(piece))  # the last one belongs to what follows
            ids.append(enc.encode_to_numpy(piece[at:m.start()], disallowed_special=()))
            ids.append(np.array(enc._encode_single_piece(piece[m.start():end]), np.uint32))
            at = end
        ids.append(enc.encode_to_numpy(piece[at:], disallowed_special=()))
    return np.concatenate(ids)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus ``ids`` array<int>: the token ids of the whole text.

    Null and empty texts give an empty array.  Repeated rows are encoded each.  A column already called
    ``ids`` is replaced; other columns pass through.  An empty table stays empty.
    """

    def make():
        enc = encoding(ranks, pattern)

        def columns(texts: pa.Array) -> list[pa.Array]:
            rows = [encode_text(enc, t) for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)))]

        return columns

    return map_columns(df, {"t": text}, f"`{ids}` array<int>", make)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out`` binary: the raw bytes of the ids (null ids: no bytes).  Bytes, not text, because
    a list of ids may end inside a character."""

    def make():
        enc = encoding(ranks, pattern)

        def columns(lists: pa.Array) -> list[pa.Array]:
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            given = lists.is_valid().to_pylist()
            return [pa.array([enc.decode_bytes(flat[a:b].tolist()) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], given)], pa.binary())]

        return columns

    return map_columns(df, {"i": ids}, f"`{out}` binary", make)


def token_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode(docs.select("doc_id", "text"), ranks, pattern).select("doc_id", "ids")
    both = decode(coded, ranks, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
