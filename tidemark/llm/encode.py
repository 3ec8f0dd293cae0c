"""Encoding of texts with a public byte-level BPE tokenizer.

Texts go through one narrow map. A text longer than a chunk is cut into overlapping chunks
that spread over the cluster; each is pre-tokenised from its first character as if it were a
text of its own, and where the boundaries of two neighbours coincide in their overlap both
have the true boundaries from there on, because the pattern has no look-behind. Each chunk
encodes its pieces, and the pieces between the stitches are put together per text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 1 << 10

_SPLIT = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def load(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file; kept per process. It has no special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Ids of a text; the empty list for null and empty texts."""
    return load(path).encode_ordinary(text) if text else []


def decode_ids(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes joined. Undoes encode_text for every valid string."""
    enc = load(path)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")


def boundaries(text: str, start: int, is_end: bool) -> list[int]:
    """Ends of the pieces of text from `start` on that do not depend on what follows the text."""
    ends = [m.end() for m in _SPLIT.finditer(text, start)]
    return ends if is_end else [e for e in ends if e < len(text)]


def _class(c: str) -> str:
    """L, N or P (all else that is visible) of a character that both the oldest and the present
    edition of the character tables put there; empty where they differ or for white space."""
    now, old = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]
    return "" if now != old or now in "ZC" else now if now in "LN" else "P"


def _plain(text: str, at: int) -> bool:
    """A boundary at which a text may be cut and each side split alone. It follows no white space,
    whose split depends on what comes after it, and looks alike to every edition of the character
    tables: it has ASCII on both sides, or stands between two characters of old and different classes."""
    before, after = text[at - 1], text[at]
    if before.isspace():
        return False
    if before.isascii() and after.isascii():
        return True
    return bool(_class(before) and _class(after)) and _class(before) != _class(after)


def cut_chunks(text: str, size: int, overlap: int) -> list[tuple[int, str, bool]]:
    """(start, chunk with the overlap after it, whether it ends the text)."""
    n = len(text)
    return [(a, text[a : a + size + overlap], a + size + overlap >= n) for a in range(0, max(n - overlap, 1), size)]


def encode_chunk(start: int, chunk: str, is_end: bool, size: int, overlap: int, path: str) -> tuple[list[int], list[int], list[int], int]:
    """(ends, ids up to each end, ids, stitch) with positions counted in the whole text.

    ends are the possible stitches with the chunk before, which lie in the first overlap;
    stitch is the one with the chunk after, -1 if there is none, and the end of the text for
    the last chunk. ids cover all pieces up to the stitch.
    """
    enc = load(path)
    if is_end:
        stop = len(chunk)
    else:
        after = set(boundaries(chunk, size, False))
        stop = next((e for e in boundaries(chunk, 0, False) if e in after and _plain(chunk, e)), -1)
        if stop < 0:
            return [], [], [], -1
    ends, upto, ids, done = [], [], [], 0
    if start:
        for e in boundaries(chunk[:stop], 0, True):
            if e > overlap:
                break
            if e < len(chunk) and not _plain(chunk, e):
                continue
            ids += enc.encode_ordinary(chunk[done:e])
            done = e
            ends.append(start + e)
            upto.append(len(ids))
    ids += enc.encode_ordinary(chunk[done:stop])
    return ends, upto, ids, start + stop


def stitch(parts: list[tuple[int, list[int], list[int], list[int], int]]) -> list[int] | None:
    """Ids of a whole text from its chunks (start, ends, upto, ids, stitch); None if a stitch is missing."""
    out: list[int] = []
    at = 0
    for start, ends, upto, ids, stop in sorted(parts, key=lambda p: p[0]):
        skip = 0
        if start:
            i = int(np.searchsorted(ends, at)) if len(ends) else 0
            if i >= len(ends) or ends[i] != at:
                return None
            skip = upto[i]
        if stop < 0:
            return None
        out.extend(ids[skip:])
        at = stop
    return out


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((x for r in rows for x in r), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(
    df: DataFrame,
    doc_id: str,
    text: str,
    path: str = VOCABULARY,
    count_only: bool = False,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(doc_id, ids array<int>) or, with count_only, (doc_id, n_tokens) for every row of df.

    Empty and null texts both give the empty list. Strings that look like special tokens are
    ordinary text. Repeated rows come out each for itself, also those of long texts, which are
    told apart by a number given to them while they are cut.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    result = "n_tokens int" if count_only else "ids array<int>"
    name = result.split()[0]
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))

    def packed(ids: list[list[int]]) -> pa.Array:
        return pa.array([len(x) for x in ids], pa.int32()) if count_only else _lists(ids)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        for b in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in pc.cast(b.column(1), pa.string()).to_pylist()]
            yield pa.record_batch([b.column(0), packed(ids)], names=["doc_id", name])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, row, t in pdf.itertuples(index=False):
                parts = cut_chunks(t, chunk_chars, overlap_chars)
                yield pd.DataFrame(
                    {"doc_id": [doc] * len(parts), "row": row, "start": [p[0] for p in parts], "chunk": [p[1] for p in parts], "is_end": [p[2] for p in parts]}
                )

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                ends, upto, ids, stop = encode_chunk(p.start, p.chunk, p.is_end, chunk_chars, overlap_chars, path)
                core = p.chunk if p.is_end else p.chunk[:chunk_chars]
                yield pd.DataFrame(
                    {"doc_id": [p.doc_id], "row": [p.row], "start": [p.start], "core": [core], "ends": [ends], "upto": [upto], "ids": [ids], "stop": [stop]}
                )

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        ids = stitch(list(pdf[["start", "ends", "upto", "ids", "stop"]].itertuples(index=False, name=None)))
        if ids is None:  # no stitch in some overlap: the text is encoded again as a whole
            ids = load(path).encode_ordinary("".join(pdf["core"]))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], name: [len(ids) if count_only else ids]})

    schema = f"doc_id {kind}, {result}"
    done = rows.where(~is_long).mapInArrow(short, schema)
    numbered = rows.where(is_long).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    chunks = numbered.mapInPandas(cut, f"doc_id {kind}, row long, start long, chunk string, is_end boolean")
    parts = chunks.repartition("row", "start").mapInPandas(
        each, f"doc_id {kind}, row long, start long, core string, ends array<long>, upto array<long>, ids array<int>, stop long"
    )
    # a group is one text: its row of ids is the result itself
    long = parts.groupBy("row").applyInPandas(whole, schema)
    return done.unionByName(long).select(F.col("doc_id").alias(doc_id), name)
