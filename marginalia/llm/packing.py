"""Best-two-fit packing of tokenised documents into sequences.

A bin takes the largest document left, then again and again the largest that
fits. Its smallest document is then replaced by two unpacked ones, if some two
fill the gap it leaves more tightly. Documents of one length are alike, so bins
are made by the pattern of their lengths, as many at once as the counts allow;
a shard costs a few thousand patterns at most, however many documents it has.

Only lengths travel: tokens are made, measured and dropped in the scan. Pieces
that fill a sequence need no partner and no shuffle; the others, at most one a
document, are dealt into shards of bounded size and packed there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_batches, text_of
from .tokenizer_file import LibraryPieces, library_encoder, segments

#: Documents in a shard, on average. A shard wastes at most about one sequence.
SHARD_DOCS = 16_000


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset in it for each length (1 to ``capacity``)."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lengths.min() < 1 or lengths.max() > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1)
    at = np.cumsum(left) - left  # where each length's next document stands in order
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    span = np.arange(capacity + 1)

    def below() -> np.ndarray:
        """At x the largest length left that is at most x, or 0."""
        return np.maximum.accumulate(np.where(left > 0, span, 0))

    fits = below()
    while fits[-1]:
        pattern: list[int] = []
        gap = capacity

        def take(n: int) -> None:
            nonlocal fits, gap
            pattern.append(n)
            left[n] -= 1
            gap -= n
            if not left[n]:
                fits = below()

        while gap and fits[gap]:
            take(int(fits[gap]))
        if gap and len(pattern) > 1:
            small = min(pattern)
            room = gap + small
            left[small] += 1
            fits = below()
            a = span[1 : room + 1][left[1 : room + 1] > 0]
            b = fits[np.minimum(room - a, a)]
            same = (b == a) & (left[a] < 2)
            b = np.where(same, fits[np.maximum(a - 1, 0)], b)
            best = int(np.argmax(np.where(b > 0, a + b, 0))) if len(a) else 0
            if len(a) and b[best] and a[best] + b[best] > small:
                pattern.remove(small)
                gap = room
                take(int(a[best]))
                take(int(b[best]))
                while gap and fits[gap]:
                    take(int(fits[gap]))
            else:
                left[small] -= 1
                fits = below()
        kinds, uses = np.unique(pattern, return_counts=True)
        left[kinds] += uses
        times = int((left[kinds] // uses).min())
        left[kinds] -= uses * times
        fits = below()
        offset, new = 0, np.arange(made, made + times)
        for n in pattern:
            rows = order[at[n] : at[n] + times]
            at[n] += times
            bins[rows], offsets[rows] = new, offset
            offset += n
        made += times
    return bins, offsets


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first may be shorter."""
    k = -(-n // capacity)
    first = n - capacity * (k - 1)
    return [(0, first), *((first + capacity * i, capacity) for i in range(k - 1))] if n else []


_LOADED: dict = {}


def tokenise(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids_crc32 and, if wanted, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            file, encode = library_encoder(path)
            _LOADED[path] = file, LibraryPieces(encode, lambda x: np.array(x, "<u4").tobytes())
        file, known = _LOADED[path]
        get, end = known.__getitem__, np.uint32(end_id).tobytes()
        for b in text_batches(batches, 1):
            rows, out = [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                parts = [np.uint32(s).tobytes() if p is None else b"".join(map(get, file.pieces(p))) for t in segments(text) for s, p in file.parts(t)]
                ids = b"".join([*parts, end])
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    mine = ids[4 * start : 4 * (start + length)]
                    rows.append((r, k, start, length, zlib.crc32(mine)))
                    if tokens:
                        out.append(np.frombuffer(mine, "<u4").astype(np.int32))
            at, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows))
            cols = [b.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if tokens:
                cols.append(pa.array(out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * tokens).withColumnRenamed("id", id_col)


def best_fit_pack(pieces: DataFrame, capacity: int, n_docs: int, length_col: str = "length", salt_cols: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` with sequence_id and offset. Lengths must lie between 1 and ``capacity``.

    ``n_docs`` bounds the pieces shorter than the capacity and sets the number of
    shards; ``salt_cols`` deal rows to shards (default: all columns). Sequence
    numbers have gaps; full pieces have negative ones.
    """
    shards = max(1, -(-n_docs // SHARD_DOCS))
    full = F.col(length_col) >= capacity
    alone = pieces.where(full).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = pieces.where(~full).withColumn("__shard", F.pmod(F.xxhash64(*(salt_cols or pieces.columns)), F.lit(shards)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length_col, *(salt_cols or [])], kind="stable")  # retried tasks give the same bins
        bins, offsets = pack_lengths(pdf[length_col].to_numpy(), capacity)
        return pdf.drop(columns="__shard").assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return alone.unionByName(dealt.groupBy("__shard").applyInPandas(run, alone.schema))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Every document ends with one token 0, so a null or empty text is one piece of
    length 1. Repeated rows are packed each; null ids stay null; other columns are
    not read; an empty table gives an empty one.
    """
    pieces = materialise(tokenise(docs, path, capacity, 0, id_col, text_col, tokens))
    return best_fit_pack(pieces, capacity, docs.count(), "length", (id_col, "piece", "length", "ids_crc32"))
