"""Many rows as one compressed block, for exchanges where a row of its own would cost more than its data."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 3)


def unpack(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def by(keys: np.ndarray):
    """(key, positions) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else []
    for a, z in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(keys[order[a]]), order[a:z]


def rows_of(rows: list[tuple[int, bytes]], names: tuple[str, str] = ("part", "block")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=list(names))


def whole(batches: Iterator[pa.RecordBatch]):
    """All blocks of each bucket in the partition; blocks stay compressed until their turn."""
    for _, blocks in named(batches):
        yield blocks


def named(batches: Iterator[pa.RecordBatch]):
    """Each bucket in the partition and all its blocks."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for p, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(p, []).append(block)
    while held:
        yield held.popitem()
