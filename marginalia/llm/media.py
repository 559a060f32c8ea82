"""Cropped and edited copies of images by local descriptors.

Corners are found at several scales, one in each neighbourhood, so that their
number follows the area and a crop keeps those of its part. Around each, pairs of
pixels of a pattern turned by the corner's own orientation are compared, one bit a
pair. Images with equal descriptor chunks meet in hash tables (an equi-join on each
chunk, so that descriptors with fewer errors than chunks surely meet); those that
meet often enough are compared by all their corners, the matched corners vote for a
shift, turn and scale, and images with enough corners that agree are linked. Groups
of copies are the connected components of the links.

Equal files are one class before anything else, and only descriptors are shuffled,
never images. In the first round each entry of a table is matched with the first
and the one before it in order of id, which is linear; entries of very common
chunks are dealt to several tables. Then, where a table still holds images of
different components, its corners are joined with their nearest such ones into
keys of two corners and how they lie to each other. All images that share such a
key with an image of another component form groups, and in these every pair of
images from different components is compared by all its corners, in blocks; only
links that join two components come out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialise, mix, spread_join, text_batches
from .components import connected_components
from .near_dedup import BLOCK_OF_GROUP, _by_blocks, _grouped, _groups, _pairs, _shared_only, common_keys, salts

SCALES = (1.0, 0.75, 0.5)
#: A corner is the strongest within so many pixels, at each scale.
REACH = 6
BITS, CHUNKS = 128, 4
RADIUS = 9
TURNS = 24
#: Corners that must agree on one shift, turn and scale.
AGREE = 5
#: Chunks two images must share to be compared in the first round.
MEET = 2
#: Bits that may differ between two corners of images that are compared.
NEAR = 12
#: Nearest corners of the same scale that each corner is paired with in the keys of groups.
PARTNERS = 3
#: Bytes of corners of a group that are compared in one task; larger groups are cut into blocks, and pairs of blocks.
BLOCK_BYTES = 8_000_000
#: Pairs of corners compared at once.
CORNER_PAIRS = 4_000_000

_rng = np.random.default_rng(20240229)
#: Pairs of places (x, y) in the corner's own direction x. Those of a pair lie across it, for along it the brightness always rises, and such a bit says little.
_PATTERN = _rng.uniform(-RADIUS + 1, RADIUS - 1, (BITS, 2, 2))
_PATTERN[:, 1, 0] = _PATTERN[:, 0, 0]
_ANGLES = np.arange(TURNS) * 2 * np.pi / TURNS
_TURNED = np.stack([np.rint(_PATTERN @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(np.int64) for a in _ANGLES])
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
_EDGE = 2 * RADIUS - 3


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def encode_png(image: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in image.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values (0 to 255) of a binary PGM of one or two bytes a value or an 8-bit, non-interlaced PNG; None for anything else, a file that is cut off included."""
    try:
        if data and data[:2] == b"P5":
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while end < len(data) and not data[end : end + 1].isspace():
                    end += 1
                fields.append(int(data[at:end]))  # nothing is left of a file that ends here, which is no number
                at = end
            w, h, most = fields
            if not (w > 0 and h > 0 and 0 < most < 65536):
                return None
            values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", w * h, at + 1).reshape(h, w)
            return np.minimum(values, most).astype(np.float32) * np.float32(255 / most) if most != 255 else values.astype(np.float32)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(data)
    except (ValueError, IndexError, KeyError, UnboundLocalError, MemoryError, struct.error, zlib.error):
        return None
    return None


def _decode_png(data: bytes) -> np.ndarray:
    at, packed, w = 8, b"", 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or laced:
                raise ValueError("only 8-bit images without interlacing are read")
            channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.int64)
    for y in range(h):
        line, up = raw[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(w * channels, np.int64)
        f = raw[y, 0]
        if f == 0:
            out[y] = line
        elif f == 1:
            out[y] = (line.reshape(w, channels).cumsum(axis=0) & 255).ravel()
        elif f == 2:
            out[y] = (line + up) & 255
        else:
            row = out[y]
            for x in range(w * channels):
                left = row[x - channels] if x >= channels else 0
                corner = up[x - channels] if x >= channels else 0
                if f == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((left, up[x], corner), key=lambda v: abs(p - v))
                row[x] = (line[x] + guess) & 255
    image = out.reshape(h, w, channels).astype(np.float32)
    return image[:, :, :3].mean(axis=2) if channels >= 3 else image[:, :, 0]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of side 2 r + 1; edges repeat."""
    p = np.pad(a, r, mode="edge").cumsum(axis=0).cumsum(axis=1)
    p = np.pad(p, ((1, 0), (1, 0)))
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a
    h, w = int(a.shape[0] * scale), int(a.shape[1] * scale)
    ys, xs = np.arange(h) / scale, np.arange(w) / scale
    y0, x0 = np.minimum(ys.astype(int), a.shape[0] - 2), np.minimum(xs.astype(int), a.shape[1] - 2)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    b = a[y0][:, x0] * (1 - fy) * (1 - fx) + a[y0 + 1][:, x0] * fy * (1 - fx) + a[y0][:, x0 + 1] * (1 - fy) * fx + a[y0 + 1][:, x0 + 1] * fy * fx
    return b


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """The maximum over a square of side 2 r + 1."""
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
        n, have = a.shape[axis], 1
        while 2 * have <= 2 * r + 1:
            p = np.maximum(p[:-have] if axis == 0 else p[:, :-have], p[have:] if axis == 0 else p[:, have:])
            have *= 2
        rest = 2 * r + 1 - have
        a = np.maximum(p[:n], p[rest : rest + n]) if axis == 0 else np.maximum(p[:, :n], p[:, rest : rest + n])
    return a


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, turn, scale) in image pixels, and packed bits, of the corners at each scale."""
    points, bits = [], []
    for s in SCALES:
        if min(image.shape) * s <= 2 * _EDGE + 2:
            continue
        a = _box(_resized(image, s), 1)
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[_EDGE:-_EDGE, _EDGE:-_EDGE]
        ys, xs = np.nonzero((inner > 1e-3) & (inner >= _highest(r, REACH)[_EDGE:-_EDGE, _EDGE:-_EDGE]))
        ys, xs = ys + _EDGE, xs + _EDGE
        if not len(ys):
            continue
        disc = a[ys[:, None] + _DISC[:, 0], xs[:, None] + _DISC[:, 1]]
        disc = disc - disc.mean(axis=1, keepdims=True)
        angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
        turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
        at = _TURNED[turn]
        smooth = _box(a, 1)
        first = smooth[ys[:, None] + at[:, :, 0, 1], xs[:, None] + at[:, :, 0, 0]]
        second = smooth[ys[:, None] + at[:, :, 1, 1], xs[:, None] + at[:, :, 1, 0]]
        points.append(np.stack([xs / s, ys / s, turn, np.full(len(xs), s)], axis=1))
        bits.append(np.packbits(first < second, axis=1))
    if not points:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(points), np.concatenate(bits)


def agreeing(p: np.ndarray, q: np.ndarray) -> int:
    """How many matched corners (rows of x, y, turn, scale) agree on one scale, turn and shift (to 6 pixels)."""
    ratio = p[:, 3] / q[:, 3]
    turn = (p[:, 2] - q[:, 2]) % TURNS
    a = turn * 2 * np.pi / TURNS
    k = q[:, 3] / p[:, 3]
    dx = p[:, 0] - k * (np.cos(a) * q[:, 0] - np.sin(a) * q[:, 1])
    dy = p[:, 1] - k * (np.sin(a) * q[:, 0] + np.cos(a) * q[:, 1])
    same = np.rint(p[:, 0]) * 4096 + np.rint(p[:, 1])
    most = 0
    for off in (0.0, 3.0):  # bins overlap by half
        key = np.stack([np.rint(ratio * 100), turn, np.floor((dx + off) / 6), np.floor((dy + off) / 6)], axis=1)
        _, own = np.unique(key, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([own.ravel(), same], axis=1), axis=0)
        most = max(most, int(np.bincount(pairs[:, 0].astype(np.int64)).max()))
    return most


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(-1, 4).astype(float)


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, U64).reshape(-1, BITS // 64)


def matched(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of 64-bit words that differ in at most NEAR bits, in blocks."""
    step = max(1, CORNER_PAIRS // max(1, len(e)))
    found = [np.nonzero(sum(np.bitwise_count(d[at : at + step, None, k] ^ e[None, :, k]) for k in range(d.shape[1])) <= NEAR) for at in range(0, len(d), step)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i + k * step for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def chunk_keys(d: np.ndarray) -> np.ndarray:
    """A row of CHUNKS table keys for each corner's packed bits."""
    return np.ascontiguousarray(d).view(">u4").reshape(-1, CHUNKS).astype(np.int64) * CHUNKS + np.arange(CHUNKS)


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance): the ``k`` nearest others of each point, of equal ones those with the least numbers, nearest first.

    Points lie in a grid of about ``k`` a cell. A point looks at squares of cells around its own; those
    for which the square is not yet sure to hold the nearest look again at a wider one.
    """
    n = len(x)
    side = max(1e-6, float(np.sqrt(max(np.ptp(x), 1.0) * max(np.ptp(y), 1.0) * k / n)))
    cx, cy = ((x - x.min()) // side).astype(np.int64), ((y - y.min()) // side).astype(np.int64)
    wide = int(cx.max()) + 1
    cell = cy * wide + cx
    order = np.argsort(cell, kind="stable")
    ranked = cell[order]
    out_j, out_d = np.empty((n, k), np.int64), np.empty((n, k))
    todo, reach = np.arange(n), 1
    while len(todo):
        again = []
        most = max(1, CORNER_PAIRS // (4 * k * (2 * reach + 1) ** 2))
        for part in (todo[a : a + most] for a in range(0, len(todo), most)):
            rows = np.arange(-reach, reach + 1)
            at = (cy[part, None] + rows) * wide
            lo = np.searchsorted(ranked, at + np.maximum(cx[part, None] - reach, 0), side="left")
            hi = np.searchsorted(ranked, at + np.minimum(cx[part, None] + reach, wide - 1), side="right")
            size = (hi - lo).ravel()
            ends = np.cumsum(size)
            other = order[np.repeat(lo.ravel(), size) + np.arange(ends[-1]) - np.repeat(ends - size, size)]
            own = np.repeat(np.repeat(np.arange(len(part)), 2 * reach + 1), size)
            keep = other != part[own]
            own, other = own[keep], other[keep]
            d = (x[part[own]] - x[other]) ** 2 + (y[part[own]] - y[other]) ** 2
            by = np.lexsort((other, d, own))
            own, other, d = own[by], other[by], d[by]
            counts = np.bincount(own, minlength=len(part))
            starts = np.cumsum(counts) - counts
            # sure if the k-th lies within what the square surely covers
            edge = np.minimum.reduce([x[part] - x.min() - (cx[part] - reach) * side, (cx[part] + reach + 1) * side - (x[part] - x.min()), y[part] - y.min() - (cy[part] - reach) * side, (cy[part] + reach + 1) * side - (y[part] - y.min())])
            full = counts >= k
            sure = np.zeros(len(part), bool)
            sure[full] = d[starts[full] + k - 1] < edge[full] ** 2
            everything = reach > max(wide, int(cy.max()) + 1)
            done = np.flatnonzero(sure | everything)
            pick = starts[done, None] + np.arange(k)
            out_j[part[done]], out_d[part[done]] = other[pick], d[pick]
            again.append(part[~(sure | everything)])
        todo, reach = np.concatenate(again), reach * 2
    return np.repeat(np.arange(n), k), out_j.ravel(), out_d.ravel()


def pair_keys(p: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Distinct keys of corners with their nearest ones of the same scale: two chunks of both, their turns, and how they lie; unchanged by shift and turn."""
    chunks = np.ascontiguousarray(d).view(">u4").reshape(-1, CHUNKS).astype(U64)
    out = [np.zeros(0, U64)]
    for s in SCALES:
        at = np.flatnonzero(p[:, 3] == np.float32(s))
        if len(at) < 2:
            continue
        x, y, turn = p[at, 0] * s, p[at, 1] * s, p[at, 2].astype(np.int64)
        i, j, apart = nearest(x, y, min(PARTNERS, len(at) - 1))
        lie = np.rint(np.arctan2(y[j] - y[i], x[j] - x[i]) * TURNS / (2 * np.pi)).astype(np.int64)
        how = ((lie - turn[i]) % TURNS * TURNS + (turn[j] - turn[i]) % TURNS) * 1024 + np.minimum(np.rint(np.sqrt(apart) / 2), 1023).astype(np.int64)
        for c in range(CHUNKS):
            k = how.astype(U64) * U64(CHUNKS) + U64(c)
            for e in (c, (c + 1) % CHUNKS):
                k = mix(mix(k) + chunks[at[i], e] * U64(2**32) + chunks[at[j], e])
            out.append(k)
    return np.unique(np.concatenate(out)).view(np.int64)


def _entries(hot: np.ndarray, parts: np.ndarray):
    """Rows (node, bits): key, salt, node of the tables, each once an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1, 2_000_000):
            keys = [np.unique(chunk_keys(np.frombuffer(d, np.uint8))) for d in b.column(1).to_pylist()]
            nodes = np.repeat(b.column(0).to_numpy(), [len(k) for k in keys])
            keys = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(salts(keys, nodes, hot, parts)), pa.array(nodes)], names=["key", "salt", "node"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node) sorted by both: each node with the first of its bucket and with the one before it."""
    last_key, first, before = None, 0, 0
    for b in batches:
        if not len(b):
            continue
        keys, nodes = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.r_[keys[0] != last_key, keys[1:] != keys[:-1]]
        heads = np.where(new, np.arange(len(keys)), -1)
        heads = np.maximum.accumulate(heads)
        hub = np.where(heads >= 0, nodes[heads], first)
        prev = np.r_[before, nodes[:-1]]
        linked = ~new
        far = linked & (hub != prev)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[prev[linked], hub[far]]), pa.array(np.r_[nodes[linked], nodes[far]])], names=["a", "b"])
        last_key, first, before = keys[-1], int(hub[-1]), int(nodes[-1])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, node, points, bits) sorted by a, its own row first in each part: the pairs whose corners agree."""
    own, p, d = None, np.zeros((0, 4)), np.zeros((0, BITS // 64), U64)
    for b in batches:
        a, nodes = b.column(0).to_pylist(), b.column(1).to_pylist()
        out = []
        for r in range(len(b)):
            q, e = _points(b.column(2)[r].as_py()), _words(b.column(3)[r].as_py())
            if nodes[r] == a[r]:
                own, p, d = a[r], q, e
            elif own == a[r] and copies(p, d, q, e):
                out.append(r)
        if out:
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out)), b.column(1).take(pa.array(out))], names=["a", "b"])


def copies(p: np.ndarray, d: np.ndarray, q: np.ndarray, e: np.ndarray) -> bool:
    """Whether two images have enough matching corners that agree; by all corners of both."""
    i, j = matched(d, e)
    return len(i) >= AGREE and agreeing(p[i], q[j]) >= AGREE


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, comp, points, bits, open): pair keys of the corners with a chunk among the open ones."""
    for b in text_batches(batches, 3, 1_000_000):
        keys = []
        for p, d, some in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
            d = np.frombuffer(d, np.uint8).reshape(-1, BITS // 8)
            own = np.isin(chunk_keys(d), np.array(some, np.int64)).any(axis=1)
            keys.append(pair_keys(_points(p)[own], d[own]))
        at = pa.array(np.repeat(np.arange(len(b)), [len(k) for k in keys]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column(1).take(at), b.column(0).take(at)], names=["key", "comp", "node"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, comp, part, points, bits) sorted by bucket: links that join components within a group, or between the two blocks of one."""
    for g in _groups(batches):
        comp, part = np.unique(g.column(2).to_numpy(), return_inverse=True)[1], g.column(3).to_numpy()
        points, words = [_points(x) for x in g.column(4).to_pylist()], [_words(x) for x in g.column(5).to_pylist()]
        size = np.array([len(x) for x in points])
        starts = np.cumsum(size) - size
        own, bits = np.repeat(np.arange(len(g)), size), np.concatenate(words)
        two = len(np.unique(part)) > 1
        a, b = [], []
        for x in range(1, len(g)):
            other = comp[:x] != comp[x]
            if two:
                other &= part[:x] != part[x]
            rows = np.flatnonzero(other[own[: starts[x]]])
            if not len(rows):
                continue
            i, j = matched(words[x], bits[rows])
            j = rows[j]
            for y in np.flatnonzero(np.bincount(own[j], minlength=x) >= AGREE):
                if comp[y] != comp[x]:
                    m = own[j] == y
                    if agreeing(points[x][i[m]], points[y][j[m] - starts[y]]) >= AGREE:
                        a.append(int(y))
                        b.append(x)
                        comp[comp == comp[y]] = comp[x]
        yield from _pairs(a, b, g.column(1))


def image_copies(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """``id_col``, n_points, component_id, kept of each row: images linked as copies share the smallest id reachable.

    Data that is null, empty or not a readable image has no points; equal files are
    still copies of each other, null or empty ones are not. An image without
    corners (of one grey, say, or of less than 33 pixels a side) is linked with
    equal files only. Rows that repeat an id are reported each; with other data each
    by its own. A null id is linked with nothing: its component_id is null and it is
    kept. Images are decoded one at a time, whatever their size. Other columns,
    whatever their names, are not read. An empty table gives an empty one.
    """
    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(media[id_col].alias("id"), F.when(F.octet_length(media[data_col]) > 0, F.sha2(media[data_col], 256)).alias("h"), F.coalesce(media[data_col], F.lit(b"")).alias("data"))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 2, 2_000_000):
            found, bits = [], []
            for r in range(len(b)):
                image = decode(b.column(2)[r].as_py())
                p, d = describe(image) if image is not None and image.ndim == 2 else (np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))
                found.append(p.astype(np.float32).tobytes())
                bits.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary()), pa.array(bits, pa.binary())], names=["id", "h", "points", "bits"])

    light = materialise(rows.mapInArrow(points, f"id {kind}, h string, points binary, bits binary"))
    classes = light.where("h is not null and id is not null").groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"), F.first("points").alias("points"), F.first("bits").alias("bits"))
    known = materialise(classes.orderBy("id", "h").withColumn("node", F.monotonically_increasing_id()))
    shown = known.where("octet_length(points) > 0").select("node", "points", "bits")

    none, entry, pair = np.zeros(0, np.int64), "key long, salt int, node long", "a long, b long"
    hot = common_keys(shown.select("node", "bits"), lambda some: some.mapInArrow(_entries(none, none), entry), known.count())
    shared = shown.select("node", "bits").mapInArrow(_entries(*hot), entry).repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_shared_only, entry)
    shared = materialise(shared)
    tried = _grouped(shared.withColumn("bucket", F.xxhash64("key", "salt")), ["bucket", "node"], "node").mapInArrow(_neighbours, pair)
    tried = materialise(tried.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= MEET).select("a", "b"))
    of = materialise(tried.groupBy("a").agg(F.count(F.lit(1)).alias("c")))
    dealt = spread_join(tried, of, "a", "c", tried.count()).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / BLOCK_OF_GROUP)))
    members = dealt.select("a", "salt", F.col("b").alias("node")).unionByName(dealt.select("a", "salt", F.col("a").alias("node")).distinct())
    members = members.join(shown, "node").withColumn("other", F.col("a") != F.col("node"))
    links = members.repartition("a", "salt").sortWithinPartitions("a", "salt", "other").select("a", "node", "points", "bits").mapInArrow(_verified, pair)
    so_far = materialise(connected_components(materialise(links)))

    placed = shared.select("key", "node").join(so_far, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("key", "size")
    open_ = spread_join(placed, materialise(mixed), "key", "size", shared.count()).where("size is not null").groupBy("node", "comp").agg(F.collect_set("key").alias("open"))
    keyed = open_.join(shown, "node").select("node", "comp", "points", "bits", "open").mapInArrow(_open_pairs, "key long, comp long, node long")
    keyed = materialise(keyed)
    meet = keyed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("node").alias("least"), F.count(F.lit(1)).alias("size")).where("x <> y").select("key", "least", "size")
    edges = spread_join(keyed, materialise(meet), "key", "size", keyed.count()).where("size is not null").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    groups = materialise(connected_components(edges).join(shown, "node").select("node", "component", "points", "bits"))
    size = materialise(groups.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("points") + F.octet_length("bits")).alias("size")))
    in_groups = spread_join(groups, size, "component", "c", groups.count()).join(so_far.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    more = _grouped(_by_blocks(in_groups, "component", "size", BLOCK_BYTES), ["bucket", "node", "comp", "part", "points", "bits"], "node").mapInArrow(_settle, pair)

    stars = so_far.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = materialise(connected_components(stars.unionByName(more)))
    named = final.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(known.select(F.col("node").alias("component"), F.col("id").alias("least")), "component")
    final = spread_join(final, materialise(named), "component", "size", final.count()).select("node", "least")
    of_class = materialise(known.select("h", "id", "c", "node").join(final, "node", "left").select("h", "c", F.coalesce("least", "id").alias("component_id")))
    out = spread_join(light.select("id", "h", (F.octet_length("points") / 16).cast("int").alias("n_points")), of_class, "h", "c", light.count())
    component = F.when(F.col("id").isNull() | F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_points", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def render(vector: list[float] | None, side: int = 96, seed: int = 1) -> np.ndarray:
    """An image drawn from a vector: a smooth ground, texture of three grains, and patches whose places follow from the vector's bytes."""
    v = np.asarray([0.0 if x is None else x for x in (vector or [0.0])], np.float32)
    rng = np.random.default_rng(zlib.crc32(v.tobytes()) ^ seed)
    ground = np.resize(v, 64).reshape(8, 8)
    image = 90 + 50 * np.kron((ground - ground.min()) / (np.ptp(ground) + 1e-9), np.ones((side // 8, side // 8)))
    for grain, strength in ((12, 16), (6, 14), (3, 10)):
        image += strength * np.kron(rng.normal(size=(side // grain, side // grain)), np.ones((grain, grain)))
    for _ in range(12):
        y, x = rng.integers(0, side - 8, 2)
        h, w = rng.integers(4, 18, 2)
        image[y : y + h, x : x + w] = 0.5 * image[y : y + h, x : x + w] + rng.uniform(0, 128)
    return np.clip(_box(image, 1), 0, 255).astype(np.uint8)


def edited(image: np.ndarray, k: int) -> np.ndarray:
    """A crop, a brighter copy or a darker crop, by ``k``."""
    if k % 3 == 1:
        return np.clip(image.astype(np.float32) * 0.9 + 20, 0, 255).astype(np.uint8)
    cut = image[6:, 9:] if k % 3 == 0 else image[:-10, 4:-5]
    return cut if k % 3 == 0 else np.clip(cut.astype(np.float32) * 0.8, 0, 255).astype(np.uint8)


def media_from_vectors(embeddings: DataFrame) -> DataFrame:
    """(media_id, data): a PGM for each vector; every fifth (id modulo 5 is 1) is an edited copy of the image before it."""
    before = embeddings.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before")).where("vec_id % 5 = 1").dropDuplicates(["vec_id"])
    pairs = embeddings.select("vec_id", "embedding").join(before, "vec_id", "left")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 256):
                c = b.slice(s, 256)
                out = [encode_pgm(edited(render(p), i // 5) if p is not None else render(v)) for i, v, p in zip(*(c.column(k).to_pylist() for k in range(3)))]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(out, pa.binary())], names=["media_id", "data"])

    return pairs.mapInArrow(draw, "media_id long, data binary")
