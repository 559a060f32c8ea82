"""Repeated passages, exactly, by a sampled suffix array over UTF-8 bytes.

A byte is removed if a ``match``-byte string that covers it also starts in a
document with a smaller id. Sorting the suffixes at all bytes would move many
times the text, so suffixes are sampled by content: every window of ``match``
bytes belongs to the least (by a hash) of the PREFIX-byte strings in it, so equal
windows choose equal suffixes wherever they stand. Neighbouring windows with the
same choice form a segment, about one for every seventeen bytes.

1. Texts go to groups by a hash of the text, equal ones end in one row of the least id.
2. Each segment sends two keys of four bytes and its place to the bucket of its
   suffix. Buckets are ranges of the suffix's first PREFIX bytes, cut by sampled
   splitters. Suffixes that agree in these bytes never straddle two buckets, so
   whatever could match across a boundary is on one side of it. A window reaches
   either at least ``middle(match)`` bytes to the left of its suffix or further to the right, so two
   equal windows agree in all bytes of one of two stretches around it, about two
   thirds of a window each. Segments whose stretches stand in one document only are done.
3. The others meet their texts again and send their bytes, equal ones of a group
   once, with where they stand, to the same buckets.
4. A bucket sorts the windows of its segments by multikey quicksort, with eight
   bytes as one character, and only neighbours that are still equal go on to
   the next character. Of equal windows the smallest document keeps its own.
5. Removed ranges meet their texts once more; where rows are wanted with their
   other columns, they go on to the documents themselves.

Between the steps a document is its place in its group (by the hash of its text), which takes
two bytes where id and hash would take sixteen in each bucket.

A document is an id together with a hash of its text, so rows that repeat an id
with another text stay apart; which document came first is told by the ids alone.

Texts and segments travel as compressed blocks of many rows. The number of
buckets follows the bytes of the input. Equal texts in a batch are sent once,
and so are equal segments of a group in steps 3 and 4: a passage that is in very many
documents costs a bucket no more than one row for each group, apart from the
segments at its two ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .blocks import by, named, pack, rows_of, unpack, whole
from .common import U64, materialise, spread_join, text_of, total_bytes

PREFIX = 16
#: Text of one bucket, and of one group of documents, in bytes.
BUCKET_BYTES = 6_000_000
#: Text that a task gathers before it sends blocks.
GATHER_BYTES = 16_000_000
#: Buckets of segments that share one bucket of keys.
COARSE = 4
#: Bytes of text worked on at once; a longer document is read in parts that overlap.
PART = 400_000
#: Splitters come from about so many documents, and so many suffixes of each.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 2000, 64


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian integer; the last seven positions have none."""
    out = np.empty(max(0, len(buf) - 7), U64)
    for r in range(min(8, len(out))):
        part = buf[r : r + (len(buf) - r) // 8 * 8].view(">u8")
        out[r::8] = part
    return out


def middle(match: int) -> int:
    """Windows that reach so far to the left of their suffix are told by their left stretch, the others by their right one."""
    return (match - PREFIX + 1) // 2


def _stretch(g: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Hashes of the bytes from ``first`` to ``last`` (excluded) relative to ``at``, never 0."""
    x = np.full(len(at), first & 0xFF, U64)
    for o in [*range(first, last - 8, 8), last - 8]:
        x = (x ^ g[np.clip(at + o, 0, len(g) - 1)]) * U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(29)
    return np.maximum(x >> U64(32), U64(1)).astype(np.uint32)


class Segments:
    """Runs of windows of one buffer that choose equal prefixes: start, number of windows, choice, first PREFIX bytes of the suffix as two words.
    keyed, left and right: segments with the keys of the stretches around their suffix; 0 where no window needs one."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray, match: int):
        """``ends``: where each text in ``buf`` ends; windows stay within one."""
        padded = np.concatenate([buf, np.zeros(PREFIX, np.uint8)])
        g = words8(padded)
        h = g[:-8] * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
        h += g[8:] * U64(0xBF58476D1CE4E5B9)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(32)
        h |= U64(1)
        width = match - PREFIX + 1
        n = len(buf) - match + 1
        if n <= 0:
            self.start = self.count = np.zeros(0, np.int64)
            self.choice, self.lead = np.zeros(0, U64), np.zeros((0, 2), U64)
            self.keyed, self.left, self.right = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
            return
        least, have = h, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        least = np.minimum(least[:n], least[width - have : width - have + n])
        for e in ends[:-1].tolist():
            least[max(0, e - match + 1) : e] = 0
        cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[cut, n])
        ok = least[cut] != 0
        self.start, self.count = cut[ok], count[ok]
        self.choice = least[self.start]
        last = self.start + self.count - 1
        at = np.full(len(last), -1)
        todo = np.arange(len(last))
        for j in range(width):
            hit = h[last[todo] + j] == self.choice[todo]
            at[todo[hit]] = last[todo[hit]] + j
            todo = todo[~hit]
            if not len(todo):
                break
        self.lead = np.stack([g[at], g[at + 8]], axis=1)
        self._keys(g, h, at, last, match)

    def _keys(self, g: np.ndarray, h: np.ndarray, at: np.ndarray, last: np.ndarray, match: int) -> None:
        mid, width = middle(match), match - PREFIX + 1
        keys = lambda p: (_stretch(g, p, -mid, PREFIX), _stretch(g, p, 0, match - mid + 1))
        self.keyed = np.arange(len(at))
        self.left, self.right = keys(at)
        self.left[at - self.start < mid] = 0
        self.right[at - last >= mid] = 0
        # a prefix that comes more than once in a segment: equal windows may name another of its places, so all have keys
        again = np.zeros(len(at), bool)
        for d in range(1, width + 1):
            again |= (at - d >= self.start) & (h[np.maximum(at - d, 0)] == self.choice)
            again |= (at + d < last + width) & (h[np.minimum(at + d, len(h) - 1)] == self.choice)
        more = []
        for i in np.flatnonzero(again).tolist():
            p = self.start[i] + np.flatnonzero(h[self.start[i] : last[i] + width] == self.choice[i])
            both = np.unique(np.stack(keys(p), axis=1), axis=0)
            more.append((np.full(len(both), i), both[:, 0], both[:, 1]))
        if more:
            one = ~again
            own = (self.keyed[one], self.left[one], self.right[one])
            self.keyed, self.left, self.right = (np.concatenate(c) for c in zip(own, *more))


def _parts(texts: list[bytes], match: int):
    """(text's number, offset in it, buffer, ends) for parts of about PART bytes; windows of a text fall into exactly one."""
    held, size = [], 0

    def out():
        return np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held]), np.frombuffer(b"".join([t for _, _, t in held]), np.uint8), np.cumsum([len(t) for _, _, t in held])

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - match + 1), PART):
            part = t[at : at + PART + match - 1] if len(t) > PART else t
            held.append((i, at, part))
            size += len(part)
            if size >= PART:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _in_texts(texts: list[bytes], match: int):
    """Segments of parts of the texts, with the number of the text and the offset in it of each."""
    for which, offset, buf, ends in _parts(texts, match):
        s = Segments(buf, ends, match)
        k = np.searchsorted(ends, s.start, side="right")
        begin = ends - np.diff(np.r_[0, ends])
        yield s, which[k], s.start - begin[k] + offset[k]


def segments_of(texts: list[bytes], match: int):
    """Of all texts: number of the text, offset in it, windows, choice, lead."""
    rows = [(which, start, s.count, s.choice, s.lead) for s, which, start in _in_texts(texts, match)]
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64), np.zeros((0, 2), U64)
    return tuple(np.concatenate(x) for x in zip(*rows))


def keys_of(texts: list[bytes], match: int):
    """Of all texts: number of the text, offset of a segment in it, lead, left and right key; a segment may have several."""
    rows = [(which[s.keyed], start[s.keyed], s.lead[s.keyed], s.left, s.right) for s, which, start in _in_texts(texts, match)]
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros((0, 2), U64), z.astype(np.uint32), z.astype(np.uint32)
    return tuple(np.concatenate(x) for x in zip(*rows))


def _bucket(lead: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many of the sorted splitters are not above each lead; both are rows of two words."""
    out = np.searchsorted(splitters[:, 0], lead[:, 0], side="right")
    low = np.searchsorted(splitters[:, 0], lead[:, 0], side="left")
    for r in np.flatnonzero(np.r_[True, splitters[1:, 0] != splitters[:-1, 0]][: len(splitters)]).tolist():  # leads that tie with splitters in the first word
        some = np.flatnonzero((low == r) & (out > r))
        if len(some):
            out[some] = r + np.searchsorted(splitters[r : int(out[some[0]]), 1], lead[some, 1], side="right")
    return out


def _tag(text: bytes) -> int:
    """The hash that Spark's xxhash64 gives for the text, as unsigned."""
    return xxhash.xxh64_intdigest(text, 42)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Two bytes a number where they are enough, else four."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _runs(docs: np.ndarray, *then: np.ndarray):
    """Rows sorted by document and ``then``: each document, its number of rows, and the columns of ``then`` in that order."""
    order = np.lexsort((*reversed(then), docs))
    d = docs[order]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    return _narrow(d[first]), _narrow(np.diff(np.r_[first, len(d)])), *(_narrow(x[order]) for x in then)


def _gathered(batches: Iterator[pa.RecordBatch], match: int):
    """Ids, tags and texts of about GATHER_BYTES at a time; too short ones are left out, equal ones keep the smallest id."""
    best: dict[int, tuple[int, bytes]] = {}
    size = 0

    def out():
        return np.array([i for i, _ in best.values()], np.int64), np.array(list(best), U64), [t for _, t in best.values()]

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            t = t.as_buffer().to_pybytes()
            if i is None or len(t) < match:
                continue
            key = _tag(t)
            had = best.get(key)
            if had is None:
                size += len(t)
            if had is None or i < had[0]:
                best[key] = (i, t)
            if size >= GATHER_BYTES:
                yield out()
                best, size = {}, 0
    if best:
        yield out()


def _group_of(tags: np.ndarray, groups: int) -> np.ndarray:
    """By the text alone, so that equal texts of all batches meet."""
    x = tags * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(32)
    return ((x * U64(0xBF58476D1CE4E5B9)) >> U64(33)).astype(np.int64) % groups


def _sampled_splitters(narrow: DataFrame, n_docs: int, buckets: int, match: int) -> np.ndarray:
    every = max(1, n_docs // SAMPLE_DOCS)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _gathered(batches, match):
            out = []
            for t in texts:
                lead = segments_of([t[:PART]], match)[4]
                out.append(lead[:: max(1, -(-len(lead) // SAMPLE_SUFFIXES))])
            lead = np.concatenate(out).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lead[:, 0]), pa.array(lead[:, 1])], names=["a", "b"])

    some = narrow.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).mapInArrow(leads, "a long, b long").toArrow()
    a, b = (some.column(k).to_numpy().view(U64) for k in range(2))
    if not len(a):
        return np.zeros((0, 2), U64)
    order = np.lexsort((b, a))[(np.arange(1, buckets) * len(a)) // buckets]
    return np.unique(np.stack([a[order], b[order]], axis=1), axis=0)


def _sort_windows(word: np.ndarray, at: np.ndarray, group: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort with eight bytes as a character. Of windows ``at`` the ones equal to another of their group, and a number for each set of equals."""
    active = np.argsort(group, kind="stable")
    own = group[active]
    for off in [*range(0, match - 7, 8), *([match - 8] if match % 8 else [])]:
        same = np.r_[False, own[1:] == own[:-1]]
        live = same | np.r_[same[1:], False]
        active, own = active[live], own[live]
        if not len(active):
            break
        w = word[at[active] + off]
        o = np.argsort(w, kind="stable")
        o = o[np.argsort(own[o], kind="stable")]
        active, own, w = active[o], own[o], w[o]
        own = np.cumsum(np.r_[0, (own[1:] != own[:-1]) | (w[1:] != w[:-1])])
    same = np.r_[False, own[1:] == own[:-1]]
    live = same | np.r_[same[1:], False]
    return active[live], own[live]


def _resolve(texts: list[bytes], choice: np.ndarray, docs: np.ndarray, which: np.ndarray, match: int):
    """Segments ``texts`` with their choices stand in ``docs`` (``which``: the segment of each occurrence).
    Yields occurrences, first and last byte (relative, last excluded) of what is removed."""
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    later = np.flatnonzero(docs > least[which])
    size = np.array([len(t) for t in texts], np.int64)
    yield later, np.zeros(len(later), np.int64), size[which[later]]
    _, group, members = np.unique(choice, return_inverse=True, return_counts=True)
    some = np.flatnonzero(members[group] > 1)
    if not len(some):
        return
    buf = np.frombuffer(b"".join([texts[i] for i in some]), np.uint8)
    word = words8(buf)
    count = size[some] - match + 1
    begin = np.cumsum(size[some]) - size[some]
    seg = np.repeat(np.arange(len(some)), count)
    first = np.cumsum(count) - count
    rel = np.arange(len(seg)) - first[seg]
    active, own = _sort_windows(word, begin[seg] + rel, group[some][seg], match)
    if not len(active):
        return
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    low = np.minimum.reduceat(least[some][seg[active]], starts)
    low = np.repeat(low, np.diff(np.r_[starts, len(active)]))
    hit = np.sort(active[low < least[some][seg[active]]])
    if not len(hit):
        return
    new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (seg[hit[1:]] != seg[hit[:-1]])]
    a, z = hit[new], hit[np.r_[new[1:], True]]
    of, lo, hi = some[seg[a]], rel[a], rel[z] + match
    owner = np.flatnonzero(docs == least[which])  # several only where rows repeat
    owner = owner[np.argsort(which[owner], kind="stable")]
    left, right = np.searchsorted(which[owner], of, "left"), np.searchsorted(which[owner], of, "right")
    times = right - left
    pick = np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    yield owner[pick], np.repeat(lo, times), np.repeat(hi, times)


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[new[1:], True]]


def _documents(blocks) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, tags and texts of a group, by tag, of equal texts the least id. Places in this order name documents: they do not hang on the order of blocks."""
    ids, tags, texts = [], [], []
    for own, own_tags, sizes, joined in map(unpack, blocks):
        ends = np.cumsum(sizes).tolist()
        ids.append(own)
        tags.append(own_tags)
        texts += [joined[e - n : e] for e, n in zip(ends, sizes.tolist())]
    ids, tags = np.concatenate(ids), np.concatenate(tags)
    order = np.lexsort((ids, tags))
    order = order[np.r_[True, tags[order][1:] != tags[order][:-1]]]
    return ids[order], tags[order], [texts[i] for i in order.tolist()]


def _marked(blocks):
    """Blocks of _runs() as columns with a row each: document and the others."""
    cols = [(np.repeat(d.astype(np.int64), n), *(x.astype(np.int64) for x in then)) for d, n, *then in map(unpack, blocks)]
    return [np.concatenate(c) for c in zip(*cols)]


def _in_two(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each key (0: none) stands in two documents."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    low, high = np.minimum.reduceat(docs[order], cuts), np.maximum.reduceat(docs[order], cuts)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat((low < high) & (keys[order][cuts] != 0), np.diff(np.r_[cuts, len(keys)]))
    return out


def _without(text: bytes, a: np.ndarray, z: np.ndarray) -> bytes:
    """The text without its merged ranges from ``a`` to ``z``."""
    return b"".join([text[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(text)])])


BLOCK_ROW = "part long, block binary"


def _marks(docs: DataFrame, id_col: str, text_col: str, match: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of texts and blocks of the ranges that equal strings of smaller ids remove from them, both by the group of
    the text. Ranges may overlap; of equal texts the one with the least id is marked."""
    narrow = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), text_of(text_col).alias("text"))
    n_docs, size = total_bytes(docs, text_col)
    groups = max(4, -(-size // BUCKET_BYTES))
    splitters = _sampled_splitters(narrow, n_docs, groups, match)

    def send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, texts in _gathered(batches, match):
            yield rows_of([(p, pack(ids[r], tags[r], np.array([len(texts[i]) for i in r]), b"".join([texts[i] for i in r]))) for p, r in by(_group_of(tags, groups))])

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, blocks in named(batches):
            which, start, lead, left, right = keys_of(_documents(blocks)[2], match)
            if len(which):
                yield rows_of([(p, pack(group, *_runs(which[r], start[r], left[r], right[r]))) for p, r in by(_bucket(lead, splitters) // COARSE)])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in whole(batches):
            group, docs_, start, left, right = [], [], [], [], []
            for g, d, n, at, a, b in map(unpack, blocks):
                group.append(np.full(len(at), g, np.int64))
                docs_.append(np.repeat(d, n))
                start.append(at)
                left.append(a)
                right.append(b)
            group, docs_, start, left, right = map(np.concatenate, (group, docs_, start, left, right))
            name = group << 32 | docs_
            some = _in_two(left, name) | _in_two(right, name)
            group, docs_, start = group[some], docs_[some], start[some]
            out = [(p, pack(*_runs(docs_[r], start[r]))) for p, r in by(group)]
            if out:
                yield rows_of(out)

    def send_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([])
        group = left.column("part")[0].as_py()
        ids, _, texts = _documents(left.column("block").to_pylist())
        want_doc, want_at = _marked(right.column("block").to_pylist())
        which, start, count, choice, lead = segments_of(texts, match)
        keep = np.isin(which << 32 | start, want_doc << 32 | want_at)
        which, start, count, choice, lead = which[keep], start[keep], count[keep], choice[keep], lead[keep]
        out = []
        for p, r in by(_bucket(lead, splitters)):
            seen: dict[bytes, int] = {}
            of = np.array([seen.setdefault(texts[i][a : a + c + match - 1], len(seen)) for i, a, c in zip(which[r].tolist(), start[r].tolist(), count[r].tolist())])
            picks = np.zeros(len(seen), U64)
            picks[of] = choice[r]
            own, place = np.unique(which[r], return_inverse=True)
            out.append((p, pack(group, ids[own], _narrow(own), _narrow(place), _narrow(start[r]), _narrow(of), picks, np.array([len(s) for s in seen]), b"".join(seen))))
        return _table(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in whole(batches):
            seen: dict[bytes, int] = {}
            choice, ids, group, docs_, start, of = [], [], [], [], [], []
            for g, own_ids, own, place, at, which, picks, sizes, joined in map(unpack, blocks):
                ends = np.cumsum(sizes).tolist()
                number = np.empty(len(sizes), np.int64)
                for k, (e, n) in enumerate(zip(ends, sizes.tolist())):
                    before = len(seen)
                    number[k] = seen.setdefault(joined[e - n : e], before)
                    if number[k] == before:
                        choice.append(picks[k])
                group.append(np.full(len(place), g, np.int64))
                ids.append(own_ids[place])
                docs_.append(own[place])
                start.append(at.astype(np.int64))
                of.append(number[which])
            ids, group, docs_, start, of = map(np.concatenate, (ids, group, docs_, start, of))
            found = list(_resolve(list(seen), np.array(choice, U64), ids, of, match))
            row, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(3))
            group, docs_, lo, hi = group[row], docs_[row], start[row] + lo, start[row] + hi
            out = [(p, pack(*_runs(docs_[r], lo[r], (hi - lo)[r]))) for p, r in by(group)]
            if out:
                yield rows_of(out)

    texts = narrow.mapInArrow(send_texts, BLOCK_ROW).repartition(groups, "part")
    pieces = texts.mapInArrow(send_keys, BLOCK_ROW).repartition(-(-groups // COARSE), "part").mapInArrow(shared, BLOCK_ROW)
    segments = texts.groupBy("part").cogroup(pieces.repartition(groups, "part").groupBy("part")).applyInArrow(send_segments, BLOCK_ROW)
    return texts, segments.repartition(groups, "part").mapInArrow(compare, BLOCK_ROW).repartition(groups, "part")


def _cut_texts(left: pa.Table, right: pa.Table):
    """Id, tag, text and merged ranges (first and last byte, excluded) of each text that loses something."""
    if not len(left) or not len(right):
        return
    ids, tags, texts = _documents(left.column("block").to_pylist())
    docs, lo, n = _marked(right.column("block").to_pylist())
    for k, r in by(docs):
        yield int(ids[k]), int(tags[k : k + 1].view(np.int64)[0]), texts[k], *_merge(lo[r], lo[r] + n[r])


def _removed(docs: DataFrame, id_col: str, text_col: str, match: int, with_text: bool) -> DataFrame:
    """(id, tag, n_removed, n_spans, kept_sha256, kept) of documents that lose something, of equal texts the least id."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for i, tag, t, a, z in _cut_texts(left, right):
            kept = _without(t, a, z)
            rows.append((i, tag, int((z - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("id", "tag", "n_removed", "n_spans", "kept_sha256", "kept"), cols, kinds)})

    texts, marks = _marks(docs, id_col, text_col, match)
    return texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(cut, "id long, tag long, n_removed long, n_spans long, kept_sha256 string, kept string")


def _ranges(docs: DataFrame, id_col: str, text_col: str, match: int) -> DataFrame:
    """(__i, __t, __runs) of documents that lose something, of equal texts the least id: pairs of first and last byte (excluded) as 64-bit integers."""

    def merged(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [(i, tag, np.stack((a, z), axis=1).tobytes()) for i, tag, _, a, z in _cut_texts(left, right)]
        cols = list(zip(*rows)) if rows else [()] * 3
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("__i", "__t", "__runs"), cols, (pa.int64(), pa.int64(), pa.binary()))})

    texts, marks = _marks(docs, id_col, text_col, match)
    return texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(merged, "__i long, __t long, __runs binary")


@F.arrow_udf(StringType())
def _kept(text: pa.Array, runs: pa.Array) -> pa.Array:
    """The texts without their runs; null where either is null."""
    out = []
    for t, r in zip(text, runs):
        if not t.is_valid or not r.is_valid:
            out.append(None)
            continue
        a, z = np.frombuffer(r.as_py(), np.int64).reshape(-1, 2).T
        out.append(_without(t.as_buffer().to_pybytes(), a, z).decode("utf-8", "ignore"))
    return pa.array(out, pa.string())


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([rows_of(rows)])


def repeated_passages(docs: DataFrame, match: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept_text of each row.

    Ids must be integers. A null text is empty. Texts shorter than ``match`` bytes
    lose nothing; a text equal to that of a smaller id and not shorter loses all.
    Rows that repeat an id take nothing from each other: with the same text they get
    the same result, with another text each its own. A row with a null id loses
    nothing and takes nothing from others. kept_text leaves out bytes of characters
    that were cut in two. Other columns, whatever their names, are not read. An empty
    table gives an empty one.
    """
    out = _passages(docs, match, id_col, text_col, with_text).withColumnRenamed("i", id_col).drop("t")
    return out if with_text else out.drop("kept_text")


def _classes(docs: DataFrame, match: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (i, t, n, h: hashes and bytes of the text) with k, the smallest id of equal texts of ``match`` bytes or more."""
    if match < PREFIX + 8:
        raise ValueError(f"match must be {PREFIX + 8} bytes or more")
    text = text_of(text_col)
    rows = materialise(docs.select(docs[id_col].alias("i"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("h")))
    classes = rows.where(f"i is not null and n >= {match}").groupBy("h").agg(F.min("i").alias("k"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return spread_join(rows, materialise(classes), "h", "c", rows.count())


def _passages(docs: DataFrame, match: int, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """i, t (a hash of the text), n_bytes, n_removed, n_spans, kept_sha256, kept_text (null where nothing is cut) of each row."""
    out = _classes(docs, match, id_col, text_col)
    cut = _removed(docs, id_col, text_col, match, with_text).withColumnRenamed("id", "i").withColumnRenamed("tag", "t")
    out = out.join(cut, ["i", "t"], "left")
    copy = F.coalesce(F.col("i") > F.col("k"), F.lit(False))
    return out.select(
        "i",
        "t",
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "h")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept_text"),
    )


def drop_repeated_passages(docs: DataFrame, match: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts; no row goes, and other columns stay as they are.

    What is cut holds for an id and a text together, so each of the rows that repeat
    an id with different texts keeps its own. Rows without an id stay as they are.
    """
    keys = ["__i", "__t"]
    copies = _classes(docs, match, id_col, text_col)
    gone = copies.where("i > k").select(F.col("i").cast("long").alias("__i"), F.col("t").alias("__t")).distinct().withColumn("__copy", F.lit(True))
    runs = _ranges(docs, id_col, text_col, match)
    # both joins have the same keys, so each text is shuffled once for them; only texts that lose something go to Python
    out = docs.withColumns({"__i": docs[id_col].cast("long"), "__t": F.xxhash64(text_of(docs[text_col]))}).join(runs, keys, "left").join(gone, keys, "left")
    some = F.when(F.col("__runs").isNotNull() & F.col("__copy").isNull(), F.col(text_col))
    left = F.when(F.col("__copy"), F.lit("")).otherwise(F.coalesce(_kept(some, "__runs"), F.col(text_col)))
    return out.select(*[left.alias(c) if c == text_col else F.col(c) for c in docs.columns])
