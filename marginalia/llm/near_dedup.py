"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature has SYMBOLS minima of b = 16 bits each, and the distance of two is
the number of symbols that differ. For a threshold of most_apart() symbols it is
cut into chunks, so many that twice their number exceeds the threshold. Then two
signatures within the threshold have, by the pigeonhole principle, a chunk with
at most one difference; so for each chunk and each place in it a key leaves that
place out, and every such pair meets under some key. Pairs that meet are compared
over the whole signature, and those within the threshold are confirmed on the
full shingle sets.

Groups are never expanded into all their pairs. Documents with equal shingle
sets are one class first, and classes are numbered in order of their least id.
Then each member of a bucket is tried with the bucket's first member and the
nearest of a few before it, which is linear; the members of very common keys are
dealt to several buckets. Members that are still close to one in another
component after that, looked for in blocks, form groups, and each sends its set
to its group once; there, pairs across components are tried, and only links that
join two components come out.

At a similarity of 0.85 the distance over 80 symbols is 12 +- 3.2; most_apart() is
five deviations away, and beyond it lies a pair in about 3e-6 of cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, U64, WordHashes, materialise, mix, spread_join, text_batches, text_of, words_of
from .components import connected_components

SYMBOLS = 80
#: Members before it with which each member of a bucket is compared in the first round.
LOOK_BACK = 24
#: Rows that are compared with others at once.
BLOCK = 512
#: Members of a bucket or an unsettled group that are compared in one task; larger ones are cut into blocks, and pairs of blocks.
BLOCK_OF_GROUP = 2000
#: Classes looked at, about, to tell which keys are very common. That settles only how rows are dealt out.
SAMPLE_CLASSES = 1 << 14
#: Bits in the bitmap that tells the second scan which documents to read: 65,536 rows of one long.
BITMAP_BITS = 22


def most_apart(percent: int) -> int:
    """The distance five deviations above that of two sets with just this similarity."""
    differ = 1 - percent / 100
    return min(SYMBOLS, int(np.ceil(SYMBOLS * differ + 5 * np.sqrt(SYMBOLS * differ * (1 - differ)))))


def chunk_bounds(percent: int) -> np.ndarray:
    """Where the chunks begin and end; with one difference allowed in one of them, any most_apart() differences leave a chunk in reach."""
    chunks = most_apart(percent) // 2 + 1
    return np.arange(chunks + 1) * SYMBOLS // chunks


_MULTIPLIERS = mix(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_HASHES = WordHashes()


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; the whole sequence as one if there are fewer words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, U64)
    h = _HASHES.of(words)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), U64)
    for j in range(min(width, len(h))):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k, a in enumerate(_MULTIPLIERS):
        out[:, k] = (np.minimum.reduceat(flat * a, starts) * U64(0xD6E8FEB86659FD93)) >> U64(48)
    return out


def bucket_keys(sig: np.ndarray, percent: int = 85) -> np.ndarray:
    """SYMBOLS keys for each signature: of each chunk, with each of its places left out."""
    out = np.empty((len(sig), SYMBOLS), np.int64)
    bounds = chunk_bounds(percent)
    for low, high in zip(bounds, bounds[1:]):
        for skip in range(low, high):
            k = np.full(len(sig), skip + 1, U64)
            for j in range(low, high):
                if j != skip:
                    k = mix(k * U64(0x9E3779B97F4A7C15) + sig[:, j].astype(U64))
            out[:, skip] = k.view(np.int64)
    return out


def _digest(one: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(one.tobytes()) if len(one) else None


def _signature_rows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1, 2_000_000):
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["id", "t", "n", "h", "sig"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("t"))
    return narrow.mapInArrow(run, f"id {kind}, t long, n long, h binary, sig binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _key_rows(percent: int, hot: np.ndarray, parts: np.ndarray):
    """Rows (node, sig): key, salt, node. Members of the ``hot`` keys (sorted) are dealt to salts from 1 to ``parts``, others have salt 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                keys = bucket_keys(_matrix(part.column(1)), percent).ravel()
                nodes = np.repeat(part.column(0).to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(salts(keys, nodes, hot, parts)), pa.array(nodes)], names=["key", "salt", "node"])

    return run


def _hot_keys(classes: DataFrame, percent: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that one class in HOT_SHARE or more has, at most SYMBOLS * HOT_SHARE, and over how many buckets to deal each."""
    none = np.zeros(0, np.int64)
    return common_keys(classes.select("node", "sig"), lambda some: some.mapInArrow(_key_rows(percent, none, none), "key long, salt int, node long"), n)


def common_keys(nodes: DataFrame, keys_of, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of about SAMPLE_CLASSES of the ``n`` nodes: the keys that, by this sample, one in HOT_SHARE or more has, sorted, and over how many buckets to deal each."""
    every = max(1, n // SAMPLE_CLASSES)
    counts = keys_of(nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)).groupBy("key").agg((F.count(F.lit(1)) * every).alias("c"))
    rows = counts.where(F.col("c") >= max(BLOCK_OF_GROUP, n // HOT_SHARE)).toArrow()
    keys, c = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], -(-c[order] // BLOCK_OF_GROUP)


def salts(keys: np.ndarray, nodes: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """0, but for the ``hot`` keys 1 to ``parts`` by the node."""
    salt = np.zeros(len(keys), np.int32)
    if len(hot):
        i = np.searchsorted(hot, keys)
        i[i == len(hot)] = 0
        r = np.flatnonzero(hot[i] == keys)
        salt[r] = 1 + (mix(nodes[r].view(U64)) % parts[i[r]].astype(U64)).astype(np.int32)
    return salt


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, salt, ...) sorted by key those whose key comes more than once, and all of the common keys. The first row of a batch waits for no other but the next."""
    last: pa.RecordBatch | None = None  # the last row seen, and whether it is out
    out_already = False
    for b in batches:
        if not len(b):
            continue
        keys = b.column(0).to_numpy()
        same = np.r_[False, keys[1:] == keys[:-1]]
        if last is not None and last.column(0)[0].as_py() == keys[0]:
            same[0] = True
            if not out_already:
                yield last
        keep = same | np.r_[same[1:], False] | (b.column(1).to_numpy() > 0)
        yield b.filter(pa.array(keep))
        last, out_already = b.slice(len(b) - 1, 1), bool(keep[-1])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, as one table for each of its values."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(b)]
        if held and held[0].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
            part = b.slice(x, y - x)
            if y < len(b):
                yield pa.Table.from_batches([*held, part]).combine_chunks().to_batches()[0] if held else part
                held = []
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _apart(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (sig[:, None, :] != other[None, :, :]).sum(axis=2, dtype=np.int32)


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes allow the similarity at all."""
    small, large = np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :])
    return 100 * small >= percent * large


def _pairs(a: list, b: list, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])


def _first_round(percent: int):
    """Rows (bucket, node, n, sig) sorted by bucket and node: pairs with the first and the nearest of those just before."""

    most = most_apart(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            ids, n, sig = g.column(1), g.column(2).to_numpy(), _matrix(g.column(3))
            for start in range(0, len(g), BLOCK):
                stop = min(len(g), start + BLOCK)
                low = max(0, start - LOOK_BACK)
                d = np.where(_fits(n[start:stop], n[low:stop], percent), _apart(sig[start:stop], sig[low:stop]), SYMBOLS + 1)
                here, there = np.arange(start, stop)[:, None], np.arange(low, stop)[None, :]
                d = np.where((there < here) & (there >= here - LOOK_BACK), d, SYMBOLS + 1)
                near = d.argmin(axis=1)
                ok = d[np.arange(stop - start), near] <= most
                yield from _pairs((near + low)[ok].tolist(), (np.arange(start, stop))[ok].tolist(), ids)
                hub = (_apart(sig[start:stop], sig[:1])[:, 0] <= most) & _fits(n[start:stop], n[:1], percent)[:, 0]
                hub &= (near + low != 0) & (np.arange(start, stop) > 0)
                at = np.arange(start, stop)[hub]
                yield from _pairs([0] * len(at), at.tolist(), ids)

    return run


def _unsettled(percent: int):
    """Rows (bucket, node, n, sig, comp) sorted by bucket and comp: of each bucket the members with a close one in another component, as pairs with the first such member."""
    most = most_apart(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            comp = g.column(4).to_numpy(zero_copy_only=False)
            if comp[0] == comp[-1]:
                continue
            n, sig = g.column(2).to_numpy(), _matrix(g.column(3))
            some = np.zeros(len(g), bool)
            for x in range(0, len(g), BLOCK // 4):
                xs = slice(x, min(len(g), x + BLOCK // 4))
                for y in range(x, len(g), BLOCK):
                    ys = slice(y, min(len(g), y + BLOCK))
                    if comp[xs.start] == comp[ys.stop - 1]:
                        continue
                    near = (comp[xs, None] != comp[None, ys]) & _fits(n[xs], n[ys], percent)
                    near &= _apart(sig[xs], sig[ys]) <= most
                    some[xs] |= near.any(axis=1)
                    some[ys] |= near.any(axis=0)
            at = np.flatnonzero(some)
            if len(at):
                yield from _pairs([int(at[0])] * (len(at) - 1), at[1:].tolist(), g.column(1))

    return run


def _settle(percent: int):
    """Rows (bucket, node, n, sig, comp, part, set) sorted by bucket: links that join components within a group, or between the two blocks of one.

    Pairs are tried closest first for each member, and none whose ends are already joined."""
    most = most_apart(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            comp = np.unique(g.column(4).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            n, sig, part = g.column(2).to_numpy(), _matrix(g.column(3)), g.column(5).to_numpy()
            sets = [np.frombuffer(x, U64) for x in g.column(6).to_pylist()]
            two = part[0] != part[-1] or len(np.unique(part)) > 1
            a, b = [], []
            for x in range(len(g)):
                other = comp[:x] != comp[x]
                if two:
                    other &= part[:x] != part[x]
                ys = np.flatnonzero(other)
                ys = ys[_fits(n[x : x + 1], n[ys], percent)[0]]
                d = (sig[ys] != sig[x]).sum(axis=1)
                ys = ys[d <= most]
                if not len(ys):
                    continue
                size = np.array([len(sets[y]) for y in ys])
                flat = np.concatenate([sets[y] for y in ys])
                at = np.searchsorted(sets[x], flat)
                at[at == len(sets[x])] = 0
                both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(size) - size)
                for y in ys[100 * both >= percent * (size + len(sets[x]) - both)]:
                    if comp[y] != comp[x]:
                        a.append(int(y))
                        b.append(x)
                        comp[comp == comp[y]] = comp[x]
            yield from _pairs(a, b, g.column(1))

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, set) of the classes ``wanted`` (node, id, h), made again from the texts; a bitmap of fixed size tells the scan which ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS))
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    bitmap = wanted.select(slot.alias("s")).groupBy(F.expr("s >> 6").alias("w")).agg(F.bit_or(bit).alias("bits"))
    some = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text")).withColumn("s", slot).withColumn("w", F.expr("s >> 6"))
    some = some.join(F.broadcast(bitmap), "w").where(F.col("bits").bitwiseAND(bit) != 0).select("id", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1, 2_000_000):
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            h = [_digest(s) for s in sets]
            first = {x: r for r, x in reversed(list(enumerate(zip(b.column(0).to_pylist(), h)))) if x[1] is not None}  # a repeated row once a batch
            rows = sorted(first.values())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([h[r] for r in rows], pa.binary()), pa.array([sets[r].tobytes() for r in rows], pa.binary())], names=["id", "h", "set"])

    return some.mapInArrow(make, f"id {kind}, h binary, set binary").join(wanted, ["id", "h"]).select("node", "set")


def _confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough.

    Sets are made again from the texts, only of classes in some pair; each goes
    once to each group of pairs with the same a, and groups are read as streams.
    Groups of very many pairs are cut into parts, each with the set of a.
    """
    of = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")))
    dealt = spread_join(pairs, of, "a", "c", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / BLOCK_OF_GROUP)))
    members = materialise(dealt.select("a", "salt", F.col("b").alias("node")).unionByName(dealt.select("a", "salt", F.col("a").alias("node")).distinct()))
    wanted = members.select("node").distinct().join(classes.select("node", "id", "h"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_set = None, np.zeros(0, U64)
        for b in batches:
            a, nodes, sets = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            out = []
            for r in range(len(b)):
                s = np.frombuffer(sets[r].as_py(), U64)
                if nodes[r] == a[r]:
                    own, own_set = a[r], s
                    continue
                if own != a[r]:
                    continue
                at = np.searchsorted(own_set, s)
                at[at == len(own_set)] = 0
                both = int((own_set[at] == s).sum())
                if 100 * both >= percent * (len(s) + len(own_set) - both):
                    out.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out)), b.column(1).take(pa.array(out))], names=["a", "b"])

    rows = members.join(_sets_of(docs, wanted, id_col, text_col, width), "node").withColumn("other", F.col("a") != F.col("node"))
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other").select("a", "node", "set").mapInArrow(compare, "a long, b long")


def _by_blocks(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Rows with their block (part) and a bucket for it and each other block of their key, of which ``size`` is the whole and ``most`` what a block may hold."""
    rows = rows.withColumn("of", F.ceil(F.col(size) / most).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return rows.withColumn("bucket", F.concat_ws("/", key, F.least("part", "x"), F.greatest("part", "x")))


def _grouped(rows: DataFrame, cols: list[str], then: str) -> DataFrame:
    return rows.select(*cols).repartition(cols[0]).sortWithinPartitions(cols[0], then)


def _near(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, t (a hash of the text), n and component of each row."""
    rows = materialise(_signature_rows(docs, id_col, text_col, width))
    classes = rows.where("h is not null and id is not null").groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialise(classes.orderBy("id", "h").withColumn("node", F.monotonically_increasing_id()))
    hot = _hot_keys(classes, percent, classes.count())
    keys = classes.select("node", "sig").mapInArrow(_key_rows(percent, *hot), "key long, salt int, node long")
    shared = keys.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_shared_only, "key long, salt int, node long")
    shared = materialise(shared.join(classes.select("node", "n", "sig"), "node").select("key", "salt", "node", "n", "sig"))
    pair = "a long, b long"
    buckets = shared.withColumn("bucket", F.xxhash64("key", "salt"))
    tried = materialise(_grouped(buckets, ["bucket", "node", "n", "sig"], "node").mapInArrow(_first_round(percent), pair).distinct())
    links = materialise(_confirm(docs, classes, tried, id_col, text_col, width, percent))
    so_far = materialise(connected_components(links))

    placed = shared.join(so_far, "node", "left").select("key", "node", "n", "sig", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("key", "size")
    placed = spread_join(placed, materialise(mixed), "key", "size", shared.count()).where("size is not null")
    open_ = _grouped(_by_blocks(placed, "key", "size", BLOCK_OF_GROUP), ["bucket", "node", "n", "sig", "comp"], "comp").mapInArrow(_unsettled(percent), pair)
    groups = materialise(connected_components(materialise(open_.distinct())))
    size = materialise(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    members = spread_join(groups, size, "component", "size", groups.count()).join(classes.select("node", "id", "h", "n", "sig"), "node")
    members = members.join(so_far.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = members.join(_sets_of(docs, groups.select("node").join(classes.select("node", "id", "h"), "node"), id_col, text_col, width), "node")
    more = _grouped(_by_blocks(members, "component", "size", BLOCK_OF_GROUP), ["bucket", "node", "n", "sig", "comp", "part", "set"], "node").mapInArrow(_settle(percent), pair)

    stars = so_far.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = materialise(connected_components(stars.unionByName(more)))
    named = final.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(classes.select(F.col("node").alias("component"), F.col("id").alias("least")), "component")
    final = spread_join(final, materialise(named), "component", "size", final.count()).select("node", "least")
    of_class = materialise(classes.join(final, "node", "left").select("h", F.coalesce("least", "id").alias("component"), "c"))
    out = spread_join(rows.select("id", "t", "n", "h"), of_class, "h", "c", rows.count())
    return out.select("id", "t", "n", F.when(F.col("id").isNull() | F.col("component").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id and kept for each row.

    Rows are linked whose sets of ``width``-word shingles have 100 * intersection >=
    ``percent`` * union; component_id is the smallest id reachable, kept says whether
    it is the row's own. Null, empty and blank texts have no shingles and are linked
    with nothing. Rows that repeat an id with the same text are reported each, alike;
    rows that repeat an id with another text are documents of their own, linked by
    what their texts have in common. A null id is linked with nothing: its
    component_id is null and it is kept. Other columns, whatever their names, are not
    read. An empty table gives an empty one.
    """
    out = _near(docs, percent, width, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group those with the smallest id.

    Decisions hold for an id and a text together, so a row that repeats an id with
    another text stands or falls by its own text. Rows without an id all stay, and
    so do rows that repeat both id and text of one that stays.
    """
    gone = _near(docs, percent, width, id_col, text_col).where("id <> component").select(F.col("id").alias("__i"), F.col("t").alias("__t")).distinct()
    return docs.join(gone, (docs[id_col] == gone["__i"]) & (F.xxhash64(text_of(docs[text_col])) == gone["__t"]), "left_anti")
