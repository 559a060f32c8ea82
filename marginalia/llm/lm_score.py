"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has, for every depth from 0 to
DEPTH, the context of that many bytes before it and the bits of the byte so far.
Every such node has a Krichevsky-Trofimov estimate, and its weighted probability
is half its own estimate plus half the product of its children's. Both depend on
counts only, so the tree is built bottom-up from the counts of all
(DEPTH + 1)-byte strings, gathered over all training texts.

The model gives each string that occurs anywhere the probability of its last
byte after the others: for each bit the ratio of the weighted probabilities with
and without it, which is each node's estimate and its child's mixed by the node's
posterior weight. A node never seen in training answers 1/2, as its estimate from
no counts and all below it do.

DEPTH is 5: the distinct (DEPTH + 1)-byte strings of each batch are what is
shuffled and broadcast, and their number grows with every byte of context.

Trees are split by the last two bytes of context; only the nodes above, of
which there are at most 257 * 255, are finished on the driver. The table of
strings is broadcast in slices of at most SLICE rows, one pass over the texts
for each; small corpora need one.

The base score needs the count of every token. Tokens with more than one in
FREQUENT of all, so fewer than FREQUENT of them, are broadcast; documents meet
the counts of all others in buckets of a hash of the token.

A text is modelled as its lower-cased words with one space between them and one
end byte; the code length per byte is -score / log10(2) / n_model_bytes bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by, pack, unpack
from .common import U64, WordHashes, materialise, text_of, total_bytes, words_of

DEPTH = 5
END = 10
#: Strings in one broadcast slice of the model (12 bytes each).
SLICE = 4_000_000
#: Tokens rarer than one in so many are not broadcast.
FREQUENT = 1 << 17
#: Text gathered before blocks are sent, in bytes, and text in one bucket.
GATHER_BYTES = 12_000_000
BUCKET_BYTES = 12_000_000
#: Text counted, and scored, at once.
COUNT_BYTES = 2_000_000
#: Codes looked up at once: a code of DEPTH + 1 bytes and its place among these share 64 bits.
BLOCK = 1 << 16
END_TOKEN = U64(0x5BF0A8B1457695E3)
_HASHES = WordHashes(300_000, seed=3)


def held_out(id_col: str):
    """Rows that nothing is learned from: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def strings(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte with the DEPTH before it, for all texts in turn, and the number of each text's."""
    before = bytes([END]) * DEPTH
    texts = [b"".join([before, b" ".join(d), b"\n"]) for d in docs]
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(U64)
    code = np.zeros(max(0, len(raw) - DEPTH), U64)
    for i in range(DEPTH + 1):
        code = (code << U64(8)) | raw[i : i + len(code)]
    inside = np.ones(len(code), bool)
    for e in np.cumsum(size)[:-1].tolist():
        inside[e - DEPTH : e] = False
    return code[inside], size - DEPTH


def _summed(keys: np.ndarray, *counts: np.ndarray):
    """Distinct keys and the sums of their counts."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return (keys[at], *(np.add.reduceat(c[order], at) for c in counts))


def _counted(codes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how many of each are training ones (train 1, else 0). Each is sorted with its flag as its last bit."""
    flagged = np.sort((codes << U64(1)) | train.astype(U64))
    codes = flagged >> U64(1)
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.add.reduceat((flagged & U64(1)).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    values, back = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values.tolist()])[back]


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - math.log(math.pi)


def _decisions(codes: np.ndarray):
    """For each of the eight bits: the bits before it with a leading one, and the bit."""
    x = codes & U64(255)
    for j in range(8):
        yield (U64(1) << U64(j)) | (x >> U64(8 - j)), ((x >> U64(7 - j)) & U64(1)).astype(np.int64)


def _key(codes: np.ndarray, prefix: np.ndarray, depth: int) -> np.ndarray:
    context = (codes >> U64(8)) & U64((1 << (8 * depth)) - 1)
    return (context << U64(8)) | prefix


def build(codes: np.ndarray, counts: np.ndarray, top: int = 2) -> dict[int, tuple]:
    """For each depth from DEPTH to ``top``: node keys (sorted), n0, n1, log weighted probability, weight of the own estimate."""
    seen = counts > 0
    codes, counts = codes[seen], counts[seen]
    out: dict[int, tuple] = {}
    for d in range(DEPTH, top - 1, -1):
        keys, zeros, ones = [], [], []
        for prefix, bit in _decisions(codes):
            keys.append(_key(codes, prefix, d))
            ones.append(counts * bit)
            zeros.append(counts * (1 - bit))
        k, n0, n1 = _summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
        out[d] = (k, n0, n1, *_weigh(k, n0, n1, out[d + 1][0] & U64((1 << (8 * d + 8)) - 1) if d < DEPTH else None, out[d + 1][3] if d < DEPTH else None))
    return out


def _weigh(keys, n0, n1, child_parents, child_logs) -> tuple[np.ndarray, np.ndarray]:
    own = log_kt(n0, n1)
    if child_parents is None:
        return own, np.ones(len(keys))
    below = np.bincount(np.searchsorted(keys, child_parents), child_logs, len(keys))
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def log10_of(codes: np.ndarray, nodes: dict[int, tuple]) -> np.ndarray:
    """log10 of the probability of each code's last byte after the others, by nodes of all depths from 0."""
    out = np.zeros(len(codes))
    for prefix, bit in _decisions(codes):
        p = np.full(len(codes), 0.5)
        for d in range(DEPTH, -1, -1):
            keys, n0, n1, _, weight = nodes[d]
            if not len(keys):
                continue
            k = _key(codes, prefix, d)
            at = np.searchsorted(keys, k)
            at[at == len(keys)] = 0
            found = keys[at] == k
            one = (n1[at] + 0.5) / (n0[at] + n1[at] + 1)
            own = np.where(bit == 1, one, 1 - one)
            p = np.where(found, weight[at] * own + (1 - weight[at]) * p, 0.5)
        out += np.log10(p)
    return out


def _look_up(keys: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Values of codes, 0 for those that are not among the sorted keys. Codes are sorted first, each with its place in its block below it, which makes the search local."""
    out = np.zeros(len(codes), np.float32)
    if not len(keys):
        return out
    places = np.arange(BLOCK, dtype=U64)
    for s in range(0, len(codes), BLOCK):
        part = codes[s : s + BLOCK]
        placed = np.sort((part << U64(16)) | places[: len(part)])
        sorted_ = placed >> U64(16)
        at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        own = sorted_[at]
        i = np.searchsorted(keys, own)
        i[i == len(keys)] = 0
        v = np.where(keys[i] == own, values[i], np.float32(0))
        out[s + (placed & U64(BLOCK - 1)).astype(np.int64)] = np.repeat(v, np.diff(np.r_[at, len(part)]))
    return out


def _gathered(batches: Iterator[pa.RecordBatch], most: int):
    """Row, id, text and held-out columns of about ``most`` bytes of text at a time."""
    rows, size = [], 0
    for b in batches:
        for i, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            rows.append((i, t, h))
            size += len(t)
            if size >= most:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _tokens(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end, and the text of each."""
    n = np.array([len(d) + 1 for d in docs], np.int64)
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]), U64)
    for d, e in zip(docs, ends.tolist()):
        out[e - len(d) - 1 : e - 1] = _HASHES.of(d)
    out[ends - 1] = END_TOKEN
    return out, np.repeat(np.arange(len(docs)), n)


def _delta(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=U64(0))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score, n_model_bytes of each row.

    A null or empty text is one end token. A null id is part of the training rows.
    Repeated rows are counted and scored each. Without training rows every bit has
    probability 1/2. Other columns are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"), held_out(id_col).alias("held_out"))
    _, size = total_bytes(docs, text_col)
    buckets = max(4, -(-size // BUCKET_BYTES))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        size = 0

        def send() -> pa.RecordBatch:
            codes, counts = _summed(*(np.concatenate([x[k] for x in some]) for k in (0, 1)))
            words, times = _summed(*(np.concatenate([x[k] for x in some]) for k in (2, 3)))
            out = [(0, p, 0, pack(_delta(codes[r]), counts[r].astype(np.uint32))) for p, r in by(_code_bucket(codes, buckets))]
            out += [(1, p, int(times[r].sum()), pack(_delta(words[r]), times[r].astype(np.uint32))) for p, r in by((words % U64(buckets)).astype(np.int64))]
            return _batch(("kind", "part", "n", "block"), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), out)

        for rows in _gathered(batches, COUNT_BYTES):
            docs = [words_of(t) for _, t, _ in rows]
            train = np.array([not h for _, _, h in rows], np.int64)
            codes, sizes = strings(docs)
            codes, counts = _counted(codes, np.repeat(train, sizes))
            words, of = _tokens(docs)
            words, times = _summed(words, train[of])
            some.append((codes, counts, words[times > 0], times[times > 0]))
            size += int(sizes.sum())
            if size >= GATHER_BYTES:
                yield send()
                some, size = [], 0
        if some:
            yield send()

    gathered = materialise(narrow.mapInArrow(gather, "kind int, part long, n long, block binary"))
    total = int(gathered.where("kind = 1").agg(F.sum("n")).first()[0] or 0)

    # tokens
    def sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in _by_part(batches):
            words, times = _merged(blocks)
            often = times * FREQUENT > total
            yield _batch(("part", "v", "often", "block"), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), [(part, len(words), pack(words[often], times[often]), pack(words, times.astype(np.uint32)))])

    words = materialise(gathered.where("kind = 1").select("part", "block").repartition(buckets, "part").mapInArrow(sum_words, "part long, v long, often binary, block binary"))
    vocabulary = int(words.agg(F.sum("v")).first()[0] or 0)
    often = [unpack(r["often"]) for r in words.select("often").toLocalIterator()]
    often_words, often_times = (np.concatenate([o[k] for o in often]) if often else np.zeros(0, U64) for k in range(2))
    order = np.argsort(often_words)
    often_words, often_logs = often_words[order], np.log10(often_times[order] + 1.0)
    del often

    # the tree
    def sum_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in _by_part(batches):
            codes, counts = _merged(blocks)
            keys, n0, n1, logs, _ = build(codes, counts)[2]
            up, a, b, s = _summed(keys & U64(0xFFFF), n0, n1, logs)
            yield _batch(("part", "block", "up"), (pa.int64(), pa.binary(), pa.binary()), [(part, pack(codes, counts), pack(up, a, b, s))])

    merged = materialise(gathered.where("kind = 0").select("part", "block").repartition(buckets, "part").mapInArrow(sum_strings, "part long, block binary, up binary"))
    top: tuple = tuple(np.zeros(0, t) for t in (U64, np.int64, np.int64, float))
    for r in merged.select("up").toLocalIterator():  # at most 256 * 255 rows each
        top = _summed(*(np.concatenate(x) for x in zip(top, unpack(r["up"]))))
    keys, n0, n1, below = top
    nodes = {1: (keys, n0, n1, *_weigh(keys, n0, n1, keys, below))}
    root, r0, r1, below = _summed(keys & U64(0xFF), n0, n1, nodes[1][3])
    nodes[0] = (root, r0, r1, *_weigh(root, r0, r1, root, below))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                codes, counts = unpack(block)
                values = log10_of(codes, build(codes, counts) | nodes).astype(np.float32)
                for at in range(0, len(codes), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 50_000].view(np.int64)), pa.array(values[at : at + 50_000])], names=["code", "value"])

    table = materialise(merged.select("block").mapInArrow(answer, "code long, value float"))
    rows = table.count()
    slices = max(1, -(-rows // SLICE))

    def broadcast_slice(k: int):
        some = table.where(F.pmod(F.xxhash64("code"), F.lit(slices)) == k) if slices > 1 else table
        some = some.toArrow()
        codes, values = some.column(0).to_numpy().view(U64), some.column(1).to_numpy()
        order = np.argsort(codes)
        return spark.sparkContext.broadcast((codes[order], values[order]))

    frequent = spark.sparkContext.broadcast((often_words, often_logs))

    def score(k: int, model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes_in, values_in = model.value
            number = TaskContext.get().partitionId() << 40
            for rows in _gathered(batches, COUNT_BYTES):
                docs = [words_of(t) for _, t, _ in rows]
                codes, sizes = strings(docs)
                sums = np.add.reduceat(_look_up(codes_in, values_in, codes).astype(np.float64), np.cumsum(sizes) - sizes)
                ids = np.arange(number, number + len(rows))
                number += len(rows)
                out = [(r, i, h, n, 0, 0.0, s, z, None, None) for r, (i, _, h), n, s, z in zip(ids.tolist(), rows, [len(d) + 1 for d in docs], sums.tolist(), sizes.tolist())]
                if k == 0:
                    words, of = _tokens(docs)
                    all_words, all_logs = frequent.value
                    at = np.searchsorted(all_words, words)
                    at[at == len(all_words)] = 0
                    common = all_words[at] == words if len(all_words) else np.zeros(len(words), bool)
                    logs = np.bincount(of[common], all_logs[at[common]], len(docs)) if common.any() else np.zeros(len(docs))
                    known = np.bincount(of[common], minlength=len(docs))
                    out = [(*o[:4], int(a), float(b), *o[6:]) for o, a, b in zip(out, known, logs)]
                    words, of = words[~common], of[~common]
                    order = np.argsort(words)
                    words, of = words[order], of[order]
                    for p, r in by((words % U64(buckets)).astype(np.int64)):
                        out.append((None, None, None, None, None, None, None, None, p, pack(int(ids[0]), _delta(words[r]), of[r].astype(np.uint16 if len(rows) < 65_536 else np.uint32))))
                yield _batch(names, kinds, out)

        return run

    names = ("row", "id", "held_out", "n_tokens", "n_known", "logs", "score", "bytes", "part", "block")
    id_kind = pa.int64() if kind in ("bigint", "long") else pa.string() if kind == "string" else pa.int32()
    kinds = (pa.int64(), id_kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary())
    scored = None
    for k in range(slices):
        cast = broadcast_slice(k)
        one = materialise(narrow.mapInArrow(score(k, cast), f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, bytes long, part long, block binary"))
        cast.unpersist()
        scored = one if scored is None else scored.unionByName(one.where("row is not null"))

    def rare(left: pa.Table, right: pa.Table) -> pa.Table:
        words, times = (np.concatenate(x) for x in zip(*map(unpack, right.column("block").to_pylist()))) if len(right) else (np.zeros(0, U64), np.zeros(0, np.uint32))
        out = []
        for base, steps, of in map(unpack, left.column("block").to_pylist()):
            own = np.cumsum(steps)
            at = np.searchsorted(words, own)
            at[at == len(words)] = 0
            hit = words[at] == own if len(words) else np.zeros(len(own), bool)
            of, c = of[hit].astype(np.int64), times[at[hit]]
            out.append((base, pack(*_summed(of, np.ones(len(of), np.int64), np.log10(c + 1.0)))))
        return pa.Table.from_batches([_batch(("part", "block"), (pa.int64(), pa.binary()), out)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, blocks in _by_part(batches):  # the sums of one batch of texts, from all buckets
            row, n, logs = _summed(*(np.concatenate(x) for x in zip(*map(unpack, blocks))))
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64) + base), pa.array(n), pa.array(logs.astype(float))], names=["row", "n_known", "logs"])

    asked = scored.where("block is not null").select("part", "block").groupBy("part")
    partial = asked.cogroup(words.select("part", "block").groupBy("part")).applyInArrow(rare, "part long, block binary")
    partial = partial.repartition(buckets, "part").mapInArrow(add_up, "row long, n_known long, logs double")
    own = scored.where("row is not null").drop("part", "block")
    nothing = {c: F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns if c not in partial.columns}
    both = own.unionByName(partial.select(*partial.columns, *nothing.values()))
    out = both.groupBy("row").agg(
        F.first("id", True).alias("id"), F.first("held_out", True).alias("held_out"), F.first("n_tokens", True).alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("logs").alias("logs"), F.sum("score").alias("score"), F.first("bytes", True).alias("bytes"),
    )
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(total + vocabulary + 1)).alias("base_score"),
        "score",
        F.col("bytes").alias("n_model_bytes"),
    )


def _code_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of context, so that the trees below them stay whole."""
    x = ((codes >> U64(8)) & U64(0xFFFF)) * U64(0x9E3779B97F4A7C15)
    return ((x >> U64(33)) % U64(buckets)).astype(np.int64)


def _batch(names, kinds, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))


def _by_part(batches: Iterator[pa.RecordBatch]):
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for p, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(p, []).append(block)
    while held:
        yield held.popitem()


def _merged(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of sorted (key steps, counts) blocks, a few at a time, so that only distinct keys stay."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    for at in range(0, len(blocks), 16):
        some = [unpack(b) for b in blocks[at : at + 16]]
        keys, counts = _summed(np.concatenate([keys, *[np.cumsum(k) for k, _ in some]]), np.concatenate([counts, *[c.astype(np.int64) for _, c in some]]))
    return keys, counts
