"""Toxicity: a convolutional text classifier, trained and run in numpy.

A word is embedded as the sum of hashed embeddings: of itself and of its first
4, 5 and 6 bytes, so that unseen inflections of a stem are understood. Hashes
not met in enough training texts stay zero. Filters of several widths slide over
the words of the whole text, the maximum of each over all places goes through a
linear layer. Since only the place of each maximum has a gradient, training
costs little more than the forward pass.

Scores are shifted so that the best threshold on held-back training rows is
0.3. Each language also gets a threshold of its own, drawn towards 0.3 when it
has few positives; it decides ``flagged``, while scores see nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import text_batches, text_of, words_of

BUCKET_BITS = 20
WIDTHS = (1, 2, 3)
FILTERS = 16
DIM = 16
PREFIXES = (4, 5, 6)
PARTS = 1 + len(PREFIXES)
#: At most about so many labelled rows are trained on; the driver gets the numbers of their words, not the texts.
TRAIN_ROWS = 6000
#: Words of training texts that go through the filters at once.
BLOCK_WORDS = 100_000
THRESHOLD = 0.3
_PAD = max(WIDTHS) - 1
_EDGES = b".,;:!?\"'()[]{}<>*_-"
#: Words whose embeddings are remembered while scoring.
MOST_WORDS = 300_000


def buckets(word: bytes) -> list[int]:
    w = word.strip(_EDGES)
    cut = 64 - BUCKET_BITS
    return [xxhash.xxh3_64_intdigest(w) >> cut, *(xxhash.xxh3_64_intdigest(w[:n], n) >> cut for n in PREFIXES)]


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array, each followed by padding (0), and where each begins."""
    size = np.array([max(1, len(d)) + _PAD for d in docs], np.int64)
    starts = np.cumsum(size) - size
    seq = np.zeros(int(size.sum()), np.int64)
    for s, d in zip(starts, docs):
        seq[s : s + len(d)] = d
    return seq, starts


class TextCnn:
    """``rows``: bucket to row of ``emb``; row 0 is for unknown hashes and padding and stays zero."""

    def __init__(self, rows: np.ndarray, n_rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows = rows
        self.emb = rng.normal(0, 0.2, (n_rows, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.p = {"out": rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.shift = 0.0
        self.by_lang: dict[str, float] = {}
        self.trained = False

    def kernel(self) -> np.ndarray:
        """All filters side by side: a block of FILTERS for each width and place in it."""
        return np.concatenate([self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)], axis=1)

    def pool(self, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maxima over each text of embedded words, and what they were taken from."""
        sums, out, full, at = e @ self.kernel(), [], [], 0
        for w in WIDTHS:
            z = sums[:, at : at + FILTERS].copy()
            for j in range(1, w):
                z[:-j] += sums[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            out.append(np.maximum(np.maximum.reduceat(z, starts, axis=0) + self.p[f"b{w}"], 0))
            full.append(z)
        return np.concatenate(out, axis=1), full

    def maxima(self, e: np.ndarray, seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As pool() of ``e[seq]``, and the place in ``seq`` of each maximum, in blocks of BLOCK_WORDS words however long a text is."""
        kernel, ends = self.kernel(), np.append(starts[1:], len(seq))
        best = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        place = np.zeros(best.shape, np.int64)
        for low in range(0, len(seq), BLOCK_WORDS):
            high = min(len(seq), low + BLOCK_WORDS)
            sums, at = e[seq[low : high + _PAD]] @ kernel, 0
            docs = range(int(np.searchsorted(starts, low, side="right")) - 1, int(np.searchsorted(starts, high)))
            for k, w in enumerate(WIDTHS):
                z = sums[:, at : at + FILTERS].copy()
                for j in range(1, w):
                    z[:-j] += sums[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
                at += w * FILTERS
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for i in docs:
                    part = z[max(0, starts[i] - low) : min(ends[i], high) - low]
                    where = part.argmax(axis=0)
                    value = part[where, np.arange(FILTERS)]
                    more = value > best[i, own]
                    place[i, own] = np.where(more, max(starts[i], low) + where, place[i, own])
                    best[i, own] = np.where(more, value, best[i, own])
        return np.maximum(best + np.concatenate([self.p[f"b{w}"] for w in WIDTHS]), 0), place

    def logits(self, embedded: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
        """Of texts given as rows of ``embedded``, which holds zeros in row 0."""
        if not docs:
            return np.zeros(0)
        seq, starts = _padded(docs)
        h = self.pool(embedded[seq], starts)[0] if len(seq) <= BLOCK_WORDS else self.maxima(embedded, seq, starts)[0]
        return (h @ self.p["out"] + self.p["bias"][0] + self.shift).astype(np.float64)

    def fit(self, docs: list[np.ndarray], parts: np.ndarray, y: np.ndarray, epochs: int | None = None, batch: int = 64, rate: float = 5e-3, seed: int = 11) -> None:
        """``docs`` hold word numbers, ``parts`` the embedding rows of each word. Adam; embeddings are moved where touched."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()} | {"emb": np.zeros_like(self.emb)}
        v = {k: x.copy() for k, x in m.items()}
        step = 0
        epochs = epochs or int(np.clip(45_000 / max(1, len(docs)), 7, 60))  # small samples need more passes
        self.p["bias"][0] = _logit(min(0.99, max(0.01, float(y.mean()))))
        for epoch in range(epochs):
            lr = rate * (1 - epoch / epochs)
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                words, seq = np.unique(np.concatenate([[0], *[docs[i] for i in pick]]), return_inverse=True)
                own = np.split(seq[1:], np.cumsum([len(docs[i]) for i in pick])[:-1])
                seq, starts = _padded(own)
                h, places = self.maxima(self.emb[parts[words]].sum(axis=1), seq, starts)
                d = ((_sigmoid(h @ self.p["out"] + self.p["bias"][0]) - y[pick]) / len(pick)).astype(np.float32)
                grad = {"out": h.T @ d + 1e-4 * self.p["out"], "bias": np.array([d.sum()], np.float32)}
                gh = d[:, None] * self.p["out"] * (h > 0)
                rows, moves = [], []
                for i, w in enumerate(WIDTHS):
                    g = gh[:, i * FILTERS : (i + 1) * FILTERS]
                    place = places[:, i * FILTERS : (i + 1) * FILTERS]
                    grad[f"b{w}"] = g.sum(axis=0)
                    grad[f"w{w}"] = np.empty_like(self.p[f"w{w}"])
                    for j in range(w):
                        r = parts[words[seq[np.minimum(place + j, len(seq) - 1)]]]
                        grad[f"w{w}"][j] = np.einsum("bfd,bf->df", self.emb[r].sum(axis=2), g)
                        move = g[:, :, None, None] * self.p[f"w{w}"][j].T[None, :, None, :]
                        rows.append(r.reshape(-1))
                        moves.append(np.broadcast_to(move, (*r.shape, DIM)).reshape(-1, DIM))
                step += 1
                rows, back = np.unique(np.concatenate(rows), return_inverse=True)
                ge = np.stack([np.bincount(back, x, len(rows)) for x in np.concatenate(moves).T], axis=1).astype(np.float32)
                for k, g in grad.items():
                    self._adam(self.p[k], m[k], v[k], g, slice(None), lr, step)
                self._adam(self.emb, m["emb"], v["emb"], ge, rows, lr, step)
                self.emb[0] = 0

    @staticmethod
    def _adam(p, m, v, g, at, lr, step) -> None:
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.999 * v[at] + 0.001 * g * g
        p[at] -= lr * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, lang: list[str]) -> None:
        cut = best_cut(z, y)
        self.shift += _logit(THRESHOLD) - cut
        z = z - cut + _logit(THRESHOLD)
        langs = np.array([x or "" for x in lang])
        for name in sorted(set(langs.tolist())):
            own = langs == name
            n = int(y[own].sum())
            t = (n * best_cut(z[own], y[own]) + 50 * _logit(THRESHOLD)) / (n + 50) if 0 < n < own.sum() else _logit(THRESHOLD)
            self.by_lang[name] = float(_sigmoid(np.array(t)))


class Scorer:
    """Scores texts with a model, remembering the embedding of each word."""

    def __init__(self, model: TextCnn):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.embedded = np.zeros((1, DIM), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > MOST_WORDS:
            self.clear()
        docs = [words_of(t) for t in texts]
        new = list({w for d in docs for w in d}.difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number) + 1, len(self.number) + 1 + len(new))))
            parts = self.model.rows[np.array([buckets(w) for w in new])]
            self.embedded = np.concatenate([self.embedded, self.model.emb[parts].sum(axis=1)])
        get = self.number.__getitem__
        return _sigmoid(self.model.logits(self.embedded, [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the thresholds with the best F1."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(1, y.sum()))
    zs = np.r_[z[order], z.min() - 1]
    ends = np.r_[np.diff(z[order]) != 0, True]
    f1 = np.where(ends, f1, -1)
    ties = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = ties[np.argmax(zs[ties] - zs[ties + 1])]
    return float((zs[k] + zs[k + 1]) / 2)


def numbered(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text as numbers of its words, from 1, and the buckets of each word; number 0 is no word."""
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number) + 1) for w in words_of(t)], np.int32) for t in texts]
    return docs, np.array([[0] * PARTS, *map(buckets, number)], np.int32)


def train(docs: list[np.ndarray], hashed: np.ndarray, y: np.ndarray, lang: list[str], least_docs: int = 4) -> TextCnn:
    """Fits on three quarters of the rows (texts as numbered() gives them), calibrates on the rest."""
    back = np.arange(len(docs)) % 4 == 3
    if len(docs) < 8 or not 0 < y[~back].sum() < (~back).sum():
        back = np.zeros(len(docs), bool)
    seen = np.zeros(1 << BUCKET_BITS, np.int32)
    for d, b in zip(docs, back):
        if not b and len(d):
            seen[np.unique(hashed[d])] += 1
    known = np.flatnonzero(seen >= least_docs)
    rows = np.zeros(1 << BUCKET_BITS, np.int32)
    rows[known] = np.arange(1, len(known) + 1)
    model = TextCnn(rows, len(known) + 1)
    if not len(docs):
        return model
    model.trained = True
    parts = rows[hashed]
    parts[0] = 0
    model.fit([d for d, b in zip(docs, back) if not b], parts, y[~back].astype(np.float32))
    if back.any() and 0 < y[back].sum() < back.sum():
        held, embedded = [d for d, b in zip(docs, back) if b], model.emb[parts].sum(axis=1)
        z = np.concatenate([model.logits(embedded, held[at : at + 50]) for at in range(0, len(held), 50)])
        model.calibrate(np.clip(z, -27, 27), y[back].astype(np.float64), [x for x, b in zip(lang, back) if b])
    return model


def held_out(id_col: str):
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str, most: int) -> tuple[list, np.ndarray, np.ndarray, list]:
    """About ``most`` labelled rows at most, by a hash of the id; never a held-out one. Of labels that contradict each other the greatest counts.

    Texts are cut into words where they are read; what comes back is, for each
    batch, its rows as numbers of words and the buckets of each word.
    """
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("y is not null and i is not null").where(~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
    share = most / max(1, own.count())
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int(share * (1 << 20)))
    d = docs.select(F.col(id_col).alias("i"), text_of(text_col).alias("t"), F.col(lang_col).alias("l") if lang_col in docs.columns else F.lit("").alias("l"))
    rows = d.join(F.broadcast(own), "i").select(F.col("i").cast("string").alias("i"), "t", "l", F.col("y").cast("int").alias("y"))  # at most ``most`` ids and labels

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1):
            own, hashed = numbered(b.column(1).to_pylist())
            block = pack(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), own, hashed)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    found, tables, first = [], [np.zeros((1, PARTS), np.int32)], 1
    for block in rows.mapInArrow(number, "block binary").collect():
        ids, langs, ys, own, hashed = unpack(block[0])
        found += [(i, d + np.int32(first - 1), x, l) for i, d, x, l in zip(ids, own, ys, langs)]
        tables.append(hashed[1:])
        first += len(hashed) - 1
    hashed, place = np.unique(np.concatenate(tables), axis=0, return_inverse=True)  # words with the same buckets are one
    none = int(place.ravel()[0])
    number_of = np.where(place.ravel() == none, 0, place.ravel() + 1).astype(np.int32)
    hashed = np.concatenate([np.zeros((1, PARTS), np.int32), hashed])
    found = sorted(((i, number_of[d], x, l) for i, d, x, l in found), key=lambda r: (r[0], r[3] or "", r[1].tobytes()))
    return [r[1] for r in found], hashed, np.array([r[2] for r in found], np.int64), [r[3] for r in found]


def _scored(batches: Iterator[pa.RecordBatch], model: TextCnn, text: int, lang: int | None):
    """Batches again, with the score of each row, and whether the threshold of its language flags it."""
    scorer = Scorer(model)
    for b in text_batches(batches, text, 1_000_000):
        s = scorer.scores(b.column(text).to_pylist())
        langs = b.column(lang).to_pylist() if lang is not None else [""] * len(b)
        cut = np.array([model.by_lang.get(x or "", THRESHOLD) for x in langs])
        yield b, s, (s >= cut) & model.trained


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id_col``, held_out, score, predicted, flagged for each whole text.

    predicted is score >= 0.3; flagged compares with the threshold of the row's
    language (0.3 for a language without labels, or null). A null text is empty
    and is scored like one; a very long one goes through the filters in blocks.
    Labels may lack rows, repeat or be null; of several for one id the greatest
    counts. A null id is scored, too. Repeated rows give repeated rows with equal
    scores, and so do equal texts. Without any usable label all scores are those of
    the untrained model, and nothing is flagged. Columns other than the id, the text
    and the language are not read, whatever their names. An empty table gives an
    empty one.
    """
    model = train(*training_rows(docs, labels, id_col, text_col, label_col, lang_col, train_rows))
    cast = docs.sparkSession.sparkContext.broadcast(model)  # about 6 MB, bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s, flagged in _scored(batches, cast.value, 1, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(flagged)], names=["id", "held_out", "score", "predicted", "flagged"])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = docs[lang_col] if lang_col in docs.columns else F.lit("")
    narrow = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"), lang.alias("lang"), held_out(id_col).alias("held_out"))
    return narrow.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, flagged boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns.

    Each row is judged by its own text where it is read, so nothing is joined:
    rows that repeat an id, or have none, stand or fall alone. Everything else is
    as in score_toxicity.
    """
    model = train(*training_rows(docs, labels, id_col, text_col, label_col, lang_col, train_rows))
    cast = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, flagged in _scored(batches, cast.value, text, lang):
            yield b.filter(pa.array(~flagged))

    return docs.mapInArrow(run, docs.schema)
