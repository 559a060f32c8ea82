"""BPE encoding and decoding with numpy.

The symbols of many distinct words lie in one flat array. In each round every
adjacent pair is looked up by binary search over the sorted pair keys, each word
merges all places of its lowest-ranked pair, and words without a known pair
leave. So a batch takes as many rounds as its longest word has merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_batches, text_of
from .tokenizer_file import PieceCache, TokenizerFile, byte_chars

NONE = np.int32(2**31 - 1)


class NumpyBpe:
    def __init__(self, path: str):
        self.file = f = TokenizerFile(path)
        chars = byte_chars()
        self.inner = np.array([f.vocab[c] for c in chars], np.int64)
        self.last = np.array([f.vocab[c + f.suffix] for c in chars], np.int64)
        left = np.array([f.vocab[a] for a, _ in f.merges], np.int64)
        right = np.array([f.vocab[b] for _, b in f.merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([f.vocab[a + b] for a, b in f.merges], np.int64)[order]
        self.cache = PieceCache(f, self._encode_pieces)

    def _look_up(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray, rank: np.ndarray, new: np.ndarray) -> None:
        """Rank and product of the pairs that begin at ``at``."""
        rank[at] = NONE
        at = at[at < len(sym) - 1]
        at = at[word[at] == word[at + 1]]
        k = sym[at] << 32 | sym[at + 1]
        i = np.searchsorted(self.keys, k)
        i[i == len(self.keys)] = 0
        hit = self.keys[i] == k
        rank[at[hit]] = self.ranks[i[hit]]
        new[at[hit]] = self.made[i[hit]]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the number of each word's."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[flat], np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size)[size > 0] - 1
        sym[ends] = self.last[flat[ends]]
        done_sym, done_word = [], []
        rank, new = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
        self._look_up(sym, word, np.arange(len(sym)), rank, new)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            live = best != NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, new, best = sym[live], word[live], rank[live], new[live], best[live]
                continue
            pick = rank == best
            # of overlapping places (a run of one symbol) every other one counts, from the left
            i = np.flatnonzero(pick)
            run = np.r_[True, np.diff(i) > 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))
            i = i[(np.arange(len(i)) - first) % 2 == 0]
            sym[i] = new[i]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            at = np.cumsum(keep)[i] - 1
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            changed = np.zeros(len(sym) + 1, bool)
            changed[at] = changed[at - 1] = True  # at -1 the spare place is marked
            self._look_up(sym, word, np.flatnonzero(changed[:-1]), rank, new)
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        of = [self.file.words(p) for p in pieces]
        distinct = list(dict.fromkeys(w for ws in of for w in ws))
        ids, counts = self.merge(distinct)
        ids, ends = ids.astype("<u4"), np.cumsum(counts)
        bytes_of = dict(zip(distinct, (ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist()))))
        return [bytes_of[ws[0]] if len(ws) == 1 else b"".join([bytes_of[w] for w in ws]) for ws in of]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.encode(texts)


class BpeDecoder:
    def __init__(self, path: str):
        f = TokenizerFile(path)
        tokens = {i: t for t, i in f.vocab.items()} | {i: t for t, i in f.specials.items()}
        self.by_byte = f.byte_decoder
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        as_bytes = (lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()) if self.by_byte else str.encode
        self.out = [as_bytes(tokens.get(i, "")) for i in range(max(tokens) + 1)]

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the file, tokens are joined by spaces. Ids outside the vocabulary are skipped."""
        if len(ids) and (int(ids.max()) >= len(self.out) or int(ids.min()) < 0):
            ids = ids[(ids >= 0) & (ids < len(self.out))]
        return (b"" if self.by_byte else b" ").join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict = {}


def loaded(kind: type, path: str):
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, decoded: bool = False) -> DataFrame:
    """``id_col`` and ids of each whole text: array<int>, or if ``packed`` little-endian unsigned 32-bit integers.
    With ``decoded`` also what bpe_decode makes of the ids, while they are at hand.

    Special tokens' strings inside a text become their ids; none are added. A
    null or empty text has no ids. Repeated rows give repeated rows; a null id
    stays null; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(NumpyBpe, path)
        for b in text_batches(batches, 1, 2_000_000):
            ids = bpe.encode(b.column(1).to_pylist())
            out = pa.array(ids, pa.binary())
            if not packed:
                offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            cols = [b.column(0), out]
            if decoded:
                decode = loaded(BpeDecoder, path).decode
                cols.append(pa.array((decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, ids {'binary' if packed else 'array<int>'}" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids_col`` (either form) and the decoded text. Null ids count as none; ids that the vocabulary lacks are skipped."""
    form = encoded.schema[ids_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = loaded(BpeDecoder, path).decode
        for b in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            if form == "binary":
                arrays = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in b.column(1).to_pylist()]
            else:
                lists = b.column(1)
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                arrays = np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends[:-1]) if len(b) else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(decode, arrays), pa.string())], names=["id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, ids {form}, text string")
    return out.toDF(id_col, ids_col, text_col)
