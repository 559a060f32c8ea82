"""SentencePiece BPE encoding and decoding with numpy.

Texts are cut before each space, and the words not met lately are encoded
together: their symbols lie in one flat array. In each round every word finds
the least rank of its adjacent pairs (a segmented minimum), merges all places of
that rank at once, from the left, and the array is compacted; words without a
known pair leave. Where a merge would make a pair of the same or a better rank
beside it, the word merges its leftmost place only, as a queue would.

Runs of spaces are pieces of their own with the worst rank, so they are cut
after everything else, from the left, by a small table of lengths.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import NONE, loaded
from .common import text_batches, text_of
from .tokenizer_file import PieceCache

#: The character that stands for a space in pieces.
SPACE = "▁"
#: Longer words are encoded with their batch and not remembered.
LONG_WORD = 200
#: The kinds of pieces, as the file format numbers them: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

codecs.register_error("marginalia_each_byte", lambda e: ("�", e.start + 1))


class PieceFile:
    """Reads a model: BPE with byte fallback and the identity as its normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trained, normal = model.trainer_spec, model.normalizer_spec
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = np.array([p.type for p in model.pieces])
        plain = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        runs = {len(t): i for t, i, _ in plain if set(t) == {SPACE}}
        lowest = min(s for t, _, s in plain if set(t) != {SPACE})
        known = (
            trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
            and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
            and set(self.kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE} and 1 in runs
            and not any(SPACE in t[1:] for t, _, _ in plain if set(t) != {SPACE})
            and len({s for t, _, s in plain if len(t) > 1 and set(t) == {SPACE}}) <= 1 and all(s < lowest for t, _, s in plain if len(t) > 1 and set(t) == {SPACE})
        )
        if not known:
            raise ValueError(f"{path}: this kind of piece model is not known")
        self.runs, self.space = runs, runs[1]
        self.vocab = {t: i for t, i, _ in plain}
        self.score = {t: s for t, _, s in plain}
        self.bytes = [next(i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE and p == f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end, self.unknown = trained.bos_id, trained.eos_id, trained.unk_id
        self.unknown_surface = trained.unk_surface


class NumpyPieces:
    def __init__(self, path: str):
        self.file = f = PieceFile(path)
        words = [t for t in f.vocab if set(t) != {SPACE}]
        # characters that only stand inside pieces get numbers of their own; all others never merge
        self.char_ids = {c: f.vocab.get(c, len(f.pieces) + k) for k, c in enumerate(sorted({c for t in words for c in t} | {SPACE}))}
        symbols = f.vocab | self.char_ids
        by_score = {s: k for k, s in enumerate(sorted({f.score[t] for t in words if len(t) > 1}, reverse=True))}
        rows = [(symbols[t[:k]], symbols[t[k:]], by_score[f.score[t]], f.vocab[t]) for t in words for k in range(1, len(t)) if t[:k] in symbols and t[k:] in symbols]
        left, right, rank, made = np.array(rows, np.int64).reshape(-1, 4).T
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], rank[order].astype(np.int32), made[order]
        points = sorted(self.char_ids)
        self.points, self.point_ids = np.array([ord(c) for c in points], np.int64), np.array([self.char_ids[c] for c in points], np.int64)
        #: pairs of characters that are neighbours in some piece: between any others a word can be cut
        self.beside = np.array(sorted({ord(a) << 32 | ord(b) for t in words for a, b in zip(t, t[1:])}), np.int64)
        self.unmatched = len(f.pieces) + len(self.char_ids)
        self.space_bytes = np.uint32(f.space).tobytes()
        self.begin, self.end = np.uint32(f.begin).tobytes(), np.uint32(f.end).tobytes()
        self.run_bytes: dict[int, bytes] = {}
        self.cache = PieceCache(None, self._encode_words)

    @staticmethod
    def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(table, keys)
        i[i == len(table)] = 0
        return i, table[i] == keys

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, hit = self._found(self.keys, a << 32 | b)
        return np.where(hit, self.ranks[i], NONE), self.made[i]

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words after all merges, in order, and the word of each. ``word`` must not fall."""
        done_sym, done_word = [], []
        rank, new = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
        fresh = np.arange(len(sym))
        while len(sym):
            rank[fresh] = NONE
            fresh = fresh[fresh < len(sym) - 1]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh], new[fresh] = self._rank(sym[fresh], sym[fresh + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            live = best != NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, new, best = sym[live], word[live], rank[live], new[live], best[live]
                if not len(sym):
                    break
            i = np.flatnonzero(rank == best)
            run = np.r_[True, np.diff(i) > 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))
            i = i[(np.arange(len(i)) - first) % 2 == 0]  # of overlapping places every other one, from the left
            i = self._in_order(sym, word, new, rank, i)
            sym[i] = new[i]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            at = np.cumsum(keep)[i] - 1
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            changed = np.zeros(len(sym) + 1, bool)
            changed[at] = changed[at - 1] = True  # at -1 the spare place is marked
            fresh = np.flatnonzero(changed[:-1])
        if not done_sym:
            return sym, word
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _in_order(self, sym: np.ndarray, word: np.ndarray, new: np.ndarray, rank: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The places ``i`` that can be merged at once: all of a word's, or its first one if a merge makes a pair that comes before the others."""
        w = word[i]
        several = np.zeros(len(i), bool)
        several[1:] = w[1:] == w[:-1]
        several[:-1] |= several[1:]
        if not several.any():
            return i
        j = i[several]
        last = len(sym) - 1
        before, after = np.maximum(j - 1, 0), np.minimum(j + 2, last)
        left = np.where((j > 0) & (word[before] == word[j]), self._rank(sym[before], new[j])[0], NONE)
        right = np.where((j + 2 <= last) & (word[after] == word[j]), self._rank(new[j], sym[after])[0], NONE)
        unsafe = np.unique(word[j[np.minimum(left, right) <= rank[j]]])
        if not len(unsafe):
            return i
        first = np.r_[True, w[1:] != w[:-1]]
        return i[first | ~self._found(unsafe, w)[1]]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with the space before it."""
        texts = [SPACE + w for w in words]
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        if not len(flat):
            return []
        starts = np.zeros(len(flat), bool)
        starts[np.cumsum(size)[:-1]] = True
        starts[1:] |= ~self._found(self.beside, flat[:-1] << 32 | flat[1:])[1]
        part = np.cumsum(starts)  # parts of words, between which nothing merges
        owner = np.repeat(np.arange(len(texts)), size)
        of_part = np.zeros(int(part[-1]) + 1, np.int64)
        of_part[part] = owner
        i, hit = self._found(self.points, flat)
        # what no piece holds keeps its code point behind all symbols, to become bytes
        sym, part = self.merge(np.where(hit, self.point_ids[i], self.unmatched + flat), part)
        spelt = sym >= len(self.file.pieces)
        if spelt.any():
            back = {n: c for c, n in self.char_ids.items()}
            made = [[self.file.bytes[b] for b in (back[s] if s < self.unmatched else chr(s - self.unmatched)).encode("utf-8", "surrogatepass")] for s in sym[spelt].tolist()]
            times = np.ones(len(sym), np.int64)
            times[spelt] = [len(m) for m in made]
            at = np.repeat(spelt, times)
            sym, part = np.repeat(sym, times), np.repeat(part, times)
            sym[at] = [x for m in made for x in m]
        ids, ends = sym.astype("<u4"), np.cumsum(np.bincount(of_part[part], minlength=len(texts))).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]

    def spaces(self, n: int) -> bytes:
        """The ids of ``n`` spaces: pairs that make a known run merge, the leftmost first."""
        if n not in self.run_bytes:
            held: list[int] = []
            for _ in range(n):
                held.append(1)
                while len(held) > 1 and held[-2] + held[-1] in self.file.runs:
                    held[-2:] = [held[-2] + held[-1]]
            out = np.array([self.file.runs[k] for k in held], "<u4").tobytes()
            if n > 1000:
                return out
            self.run_bytes[n] = out
        return self.run_bytes[n]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        need = {w for ws in split for w in ws}
        long = [w for w in need if len(w) > LONG_WORD]
        self.cache._prepare(need.difference(long))
        get = self.cache.ids.__getitem__
        if long:
            get = (self.cache.ids | dict(zip(long, self._encode_words(long)))).__getitem__
        return [b"".join([self.begin, *(self._spaced(ws, get) if "" in ws else map(get, ws)), self.end]) for ws in split]

    def _spaced(self, words: list[str], get) -> Iterator[bytes]:
        """Words among which empty ones stand for further spaces: a run takes in the space that the next word left alone."""
        waiting = 0
        for empty, ws in groupby(words, lambda w: w == ""):
            if empty:
                waiting = len(list(ws))
                continue
            first, *rest = ws
            ids = get(first)
            alone = waiting and ids.startswith(self.space_bytes)
            yield self.spaces(waiting + 1) + ids[4:] if alone else self.spaces(waiting) + ids
            yield from map(get, rest)
            waiting = 0
        yield self.spaces(waiting)


class PieceDecoder:
    def __init__(self, path: str):
        f = PieceFile(path)
        self.out = [p.replace(SPACE, " ").encode() for p in f.pieces]
        for b, i in enumerate(f.bytes):
            self.out[i] = bytes([b])
        self.out[f.unknown] = f.unknown_surface.encode()
        self.control = f.kinds == CONTROL
        for i in np.flatnonzero(self.control).tolist():
            self.out[i] = b""
        self.spaced = np.array([p.startswith(SPACE) for p in f.pieces])

    def decode(self, ids: np.ndarray) -> str:
        """Control ids are left out, as are ids outside the vocabulary; the space that encoding puts before a text is taken off; bytes that make no character become U+FFFD each. No character reaches across a control id."""
        ids = ids[(ids >= 0) & (ids < len(self.out))]
        marks = np.flatnonzero(self.control[ids])
        shown = np.delete(ids, marks)
        inner = marks[(marks > 0) & (marks < len(ids) - 1)]
        parts = np.split(ids, inner) if len(inner) else [ids]
        text = "".join(b"".join(map(self.out.__getitem__, p.tolist())).decode("utf-8", "marginalia_each_byte") for p in parts)
        return text[1 if len(shown) and self.spaced[shown[0]] else 0 :]


def piece_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, decoded: bool = False) -> DataFrame:
    """``id_col`` and ids of each whole text, begin and end included: array<int>, or if ``packed`` little-endian unsigned 32-bit integers.
    With ``decoded`` also what piece_decode makes of the ids, while they are at hand.

    A null text counts as empty, which has only begin and end. Very long texts and
    very long words are encoded whole, each in its batch. Strings like those of
    control pieces are ordinary text. Among equal merges the leftmost comes first.
    Repeated rows give repeated rows; a null id stays null; other columns, whatever
    their names, are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(NumpyPieces, path).encode
        for b in text_batches(batches, 1, 2_000_000):
            ids = encode(b.column(1).to_pylist())
            out = pa.array(ids, pa.binary())
            if not packed:
                offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            cols = [b.column(0), out]
            if decoded:
                decode = loaded(PieceDecoder, path).decode
                cols.append(pa.array((decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, ids {'binary' if packed else 'array<int>'}" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def piece_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids_col`` (array<int>) and the decoded text.

    Null ids count as none and give an empty text; null members and ids that the
    vocabulary lacks are skipped. Repeated rows give repeated rows, a null id stays
    null, other columns are not read, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = loaded(PieceDecoder, path).decode
        for b in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            texts = [decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, text string")
    return out.toDF(id_col, ids_col, text_col)
