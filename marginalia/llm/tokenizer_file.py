"""Reading a tokenizers JSON file, and cutting texts where no token can cross.

Two kinds of file are understood: byte-level BPE without a normaliser, and
lower-casing BPE that drops white space and marks word ends. In both, a text
can be encoded piece by piece if it is cut only where a run of white space
begins after something else; the pieces are then remembered, because most
pieces of a corpus repeat.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

_RUNS = regex.compile(r"\s*\S+|\s+")
_WORDS = regex.compile(r"\S+")
_BESIDE_SPACE = regex.compile(r" \s|\s ")
#: White space to str.split, but not to the tokenizers library.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: The pattern of a byte-level pre-tokenizer that uses its own pattern.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class TokenizerFile:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError(f"{path}: only plain BPE files are read")
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        kinds = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.by_word, pattern = False, BYTE_LEVEL
        elif kinds == {"NFC", "Replace", "Lowercase"} and pre["type"] == "Sequence" and pre["pretokenizers"][0]["type"] == "Split":
            self.by_word, pattern = True, pre["pretokenizers"][0]["pattern"]["Regex"]
        else:
            raise ValueError(f"{path}: this normaliser or pre-tokenizer is not known")
        self.pattern = regex.compile(pattern)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.library = library(path)
        self._byte_of = {ord(c): b for b, c in enumerate(byte_chars())}

    def parts(self, text: str):
        """(special token's id, None) and (None, ordinary text) in turn."""
        if self._special is None or not any(s in text for s in self.specials):
            if text:
                yield None, text
            return
        at = 0
        for m in self._special.finditer(text):
            if m.start() > at:
                yield None, text[at : m.start()]
            yield self.specials[m[0]], None
            at = m.end()
        if at < len(text):
            yield None, text[at:]

    def pieces(self, text: str) -> list[str]:
        """Pieces of an ordinary text that can be encoded on their own. Byte-level pieces keep their white space."""
        if self.by_word:
            return _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()
        if _BESIDE_SPACE.search(text) or _SEPARATORS.search(text):
            return _RUNS.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def words(self, piece: str) -> list[bytes]:
        """The words of a piece, within which merges happen. Beyond ASCII the library's own character tables decide."""
        if piece.isascii():
            if self.by_word:
                piece = piece.lower()
            if piece.isalpha() or not self.by_word and piece[:1] == " " and piece[1:].isalpha():
                return [piece.encode()]  # letters only: one word by any of the patterns
            return [w.encode() for w in self.pattern.findall(piece)]
        if self.library.normalizer is not None:
            piece = self.library.normalizer.normalize_str(piece)
        return [w.translate(self._byte_of).encode("latin-1") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]


def library(path: str):
    """The tokenizers library's reading of the file, without truncation or padding, on one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


class PieceCache:
    """Encodes texts by pieces; ``encode_pieces`` makes the ids of pieces not seen lately.

    Pieces are remembered in two generations of at most ``most`` each: a full one
    becomes the old one, from which what is asked for again is taken over.
    """

    def __init__(self, file: TokenizerFile, encode_pieces, most: int = 200_000):
        self.file, self.encode_pieces, self.most = file, encode_pieces, most
        self.ids: dict = {}
        self.old: dict = {}

    def _prepare(self, need: set[str]) -> None:
        ids, old = self.ids, self.old
        new = [p for p in need if p not in ids]
        if len(ids) + len(new) > self.most:
            self.old = old = ids
            self.ids = ids = {}
            new = list(need)
        if old:
            ids.update((p, old[p]) for p in new if p in old)
            new = [p for p in new if p not in ids]
        ids.update(zip(new, self.encode_pieces(new)))

    def split(self, texts: list[str]) -> list[list]:
        """For each text a list of special ids and lists of pieces, all of them now known."""
        out = [[x if x is not None else self.file.pieces(t) for x, t in self.file.parts(text)] for text in texts]
        need: set[str] = set()
        for parts in out:
            for p in parts:
                if not isinstance(p, int):
                    need.update(p)
        self._prepare(need)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = self.split(texts)
        get = self.ids.__getitem__
        return [b"".join([np.uint32(p).tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in parts]) for parts in split]

    def count(self, texts: list[str]) -> list[int]:
        """The numbers of ids, where ``encode_pieces`` gives numbers."""
        split = self.split(texts)
        get = self.ids.__getitem__
        return [sum(1 if isinstance(p, int) else sum(map(get, p)) for p in parts) for parts in split]


_AFTER_WORD = regex.compile(r"\S(?=\s)")


def segments(text: str, most: int = 1_000_000):
    """A long text in parts of about ``most`` characters, cut where white space begins. Nothing is lost."""
    at = 0
    while len(text) - at > most:
        m = _AFTER_WORD.search(text, at + most)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


class LibraryPieces(dict):
    """Piece to what ``made`` gives for its ids, remembered in two generations of at most ``most``."""

    def __init__(self, encode, made, most: int = 300_000):
        super().__init__()
        self.encode, self.made, self.most, self.old = encode, made, most, {}

    def __missing__(self, piece: str):
        if piece in self.old:
            out = self.old[piece]
        else:
            out = self.made(self.encode(piece))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


def library_encoder(path: str):
    """A function from an ordinary piece of text to its ids, by the compiled libraries.

    The rank-file library is several times faster on pieces and is used where the
    file's ids follow its merges, so that both libraries hold the same vocabulary.
    """
    file = TokenizerFile(path)
    chars = {c: b for b, c in enumerate(byte_chars())}
    ordered = not file.by_word and not file.suffix and all(file.vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(file.merges))
    if ordered and sorted(file.vocab[c] for c in chars) == list(range(256)):
        import tiktoken

        special = set(file.specials)
        ranks = {bytes(chars[c] for c in t): i for t, i in file.vocab.items() if t not in special}
        return file, tiktoken.Encoding("file", pat_str=file.pattern.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return file, lambda piece: file.library.encode(piece, add_special_tokens=False).ids
