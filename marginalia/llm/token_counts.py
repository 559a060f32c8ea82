"""Token counts: Arrow batches in, lengths out; ids never leave the batch.

Batches are dealt again by bytes, so that one of long texts is no larger than
one of short texts. Texts are cut where white space begins, where neither
pre-tokenizer pattern lets a token cross; the pieces of a batch that were not met
lately go to the library in one call, and only their lengths are remembered.
Piece models get whole texts in one call, long ones in segments cut at a single
space between letters or digits, where the file's pieces allow it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import text_batches, text_of
from .tokenizer_file import PieceCache, TokenizerFile, segments


_PLAIN = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")
#: Characters of a text that a piece model gets at once.
SEGMENT = 200_000


class ModelCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = any("\u2581" in m.id_to_piece(i).lstrip("\u2581") for i in range(m.get_piece_size()))
        self.cuts = not inner and m.encode("a b") == m.encode("a") + m.encode("b")

    def segments(self, text: str) -> list[str]:
        """The text without the single spaces it is cut at; each segment gets its space back from the model."""
        out, at = [], 0
        while self.cuts and len(text) - at > SEGMENT:
            m = _PLAIN.search(text, at + SEGMENT)
            if m is None:
                break
            out.append(text[at : m.end()])
            at = m.end() + 1
        return [*out, text[at:]]

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.segments(t) for t in texts]
        lengths = iter([len(x) for x in self.model.encode([p for ps in parts for p in ps], num_threads=1)])
        return [sum(next(lengths) for _ in ps) for ps in parts]


class FileCounter:
    def __init__(self, path: str):
        file = TokenizerFile(path)
        self.cache = PieceCache(file, lambda pieces: [len(e.ids) for e in file.library.encode_batch_fast(pieces, add_special_tokens=False)])

    def count(self, texts: list[str]) -> list[int]:
        parts = [list(segments(t)) for t in texts]
        lengths = iter(self.cache.count([p for ps in parts for p in ps]))
        return [sum(next(lengths) for _ in ps) for ps in parts]


_LOADED: dict[str, ModelCounter | FileCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit of each whole text.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows give repeated rows; a
    null id stays null; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = (ModelCounter if path.endswith(".model") else FileCounter)(path)
        counter = _LOADED[path]
        for b in text_batches(batches, 1):
            n = np.array(counter.count(b.column(1).to_pylist()), np.int64)
            size = pa.compute.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
