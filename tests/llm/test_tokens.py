import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm.bpe import BpeDecoder, NumpyBpe, bpe_decode, bpe_encode
from marginalia.llm.packing import pack_documents, pack_lengths, pieces_of
from marginalia.llm.token_counts import token_counts
from marginalia.llm.tokenizer_file import segments

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def libs():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_numpy_equals_the_library(libs, path):
    rng = random.Random(2)
    texts = ["", " ", "  a  b", "a\n\n  b c \t d  ", "ΑΣ ΣΑΣ. İstanbul", "x<|endoftext|>y <|startoftext|>", "a" * 900, "ab" * 300, "don't we'll I'M", "\x1c a\x1db \x85\xa0 c", "é ́ a", "日本語 ١٢٣ ½", "😀😀"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00), 32, 32, 10, 0x3A3])) for _ in range(rng.randrange(60))) for _ in range(500)]
    own, lib = NumpyBpe(path).encode(texts), libs[path].encode_batch(texts, add_special_tokens=False)
    decoder = BpeDecoder(path)
    for text, a, b in zip(texts, own, lib):
        ids = np.frombuffer(a, "<u4")
        assert ids.tolist() == b.ids, repr(text)
        assert decoder.decode(ids.astype(np.int64)) == libs[path].decode(b.ids, skip_special_tokens=False), repr(text)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs", "Cn"]), max_size=200))
def test_byte_level_round_trip(text):
    bpe = test_byte_level_round_trip.__dict__.setdefault("bpe", NumpyBpe(BYTE))
    decoder = test_byte_level_round_trip.__dict__.setdefault("decoder", BpeDecoder(BYTE))
    assert decoder.decode(np.frombuffer(bpe.encode([text])[0], "<u4").astype(np.int64)) == text


def test_encode_and_decode_frames(docs, none, texts, libs):
    coded = bpe_encode(docs, WORD)
    got = bpe_decode(coded, WORD).collect()
    assert len(got) == len(texts)
    want = sorted((str(i), libs[WORD].encode(t or "", add_special_tokens=False).ids) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert all(r["text"] == libs[WORD].decode(r["ids"], skip_special_tokens=False) for r in got)
    packed = bpe_encode(docs, WORD, packed=True, decoded=True).collect()
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in packed) == want
    assert bpe_decode(bpe_encode(none, WORD), WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts(docs, none, texts, libs, path):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, path).collect())
    want = []
    for i, t in texts:
        n = len(libs[path].encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts(none, path).count() == 0


def test_counts_by_sentencepiece(docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts(docs, path).collect())
    assert got == sorted((str(i), len(model.encode(t or ""))) for i, t in texts)


def test_segments_lose_nothing():
    text = "ab  c\n d" * 500
    parts = list(segments(text, 50))
    assert "".join(parts) == text and len(parts) > 10
    assert all(p[0].isspace() and not q[-1].isspace() for p, q in zip(parts[1:], parts))


def test_pieces():
    assert pieces_of(0, 10) == [] and pieces_of(10, 10) == [(0, 10)]
    assert pieces_of(25, 10) == [(0, 5), (5, 10), (15, 10)]


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_tight_and_whole(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, 1 + rng.exponential([100, 500, 900, 1500][seed], 3000).astype(int))
    bins, offsets = pack_lengths(lengths, 2048)
    own = defaultdict(list)
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist()):
        own[b].append((o, n))
    for rows in own.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 2048
    bound = max(-(-lengths.sum() // 2048), (lengths > 1024).sum())
    assert len(own) <= 1.02 * bound + 2
    with pytest.raises(ValueError):
        pack_lengths(np.array([0]), 10)


def test_a_smallest_document_gives_way_to_two_that_fit_better():
    bins, _ = pack_lengths(np.array([6, 3, 2, 2]), 10)  # 6 + 3 leaves 1; 6 + 2 + 2 leaves none
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_pack_documents(docs, none, texts, libs):
    got = pack_documents(docs, BYTE, 256, tokens=True).collect()
    ids = defaultdict(list)
    for r in got:
        ids[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) <= 256 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for i, t in texts:
        want = libs[BYTE].encode(t or "", add_special_tokens=False).ids + [0]
        if i not in (100, 110, None):  # those ids stand on several rows
            assert sum((r["ids"] for r in sorted(ids[i], key=lambda r: r["piece"])), []) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in seqs.values():
        assert [o for o, _ in sorted(rows)] == np.cumsum([0, *[n for _, n in sorted(rows)][:-1]]).tolist()
        assert sum(n for _, n in rows) <= 256
    total = sum(r["length"] for r in got)
    assert len(seqs) <= 1.03 * total / 256 + 2
    assert pack_documents(none, BYTE).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_code_point_is_classed_as_the_library_does(libs, path):
    """Each code point of the planes in use, and one in 97 of the others, between a letter, a digit and a sign."""
    points = [c for c in [*range(0x30000), *range(0x30000, 0x110000, 97), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}1{c}!" for c in map(chr, points[k : k + 50])) for k in range(0, len(points), 50)]
    bpe = NumpyBpe(path)
    for at in range(0, len(texts), 800):
        for text, a, b in zip(texts[at : at + 800], bpe.encode(texts[at : at + 800]), libs[path].encode_batch_fast(texts[at : at + 800], add_special_tokens=False)):
            assert np.frombuffer(a, "<u4").tolist() == b.ids, repr(text)


def test_segments_of_piece_models_change_no_count(monkeypatch):
    import sentencepiece

    from marginalia.llm import token_counts as module

    monkeypatch.setattr(module, "SEGMENT", 20)
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, model = module.ModelCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b1", " ", "  ", "\n", "the", "é", ".", "\u0301", "ж", " x "]) for _ in range(rng.randrange(200))) for _ in range(400)]
    assert counter.cuts and max(len(counter.segments(t)) for t in texts) > 3
    assert counter.count(texts) == [len(model.encode(t)) for t in texts]
