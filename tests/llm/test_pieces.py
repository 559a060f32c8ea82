import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.piece_bpe import NumpyPieces, PieceDecoder, PieceFile, piece_decode, piece_encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL, OWN, DECODER = sentencepiece.SentencePieceProcessor(model_file=PATH), NumpyPieces(PATH), PieceDecoder(PATH)


def same(texts):
    for text, a, b in zip(texts, OWN.encode(texts), MODEL.encode(texts, add_bos=True, add_eos=True)):
        ids = np.frombuffer(a, "<u4").astype(np.int64)
        assert ids.tolist() == b, repr(text)
        assert DECODER.decode(ids) == MODEL.decode(b), repr(text)


def test_numpy_equals_the_library():
    rng = random.Random(1)
    fixed = ["", " ", "  ", "a", "▁a", " ▁ a", "\x00a", "\t\n", "a" * 900, "ab" * 300, " " * 1000, "  " * 37 + "x", " " * 13 + "日本語" + " " * 40, "<s></s><unk><0x0A>", "é日𝄞🎉👩‍👩‍👧", "aaaaab aaaaaaaab", "==== ---- ===="]
    mixed = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00), 32, 32, 10, 0x3A3, 0x2581])) for _ in range(rng.randrange(80))) for _ in range(3000)]
    tied = ["".join(rng.choice(["a", "e", "th", "in", "s", " ", "-", "=", "_", "0", "1", "    ", "\n", "he", "er"]) for _ in range(rng.randrange(120))) for _ in range(3000)]
    long = ["".join(rng.choice("abcdefgh") for _ in range(50_000)), "x" * 50_000, "日本" * 20_000 + " end"]
    same(fixed + mixed + tied + long)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=100))
def test_any_text(text):
    same([text])


def test_every_number_of_spaces():
    same([a + " " * n + b for n in range(120) for a, b in (("", ""), ("", "x"), ("x", ""), ("x", "的"), ("x", "\n"))])


def test_words_forget_nothing(monkeypatch):
    """With a small memory, words leave it between batches and within one."""
    from marginalia.llm import piece_bpe

    monkeypatch.setattr(piece_bpe, "LONG_WORD", 6)
    own = NumpyPieces(PATH)
    own.cache.most = 20
    rng = random.Random(5)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("aeinst") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == MODEL.encode(texts, add_bos=True, add_eos=True)


def test_decoding_any_ids():
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 259, 0, 1, rng.randrange(3, 259)]) for _ in range(rng.randrange(12))]
        assert DECODER.decode(np.array(ids, np.int64)) == MODEL.decode(ids), ids


def test_frames(docs, none, texts):
    want = sorted((str(i), MODEL.encode(t or "", add_bos=True, add_eos=True)) for i, t in texts)
    coded = piece_encode(docs, PATH)
    got = piece_decode(coded, PATH).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert all(r["text"] == MODEL.decode(r["ids"]) for r in got)
    packed = piece_encode(docs, PATH, packed=True, decoded=True).collect()
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in packed) == want
    assert piece_decode(piece_encode(none, PATH), PATH).count() == 0


def test_decoding_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "t"), (2, [], "t"), (3, [264, None, 99999999, -4], "t"), (None, [1, 2], "t"), (3, [264], "t")], "doc_id long, ids array<int>, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in piece_decode(rows, PATH).collect()) == [("1", ""), ("2", ""), ("3", "a"), ("3", "a"), ("None", "")]


def test_other_kinds_of_model_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        PieceFile(str(tmp_path / "m.model"))
