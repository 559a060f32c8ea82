import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import lm_score, media, toxicity
from marginalia.llm.url_filter import GlobAutomaton, judge_urls


def test_tree_weighting_equals_the_recursion():
    """Against a literal recursion over one small text."""
    text = b"abracadabra abracadabra"
    codes, _ = lm_score.strings([text.split()])
    codes, counts = lm_score._summed(codes, np.ones(len(codes), np.int64))
    nodes = lm_score.build(codes, counts, top=0)

    def weighted(depth, context, prefix):
        n0 = n1 = 0
        below = set()
        for code, c in zip(codes.tolist(), counts.tolist()):
            x = code & 255
            bits = [(x >> (7 - j)) & 1 for j in range(8)]
            for j in range(8):
                if (1 << j | x >> (8 - j)) == prefix and (code >> 8) & ((1 << 8 * depth) - 1) == context:
                    n1, n0 = n1 + c * bits[j], n0 + c * (1 - bits[j])
                    below.add((code >> 8) & ((1 << 8 * (depth + 1)) - 1))
        own = math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)
        if depth == lm_score.DEPTH:
            return own
        return np.logaddexp(own, sum(weighted(depth + 1, b, prefix) for b in below)) - math.log(2)

    keys, _, _, logs, weight = nodes[0]
    for k, v in list(zip(keys.tolist(), logs))[:6]:
        assert v == pytest.approx(weighted(0, 0, k))
    assert ((weight >= 0) & (weight <= 1)).all()


@pytest.mark.parametrize("text", [b"abra", b"cadab", b"zzz qqq", b"abrz", b"\xc3\xa9a"])
def test_scores_equal_the_ratio_of_weighted_probabilities(text):
    """For each bit of a text: the tree's probability with that bit added over that without it; contexts seen and unseen."""
    codes, _ = lm_score.strings([b"abracadabra abracadabra".split()])
    codes, counts = lm_score._summed(codes, np.ones(len(codes), np.int64))
    nodes = lm_score.build(codes, counts, top=0)
    seen = []  # (depth-5 context, bits before, bit, count)
    for code, c in zip(codes.tolist(), counts.tolist()):
        seen += [(code >> 8, 1 << j | (code & 255) >> (8 - j), (code >> (7 - j)) & 1, c) for j in range(8)]

    def log_weighted(rows, depth):
        n1 = sum(c for _, b, c in rows if b)
        n0 = sum(c for _, b, c in rows if not b)
        own = math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)
        if depth == lm_score.DEPTH or not rows:
            return own
        parts = {}
        for x, b, c in rows:
            parts.setdefault((x >> 8 * depth) & 255, []).append((x, b, c))
        return np.logaddexp(own, sum(log_weighted(p, depth + 1) for p in parts.values())) - math.log(2)

    asked, _ = lm_score.strings([text.split()])
    for code, got in zip(asked.tolist(), lm_score.log10_of(asked, nodes)):
        want = 0.0
        for j in range(8):
            prefix, bit = 1 << j | (code & 255) >> (8 - j), (code >> (7 - j)) & 1
            rows = [(x, b, c) for x, p, b, c in seen if p == prefix]
            want += log_weighted([*rows, (code >> 8, bit, 1)], 0) - log_weighted(rows, 0)
        assert got == pytest.approx(want / math.log(10))


def test_byte_probabilities_add_up_to_one():
    codes, _ = lm_score.strings([b"the cat sat on the mat".split()])
    u, c = lm_score._summed(codes, np.ones(len(codes), np.int64))
    nodes = lm_score.build(u, c, top=0)
    for context in (codes[3] >> np.uint64(8), np.uint64(0x7A7A7A7A7A)):
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** lm_score.log10_of(every, nodes)).sum() == pytest.approx(1)


def test_base_scores_equal_brute_force(docs, none, texts):
    got = lm_score.lm_scores(docs).collect()
    assert len(got) == len(texts)
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in texts]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_score.lm_scores(none).count() == 0


def test_slices_change_nothing(docs, monkeypatch):
    whole = sorted((str(r["doc_id"]), round(r["score"], 4)) for r in lm_score.lm_scores(docs).collect())
    monkeypatch.setattr(lm_score, "SLICE", 6000)
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in lm_score.lm_scores(docs).collect()) == whole


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        w = ["".join(rng.choice(["th", "er", "in", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "idiotic", "vequ" + rng.choice("abcdefgh") * 2]))
        rows.append((i, " ".join(w), "en" if i % 3 else "fr"))
        labels.append((i, int(bad)))
    rows += [(5000, None, None), (5001, "", "en"), (None, "there in", "en"), (5002, "th er " * 20000, "en")]
    labels += [(0, 1), (7, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    rows = [r for r in got if r["held_out"] and r["doc_id"] < 1200]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows)
    assert right / len(rows) > 0.93
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_toxicity_without_labels_or_rows(labelled):
    docs, labels = labelled
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs.limit(5), labels.limit(0)).count() == 5


def test_globs():
    import fnmatch

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a" * 70 + "*", "*" + "b" * 3]
    globs = ["*".join(x for x in [g]) for g in globs]
    hit = GlobAutomaton([g.encode() for g in globs], stop=0).match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert hit[i, j] == fnmatch.fnmatchcase(t, g), (t, g)


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block")]
    urls = [None, "", "no scheme", "http://", "https://Example.ORG/es/x?q", "http://a.example.org/en/12#x", "http://badexample.org/es/", "http://org", "http://x.org/.example.org/es/", "HTTP://ORG/", "a://b://c.org/d", "http://ü.org/É", "http://example.org:80/es/"]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [r["rule"] for r in got] == [None, None, None, None, "example.org/es/", "example.org/en/1", "org/", None, "org/", "org/", None, "org/", None]
    assert [r["verdict"] for r in got][4:7] == ["block", "block", "allow"]
    assert got[4]["host"] == "example.org" and got[4]["path"] == "/es/x" and got[10]["host"] == "b:"
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert judge_urls(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), []).first()["verdict"] == "allow"


def test_images(spark):
    rng = np.random.default_rng(9)
    images = [media.render(rng.normal(size=64).tolist()) for _ in range(12)]
    rows = [(i, media.encode_pgm(im) if i % 2 else media.encode_png(im)) for i, im in enumerate(images)]
    rows += [(100 + i, media.encode_pgm(media.edited(im, i))) for i, im in enumerate(images[:6])]
    rows += [(200, rows[3][1]), (3, rows[3][1]), (300, None), (301, b""), (302, b"junk"), (303, b"junk"), (304, None), (None, rows[4][1])]
    got = media.image_copies(spark.createDataFrame(rows, "media_id long, data binary")).collect()
    assert len(got) == len(rows)
    of = {r["media_id"]: r["component_id"] for r in got}
    assert all(of[100 + i] == i for i in range(6)) and of[200] == 3 and all(of[i] == i for i in range(12))
    assert of[300] == 300 and of[301] == 301 and of[304] == 304 and of[303] == 302 and of[None] is None
    assert np.array_equal(media.decode(media.encode_png(images[0])), images[0])
    assert media.image_copies(spark.createDataFrame([], "media_id long, data binary")).count() == 0


def test_quarter_turn_is_found():
    a = media.render(np.random.default_rng(1).normal(size=64).tolist()).astype(np.float32)
    (p, d), (q, e) = media.describe(a), media.describe(np.rot90(a).copy())
    apart = np.unpackbits(d[:, None] ^ e[None], axis=2).sum(axis=2)
    i, j = np.nonzero(apart <= 12)
    assert len(i) >= 8 and media.agreeing(p[i], q[j]) >= media.AGREE


def test_images_that_the_first_round_misses_are_linked(spark, monkeypatch):
    """The first round is asked for more shared chunks than there are, so that only the groups can link."""
    monkeypatch.setattr(media, "MEET", 10**6)
    rng = np.random.default_rng(21)
    images = [media.render(rng.normal(size=64).tolist()) for _ in range(4)]
    rows = [(i, media.encode_pgm(im)) for i, im in enumerate(images)] + [(10 + 3 * i + k, media.encode_pgm(media.edited(im, k))) for i, im in enumerate(images[:3]) for k in range(3)]
    of = {r["media_id"]: r["component_id"] for r in media.image_copies(spark.createDataFrame(rows, "media_id long, data binary")).collect()}
    assert of == {i: i if i < 10 else (i - 10) // 3 for i, _ in rows}


@pytest.mark.parametrize("blocks", [False, True])
def test_images_equal_brute_force_over_all_pairs(spark, monkeypatch, blocks):
    """Edited, turned, strongly cropped and chained copies, one flat image of many sizes, a logo on many images; repeated ids, clashing columns."""
    if blocks:
        monkeypatch.setattr(media, "BLOCK_BYTES", 6000)
        monkeypatch.setattr(media, "MEET", 60)
    rng = np.random.default_rng(33)
    draw = lambda side=96: media.render(rng.normal(size=64).tolist(), side, int(rng.integers(1 << 30)))
    base, logo = [draw() for _ in range(10)], draw()[20:64, 20:64]
    large = draw(240)
    images = [*base, *(media.edited(im, k) for k, im in enumerate(base)), large, large[60:190, 80:200], np.rot90(base[0]).copy(), base[1][4:92, 6:90][:70]]
    for _ in range(8):
        im = draw()
        im[26:70, 30:74] = logo
        images.append(im)
    images += [np.full((n, n), 90, np.uint8) for n in (20, 60, 90)]
    seen = [media.describe(im.astype(np.float32)) for im in images]
    up = list(range(len(images)))
    for _ in range(4):
        for x in range(len(images)):
            for y in range(x):
                p, d, q, e = *seen[x], *seen[y]
                if up[x] != up[y] and media.copies(p, media._words(d.tobytes()), q, media._words(e.tobytes())):
                    up = [min(up[x], up[y]) if u in (up[x], up[y]) else u for u in up]
    rows = [(i, media.encode_pgm(im), i, "h") for i, im in enumerate(images)]
    rows += [(5, media.encode_pgm(base[7]), 1000, "h"), (None, media.encode_pgm(base[7]), 1001, "h")]
    got = media.image_copies(spark.createDataFrame(rows, "media_id long, data binary, node long, h string")).collect()
    least = {u: min(x for x in range(len(images)) if up[x] == u) for u in up}
    least[up[7]] = min(least[up[7]], 5)  # the row that repeats id 5 shows image 7
    want = [(str(i), str(least[up[i]])) for i in range(len(images))] + [("5", "5"), ("None", "None")]
    assert sorted((str(r["media_id"]), str(r["component_id"])) for r in got) == sorted(want)
    assert up[21] == up[20] and all(up[10 + k] == up[k] for k in range(10))


def test_png_filters_are_undone():
    import struct
    import zlib

    image = np.random.default_rng(2).integers(0, 256, (5, 7, 3)).astype(np.int64)
    raw = b""
    for y, f in enumerate([0, 1, 2, 3, 4]):
        row, up = image[y].ravel(), image[y - 1].ravel() if y else np.zeros(21, np.int64)
        left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, up[:-3]]
        p = left + up - corner
        far = np.abs(np.stack([p - left, p - up, p - corner]))
        guess = [np.zeros(21, np.int64), left, up, (left + up) // 2, np.choose(far.argmin(axis=0), [left, up, corner])][f]
        raw += bytes([f]) + ((row - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.allclose(media.decode(data), image.mean(axis=2))


def test_toxicity_learns_from_words_late_in_long_texts():
    rng = random.Random(4)
    texts, y = [], []
    for i in range(64):
        w = [rng.choice(["there", "inner", "onset", "reread"]) for _ in range(4100)]
        texts.append(" ".join(w + (["scumbag"] if i % 2 else ["neighbour"])))
        y.append(i % 2)
    model = toxicity.train(*toxicity.numbered(texts), np.array(y), ["en"] * 64)
    score = toxicity.Scorer(model).scores(["there inner scumbag", "there inner neighbour"])
    assert score[0] >= 0.3 > score[1]


def test_maxima_in_blocks_equal_those_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    model = toxicity.TextCnn(np.zeros(1, np.int32), 50)
    seq, starts = toxicity._padded([rng.integers(1, 50, n) for n in (0, 1, 300, 7, 45, 2)])
    h, _ = model.pool(model.emb[seq], starts)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 10)
    blocked, place = model.maxima(model.emb, seq, starts)
    assert np.allclose(h, blocked, atol=1e-5)
    assert (place >= starts[:, None]).all() and (place < np.append(starts[1:], len(seq))[:, None]).all()


def test_nothing_is_dropped_without_usable_labels(labelled):
    docs, labels = labelled
    some = docs.where("doc_id < 5 or doc_id is null")
    assert toxicity.drop_toxic(some, labels.limit(0)).count() == some.count() == 6


@pytest.mark.parametrize("n", [1, 7, 8, 9, 11, 199, 200, 201, 202, 203, 204])
def test_training_stands_any_number_of_rows(n):
    texts = [None if i % 7 == 0 else "" if i % 11 == 0 else f"word{i % 5} " + ("scumbag" if i % 2 else "neighbour") for i in range(n)]
    docs, hashed = toxicity.numbered(texts)
    model = toxicity.train(docs, hashed, np.arange(n) % 2, ["en", None][: 1 + n % 2] * n)
    assert np.isfinite(toxicity.Scorer(model).scores(["word1 scumbag", "", None])).all()
    assert len(toxicity.Scorer(model).scores([])) == 0


def test_contradicting_labels_count_as_the_greatest(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (3, "c", None), (5, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (3, None), (5, 1), (5, 0)], "doc_id long, toxic int")
    rows, hashed, y, lang = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", "lang", 6000)
    held = [i for i in (1, 3, 5) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert y.tolist() == [v for i, v in ((1, 1), (3, 0), (5, 1)) if i not in held]
    assert [len(r) for r in rows] == [n for i, n in ((1, 2), (3, 1), (5, 0)) if i not in held] and len(hashed) >= 1
    again = toxicity.training_rows(docs.repartition(3), labels.repartition(2), "doc_id", "text", "toxic", "lang", 6000)
    assert [sorted(map(tuple, hashed[r])) for r in rows] == [sorted(map(tuple, again[1][r])) for r in again[0]]


def test_toxic_rows_go_by_their_own_text(labelled):
    """Repeated and null ids, and columns whose names clash with the operator's own: each row goes as its text is flagged alone."""
    docs, labels = labelled
    spark = docs.sparkSession
    clean, bad = (next(r["text"] for r in docs.where(f"doc_id % 4 {c} 0 and length(text) > 300").orderBy("doc_id").take(40) if ("scumbag" in r["text"]) == (c == "=")) for c in ("<>", "="))
    texts = [bad, clean, bad, clean, bad, None, ""]
    ids = [7001, 7001, None, None, 7001, 7009, 7009]
    some = spark.createDataFrame([(i, t, "en", 0.5, k) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, text string, lang string, score double, flagged int")
    both = docs.selectExpr("doc_id", "text", "lang", "0.5D AS score", "-1 AS flagged").unionByName(some)
    alone = toxicity.score_toxicity(docs.unionByName(some.selectExpr("10000L + flagged AS doc_id", "text", "lang")), labels).where("doc_id >= 10000 and not flagged").collect()
    kept = toxicity.drop_toxic(both, labels)
    assert kept.columns == both.columns
    stay = sorted(r["flagged"] for r in kept.collect() if r["flagged"] >= 0)
    assert stay == sorted(r["doc_id"] - 10000 for r in alone) and {1, 3} <= set(stay) and not {0, 2, 4} & set(stay)


def test_cut_off_files_are_unreadable():
    """Every beginning of a valid file, and files with odd numbers in their heads, end in None and in no time."""
    image = np.random.default_rng(3).integers(0, 256, (9, 13))
    for data in (media.encode_pgm(image), b"P5 # note\n13 9 # more\n255\n" + image.astype(np.uint8).tobytes()):
        assert all(media.decode(data[:n]) is None for n in range(len(data))) and np.array_equal(media.decode(data), image)
    png = media.encode_png(image)
    for n in range(len(png)):
        got = media.decode(png[:n])
        assert got is None or np.array_equal(got, image)  # only the closing chunk may be missing
    for head in (b"P5", b"P5\n2 2", b"P5\n-1 2\n255\n", b"P5\n0 0\n255\n", b"P5\n2 2\n0\nabcd", b"P5\n2 2\n70000\nabcdabcd", b"P5 # no end", b"P5\n99999999 99999999\n255\nab"):
        assert media.decode(head) is None


def test_values_of_other_ranges():
    deep = np.array([[0, 1000], [32767, 65535]], ">u2")
    assert np.allclose(media.decode(b"P5\n2 2\n65535\n" + deep.tobytes()), deep.astype(float) * 255 / 65535)
    assert np.allclose(media.decode(b"P5\n2 2\n15\n" + bytes([0, 5, 15, 99])), [[0, 85], [255, 255]])


@pytest.mark.parametrize("n", [2, 5, 40, 700])
def test_nearest_corners_equal_all_against_all(n):
    rng = np.random.default_rng(n)
    for x, y in ((rng.random(n) * 900, rng.random(n) * 300), (np.floor(rng.random(n) * 9), np.floor(rng.random(n) * 9)), (np.zeros(n), rng.random(n) * 5000), (np.r_[rng.random(n - 1), 9000.0], rng.random(n))):
        k = min(6, n - 1)
        far = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
        np.fill_diagonal(far, np.inf)
        want = np.argsort(far, axis=1, kind="stable")[:, :k]
        i, j, d = media.nearest(x, y, k)
        assert np.array_equal(j.reshape(n, k), want) and np.array_equal(i, np.repeat(np.arange(n), k)) and np.array_equal(d.reshape(n, k), np.take_along_axis(far, want, axis=1))
