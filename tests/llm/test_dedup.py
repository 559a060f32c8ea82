import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from marginalia.llm.components import connected_components
from marginalia.llm.exact_dedup import drop_exact_copies, exact_dedup
from marginalia.llm import near_dedup
from marginalia.llm.near_dedup import bucket_keys, drop_near_copies, most_apart, near_duplicates, shingles, signatures
from marginalia.llm.suffix_dedup import Segments, drop_repeated_passages, repeated_passages

WS = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("digest", [False, True])
def test_exact(docs, none, texts, digest):
    norm = [(i, WS.sub(" ", t or "")) for i, t in texts]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = []
    for i, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((str(i), str(keep), len(groups[t]), i == keep) + ((hashlib.sha256(t.encode()).hexdigest(),) if digest else ()))
    got = exact_dedup(docs, digest=digest)
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got.collect()) == sorted(want)
    assert exact_dedup(none, digest=digest).count() == 0


def test_drop_exact_keeps_the_columns(docs, texts):
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= set(range(60))


def test_hot_groups_are_joined_apart(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = exact_dedup(df).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in got} == {True: 2501, False: 2499}


def brute_links(texts, percent=85):
    sets = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [(str(i), len(s), str(find(i)) if i is not None else "None", i is None or find(i) == i) for i, s in sets]


def test_near_equals_brute_force(docs, none, texts):
    got = near_duplicates(docs).collect()
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == sorted(brute_links(texts))
    assert near_duplicates(none).count() == 0
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns


def test_signatures_estimate_similarity_and_near_ones_share_a_key():
    rng = np.random.default_rng(1)
    text = [str(x) for x in rng.integers(0, 10**6, 400)]
    a = shingles(" ".join(text))
    text[100] = text[200] = text[300] = "other"
    b = shingles(" ".join(text))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = signatures([a, b])
    assert abs((s[0] == s[1]).mean() - j) < 0.15
    k = bucket_keys(s)
    assert (k[0] == k[1]).any()
    assert len(shingles("")) == 0 and len(shingles("a b")) == 1 and len(shingles("a A a a A a")) == 1


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark):
    # hubs in a chain that share leaves, one whose only smaller neighbour is a leaf, paths that hang on leaves
    rng = np.random.default_rng(4)
    edges = [(9000 + h, 10000 + 700 * h + int(x)) for h in range(6) for x in rng.integers(0, 1500, 2500)]
    edges += [(30000, 31000 + k) for k in range(1500)] + [(7, 31005), (5, 7)] + [(50000 + k, 50001 + k) for k in range(300)] + [(50300, 31010)]
    edges += [(80000 + k, 90000) for k in range(1200)]
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(label) and {r["node"]: r["component"] for r in got} == {x: root(x) for x in label}


def brute_passages(texts, match=50):
    first, out = {}, {}
    rows = sorted([(i, (t or "").encode()) for i, t in texts if i is not None], key=lambda r: r[0])
    for i, t in rows:
        for p in range(len(t) - match + 1):
            first.setdefault(t[p : p + match], i)
    for i, t in [(i, (t or "").encode()) for i, t in texts]:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - match + 1):
                if first[t[p : p + match]] < i:
                    gone[p : p + match] = b"\1" * match
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.setdefault(str(i), []).append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_passages_equal_brute_force(docs, none, texts):
    got = {}
    for r in repeated_passages(docs).collect():
        got.setdefault(str(r["doc_id"]), []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == brute_passages(texts)
    assert repeated_passages(none).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(docs, match=20)


def test_passages_leave_columns_and_rows(docs):
    out = drop_repeated_passages(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_every_window_is_in_one_segment():
    rng = np.random.default_rng(3)
    for alphabet in (1, 2, 20):
        a, b = rng.integers(97, 97 + alphabet, 300).astype(np.uint8), rng.integers(97, 97 + alphabet, 40).astype(np.uint8)
        s = Segments(np.concatenate([a, b, a]), np.array([300, 340, 640]), 50)
        windows = np.concatenate([np.arange(x, x + n) for x, n in zip(s.start, s.count)])
        assert windows.tolist() == [*range(251), *range(340, 591)]
        one = dict(zip(s.start.tolist(), s.choice.tolist()))
        assert all(one[x] == one[x + 340] for x in one if x < 251)  # equal windows choose alike


def test_pipeline_drops_near_copies_from_080(spark):
    """Four words of 200 replaced, far apart: 176 of 216 shingles, 0.815."""
    import corpus_pipeline

    rows = []
    for k in range(40):
        w = [f"w{k}x{j}" for j in range(200)]
        other = [f"other{j}" if j in (30, 70, 110, 150) else x for j, x in enumerate(w)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 80, 2))
    assert drop_near_copies(docs).count() == 80


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_every_pair_within_the_threshold_shares_a_key(percent):
    """Also where the differences are dealt out as unkindly as can be: evenly over the chunks."""
    rng = np.random.default_rng(percent)
    bounds = near_dedup.chunk_bounds(percent)
    assert most_apart(percent) < 2 * (len(bounds) - 1)
    for k in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        if k % 2:
            at = rng.choice(near_dedup.SYMBOLS, most_apart(percent), replace=False)
        else:
            at = np.concatenate([rng.choice(np.arange(x, y), min(2, y - x), replace=False) for x, y in rng.permutation(np.stack([bounds[:-1], bounds[1:]], axis=1))])[: most_apart(percent)]
        b[at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
        keys = bucket_keys(np.stack([a, b]), percent)
        assert (keys[0] == keys[1]).any()


def rows_with_repeated_ids():
    """(id, text): ids that repeat with the same and other texts, null ids, nulls, empties, ties."""
    rng = random.Random(8)
    w = lambda n: " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(3)) for _ in range(n))
    a, b, c, passage = w(60), w(60), w(60), w(20)
    near = a.split()
    near[30] = "other"
    cut1, cut2 = w(12) + " " + passage + " " + w(5), w(9) + " " + passage + " " + w(7)
    return [
        (3, "same text"), (5, "same text"), (5, "unique words are here"), (None, "same text"), (None, "unique words there"), (None, "twice"), (None, "twice"),
        (7, a), (7, b), (7, b), (9, " ".join(near)), (9, c), (2, c), (None, a), (11, None), (11, ""), (12, " "), (4, cut1), (8, cut2), (8, w(30)), (8, cut1), (6, passage), (6, w(40)), (-1, w(25)),
    ]


@pytest.fixture(scope="module")
def repeated(spark):
    rows = rows_with_repeated_ids()
    return rows, spark.createDataFrame([(i, t, k, k, "h", "t", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int, component long, h string, t string, __s int")


def test_exact_copies_go_by_id_and_text(repeated):
    rows, docs = repeated
    norm = [(i, WS.sub(" ", t or "")) for i, t in rows]
    stay = [k for k, (i, t) in enumerate(norm) if i == min((x for x, y in norm if y == t and x is not None), default=None)]
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r["n"] for r in kept.collect()) == stay


def test_near_copies_go_by_id_and_text(repeated):
    rows, docs = repeated
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))
    for _ in rows:
        for x in range(len(rows)):
            for y in range(len(rows)):
                if rows[x][0] is not None and rows[y][0] is not None and sets[x] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                    up[x] = up[y] = min(up[x], up[y])
    least = [None if i is None else min(rows[y][0] for y in range(len(rows)) if up[y] == up[x] and rows[y][0] is not None) for x, (i, _) in enumerate(rows)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_duplicates(docs).collect())
    assert got == sorted((str(i), len(s), str(c), i == c) for (i, _), s, c in zip(rows, sets, least))
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["n"] for r in kept.collect()) == [k for k, (i, _) in enumerate(rows) if i == least[k]]


def test_passages_go_by_id_and_text(repeated):
    rows, docs = repeated
    got = {}
    for r in repeated_passages(docs).collect():
        got.setdefault(str(r["doc_id"]), []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    want = brute_passages(rows)
    assert {k: sorted(v) for k, v in got.items()} == want
    cut = drop_repeated_passages(docs)
    assert cut.columns == docs.columns
    own = {}
    for r in cut.collect():
        own.setdefault(str(r["doc_id"]), []).append(hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {k: sorted(v) for k, v in own.items()} == {k: sorted(x[3] for x in v) for k, v in want.items()}


def test_blocks_and_salts_change_nothing(spark, docs, texts, monkeypatch):
    """Small blocks, so that buckets, groups and pairs are cut into many, and keys count as common."""
    monkeypatch.setattr(near_dedup, "BLOCK_OF_GROUP", 4)
    monkeypatch.setattr(near_dedup, "LOOK_BACK", 1)
    got = near_duplicates(docs).collect()
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == sorted(brute_links(texts))


def test_splitters_of_two_words():
    from marginalia.llm.suffix_dedup import _bucket

    rng = np.random.default_rng(5)
    split = np.unique(rng.integers(0, 4, (9, 2)).astype(np.uint64), axis=0)
    lead = rng.integers(0, 5, (300, 2)).astype(np.uint64)
    want = [sum(tuple(s) <= tuple(x) for s in split.tolist()) for x in lead.tolist()]
    assert _bucket(lead, split).tolist() == want
    assert _bucket(lead, split[:0]).tolist() == [0] * 300


def test_passages_shuffle_documents_once_not_once_a_bucket(spark, monkeypatch):
    """Buckets learn about the documents that have segments in them, in few bytes: the rest does not grow with the buckets (F1, F2)."""
    monkeypatch.setattr("marginalia.llm.suffix_dedup.BUCKET_BYTES", 12_000)
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abcdefghijklmnop") for _ in range(200))) for i in range(4000)], "doc_id long, text string").coalesce(1)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert repeated_passages(docs).where("n_removed > 0").count() == 0
    assert written() - before < 3_000_000


@pytest.mark.parametrize("seed", range(4))
def test_passages_of_repeated_prefixes(spark, seed):
    """Equal windows in which the chosen prefix comes twice name each of its places, wherever their segments end."""
    rng = random.Random(seed)
    unit = "".join(rng.choice("ab") for _ in range(rng.randrange(3, 26)))
    line = unit * (120 // len(unit) + 1)
    texts = {i: "".join(rng.choice("cdef") for _ in range(rng.randrange(30))) + line[rng.randrange(20) :] + "".join(rng.choice("cdef") for _ in range(rng.randrange(30))) for i in range(12)}
    got = {r["doc_id"]: r["n_removed"] for r in repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        gone = set()
        for a in range(len(t) - 49):
            if any(t[a : a + 50] in texts[j] for j in range(i)):
                gone |= set(range(a, a + 50))
        assert got[i] == len(gone), i
