import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from marginalia.llm import merkle
from marginalia.llm.filter_audit import filter_audit
from marginalia.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, kept boolean, part int, h string, t string"
LABELS = "doc_id long, quality int, toxic int, text string"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].itertuples(index=False, name=None)))
    got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert rows(got) == rows(c.sql(ORACLE_SQL[name]).df())


def odd_rows():
    """Ids and texts: nulls, empties, very long ones, copies across parts, repeated ids, capitals, symbols; sources null and empty."""
    rng = random.Random(7)
    base = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d$", "e|f", f"w{k}", "naïve", " x"]) for k in range(rng.choice([3, 49, 50, 90]))) for _ in range(40)]
    rows = [(k, rng.choice(base), rng.choice(["a", "b", "", None])) for k in range(150)]
    rows += [(200, None, "a"), (201, "", "b"), (202, " \n\x0b", None), (203, "É" * 30 + " A", "c"), (204, "long word " * 30_000, "c")]
    return rows + [(5, rows[5][1], "a"), (5, base[0], "b"), (None, base[1], "a"), (None, None, None), (200, None, "a"), (7, base[2], None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ["en", None][k % 2], s, k % 7, "clash", 1, True, 9, "h", "t") for k, (i, t, s) in enumerate(rows)], SCHEMA)


def audit_by_force(rows, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x, _ in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    fails, parts = [], defaultdict(list)
    for k, (i, text, part) in enumerate(rows):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append({c for c in f if f[c]})
        parts[part or ""].append(k)
    out, total = [], defaultdict(int)
    for part, own in parts.items():
        for order in permutations("ABCDE"):
            left = list(own)
            for step, c in enumerate(order, 1):
                gone = [k for k in left if c in fails[k]]
                every = [k for k in own if c in fails[k]]
                left = [k for k in left if c not in fails[k]]
                total[part, c] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(every) - len(gone), sum(fails[k] == {c} for k in own), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone), c))
    return sorted((*r[:-1], total[r[0], r[-1]]) for r in out)


def test_audit_by_force(spark, none):
    rows = odd_rows()
    labels = [(k, k % 2, k % 3 == 0, "t") for k in range(0, 150, 2)] + [(3, 0, 0, "t"), (3, 1, None, "t"), (None, 1, 1, "t"), (999, 1, 1, "t"), (5, None, 1, "t")]
    labels = [(i, q, None if x is None else int(x), t) for i, q, x, t in labels]
    got = filter_audit(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = audit_by_force(rows, [x for x in labels if x[0] is not None])
    assert sorted(tuple(r[n] for n in names) for r in got) == want and len(want) == 600 * 4
    nobody = filter_audit(frame(spark, rows[:3]), spark.createDataFrame([], LABELS)).collect()
    assert {(r["good_lost"], r["toxic_lost"]) for r in nobody} == {(0, 0)}
    assert filter_audit(none, spark.createDataFrame(labels, LABELS)).count() == 0


def manifest_by_force(rows):
    """[(id, leaf, subroot, root, proof, folded, verified)] of (id, text, lang, source, n_chars)."""
    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, k):
        out = []
        for nodes in levels[:-1]:
            at = k // 16 * 16
            run = nodes[at : at + 16]
            out.append((run[: k - at], run[k - at + 1 :]))
            k //= 16
        return out

    leaf = lambda r, t: H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], t))
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = up([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for k, (_, _, h, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = way(trees[s], k) + way(top, n)
            node = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                node = H([*a, node, *b])
            out.append((r[0], h, trees[s][-1][0], top[-1][0], H(x for a, b in path for x in a + b), node, node == top[-1][0]))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run_manifest(docs, **more):
    from pyspark.sql import functions as F

    return merkle.merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered=F.crc32(docs["doc_id"].cast("string")) % 5 == 0, **more)


def compare(spark, rows, **more):
    docs = frame(spark, rows)
    plain = [(i, t, ["en", None][k % 2], s, k % 7) for k, (i, t, s) in enumerate(rows)]
    got = run_manifest(docs, **more).select(*MANIFEST).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, manifest_by_force(plain)))


def test_manifest_by_force(spark, none):
    compare(spark, odd_rows())
    compare(spark, [(1, "One", "s")])
    compare(spark, [(k, f"Text {k}", "only") for k in range(300)])
    assert run_manifest(none).count() == 0


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_over_many_blocks(spark, levels):
    """Small blocks, so that groups and the tree of groups need several rounds; a group with most rows, many with few."""
    rows = [(k, f"Text {k}", "hot") for k in range(600)] + [(1000 + k, f"X {k}", f"s{k // 2}") for k in range(700)]
    compare(spark, rows + [(2000, "Same", "same")] * 40, most=levels)


def test_paths_at_every_size():
    for n in [1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 272, 273, 500, 4095, 4096]:
        leaves = [H([str(k)]) for k in range(n)]
        root = merkle.block_root(leaves, True)
        assert all(merkle.folded(leaf, p) == root for leaf, p in zip(leaves, merkle.paths(leaves, True)))
        other = merkle.block_root(leaves, False)
        assert all(merkle.folded(leaf, p) == other and len(p) == 3 for leaf, p in zip(leaves, merkle.paths(leaves, False)))


def test_proofs_and_their_check(spark):
    docs = frame(spark, odd_rows())
    made = run_manifest(docs, proofs=True)
    assert merkle.verify(made).where("not proven").count() == 0
    from pyspark.sql import functions as F

    forged = made.withColumn("leaf", F.sha2("leaf", 256))
    assert merkle.verify(forged).where("proven").count() == 0
