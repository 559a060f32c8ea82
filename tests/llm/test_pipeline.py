import zlib

import numpy as np
import public_tokenizers
from test_dedup import WS, rows_with_repeated_ids
from tokenizers import Tokenizer

import corpus_pipeline


def brute(rows):
    """What stays of (id, text) after exact copies, near copies (0.80) and repeated passages."""
    norm = [(i, WS.sub(" ", t or "")) for i, t in rows]
    rows = [rows[k] for k, (i, t) in enumerate(norm) if i == min((x for x, y in norm if y == t and x is not None), default=None)]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))
    for _ in rows:
        for x in range(len(rows)):
            for y in range(len(rows)):
                if rows[x][0] is not None and rows[y][0] is not None and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    up[x] = up[y] = min(up[x], up[y])
    rows = [(i, t) for x, (i, t) in enumerate(rows) if i is None or i == min(rows[y][0] for y in range(len(rows)) if up[y] == up[x] and rows[y][0] is not None)]
    first, out = {}, []
    for i, t in sorted([r for r in rows if r[0] is not None], key=lambda r: r[0]):
        for p in range(len(t or "") - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in rows:
        gone = bytearray(len(t or ""))
        for p in range(len(gone) - 49 if i is not None else 0):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((i, "".join(c for c, g in zip(t or "", gone) if not g)))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Without usable labels nothing is toxic; ids repeat or are null, texts are null, empty or copies, columns clash."""
    rows = rows_with_repeated_ids()
    docs = spark.createDataFrame([(i, t, "en", "s", k, "h") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, component string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in brute(rows):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((str(i), 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    for s in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
