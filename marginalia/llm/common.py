"""What the operators share: reading, materialising, hot keys, word hashes."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has at least one row in this many; so at most this many keys are hot.
HOT_SHARE = 1024
#: Below this many rows no key counts as hot.
HOT_LEAST = 1000

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, as spark.checkpoint.dir names it. Only where everything runs in one process may it be a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marginalia-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so that lost executors cost nothing and reads don't recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(col: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def total_bytes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes, from one narrow scan."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_of(text_col))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, n_left: int) -> DataFrame:
    """Left join on ``key`` where ``right`` has one row for each key and says in ``weight`` how many
    left rows have it. Keys with a thousandth of the rows or more number at most HOT_SHARE, whatever
    the input, so that part is broadcast; the others are shuffled. ``weight`` stays in the result."""
    least = max(HOT_LEAST, n_left // HOT_SHARE)
    hot = right.where(F.col(weight) >= least)
    if not hot.head(1):
        return left.join(right, key, "left")
    cold = right.where(F.col(weight) < least)
    hot_part = left.join(F.broadcast(hot), key, "inner")
    cold_part = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return hot_part.unionByName(cold_part)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound and then afresh."""

    def __init__(self, most: int = 200_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words between runs of space, tab, line feed, vertical tab, form feed and return; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_batches(batches, text: int | str, most_bytes: int = 4_000_000):
    """Arrow batches again, each of about ``most_bytes`` of text (or binary data) or one row."""
    for b in batches:
        col = b.column(text)
        if not len(b):
            continue
        wide = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
        size = np.diff(np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(b) + 1])
        at = np.cumsum(size)
        start = 0
        while start < len(b):
            done = at[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(at, done + most_bytes, side="right")))
            yield b.slice(start, stop - start)
            start = stop
