"""URL rules by a bit-parallel wildcard automaton.

All glob patterns share one multiword Shift-And state: a bit for each position
of each pattern. A star becomes a self-loop on the position before it. The
canonical URL is read byte by byte, for all URLs of a batch at once; after the
last byte the accepting bits say which patterns matched. Its cost grows with
the bytes of the URLs and the words of state, not with the number of rules
times the number of URLs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands between host and path in the canonical URL, where no star of the host can cross it.
SEPARATOR = 0


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; only A-Z are lower-cased. Empty if there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ? or #. Empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class GlobAutomaton:
    """Matches byte strings against globs in which * stands for any bytes except ``stop`` in its part.

    A pattern is a list of parts joined by ``stop``; a star never crosses ``stop``,
    except a star that ends the pattern, which takes all that follows.
    """

    def __init__(self, patterns: Sequence[bytes], stop: int = SEPARATOR):
        self.n = len(patterns)
        states = [p.replace(b"*", b"") for p in patterns]
        bits = sum(len(s) + 1 for s in states)  # one bit before the first byte, one after each
        self.words = max(1, -(-bits // 64))
        self.take = np.zeros((256, self.words), np.uint64)  # bits that a byte may enter from the bit below
        self.stay = np.zeros((256, self.words), np.uint64)  # bits that loop on a byte
        self.start = np.zeros(self.words, np.uint64)
        self.accept: list[int] = []
        at = 0

        def put(table, i):
            table[..., i // 64] |= np.uint64(1 << (i % 64))

        for p in patterns:
            put(self.start, at)
            for i, c in enumerate(p):
                if c == ord("*"):
                    last = i == len(p) - 1
                    for byte in range(256):
                        if last or byte != stop:
                            put(self.stay[byte], at)
                else:
                    at += 1
                    put(self.take[c], at)
            self.accept.append(at)
            at += 1

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row of booleans over the patterns for each text."""
        n = len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")  # those still being read are always the first
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(size) - size)[order]
        ordered = size[order]
        state = np.tile(self.start, (n, 1))
        active = np.searchsorted(-ordered, -np.arange(int(size.max(initial=0))), side="left")
        for t, k in enumerate(active.tolist()):
            byte = flat[begin[:k] + t]
            s = state[:k]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)  # the bit that crosses into the next word
            state[:k] = (moved & self.take[byte]) | (s & self.stay[byte])
        out = np.empty((n, self.n), bool)
        for j, i in enumerate(self.accept):
            out[order, j] = (state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        return out


def rule_patterns(rules: Sequence[tuple[str, str, str]]) -> list[bytes]:
    """Two globs a rule: for its host itself and for its subdomains, each followed by its path."""
    out = []
    for host, path, _ in rules:
        if "*" in host + path:
            raise ValueError("rules are plain hosts and path prefixes")
        tail = bytes([SEPARATOR]) + path.encode() + b"*"
        out += [host.encode() + tail, b"*." + host.encode() + tail]
    return out


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict. ``rules``: (host, path prefix, verdict); the longest that fits wins, of equals the first.

    A null url, or one without ://, has an empty host and path and fits no rule.
    Where no rule fits, rule is null and the verdict is ``default``. Repeated
    rows give repeated rows; other columns are not read.
    """
    rank = np.array([len((h + p).encode()) for h, p, _ in rules], np.int64)
    names, verdicts = [h + p for h, p, _ in rules], [v for _, _, v in rules]
    patterns = rule_patterns(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(patterns)
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = automaton.match([h.encode() + b"\0" + p.encode() for h, p in zip(hosts, paths)])
            fit = np.where(hit[:, ::2] | hit[:, 1::2], rank, -1) if rules else np.full((len(b), 1), -1)
            best = np.where(fit.max(axis=1) >= 0, fit.argmax(axis=1), -1).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([names[i] if i >= 0 else None for i in best], pa.string()), pa.array([verdicts[i] if i >= 0 else default for i in best], pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    return narrow.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
