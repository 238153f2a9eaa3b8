"""URL filters by a sorted digest array: memory-mapped 64-bit keys, binary search, and the stored strings to confirm a hit."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended

#: The index is one file that every executor maps; longer lists are refused.
MOST_RULES = 50_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACTIONS = ("allow", "block")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Index:
    """A file of n, the n sorted keys, n + 1 string ends, n host lengths, n actions and the strings."""

    def __init__(self, path: str):
        n = int(np.memmap(path, np.uint64, "r", 0, 1)[0])
        self.keys = np.memmap(path, np.uint64, "r", 8, n) if n else np.empty(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", 8 + 8 * n, n + 1)
        self.hosts = np.memmap(path, np.int64, "r", 16 + 16 * n, n) if n else np.empty(0, np.int64)
        at = 16 + 24 * n
        self.actions = np.memmap(path, np.uint8, "r", at, n) if n else np.empty(0, np.uint8)
        self.text = np.memmap(path, np.uint8, "r", at + n) if n and self.ends[-1] else np.empty(0, np.uint8)
        self.host_sizes = np.unique(self.hosts).tolist()
        self.path_sizes = np.unique(np.diff(self.ends) - self.hosts).tolist()

    @staticmethod
    def write(path: str, rules: Iterable[tuple[str, str, str]]) -> None:
        """rules: (action, host, path); the last of equal ones counts."""
        known: dict[tuple[bytes, int], int] = {}
        for action, host, where in rules:
            h = host.encode()
            known[h + where.encode(), len(h)] = ACTIONS.index(action)
            if len(known) > MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules")
        keys = np.array([xxhash.xxh64_intdigest(s) for s, _ in known], np.uint64)
        order = np.argsort(keys, kind="stable")
        items = list(known.items())
        strings = [items[i][0][0] for i in order]
        with open(path, "wb") as f:
            np.array([len(keys)], np.uint64).tofile(f)
            keys[order].tofile(f)
            np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64).tofile(f)
            np.array([items[i][0][1] for i in order], np.int64).tofile(f)
            np.array([items[i][1] for i in order], np.uint8).tofile(f)
            f.write(b"".join(strings))

    def candidates(self, host: bytes, where: bytes) -> Iterator[tuple[bytes, int]]:
        for h in self.host_sizes:
            if h == len(host) or h < len(host) and host[len(host) - h - 1] == 0x2E:
                for p in self.path_sizes:
                    if p <= len(where):
                        yield host[len(host) - h :] + where[:p], h

    def longest(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[str | None, int]]:
        """For each url the longest rule that fits (equal lengths: the longer host) and its action; (None, -1) without one."""
        cand: list[bytes] = []
        size: list[int] = []
        of: list[int] = []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            for c, n in self.candidates(h, p):
                cand.append(c)
                size.append(n)
                of.append(i)
        out: list[tuple[str | None, int]] = [(None, -1)] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        probe = np.fromiter(map(xxhash.xxh64_intdigest, cand), np.uint64, len(cand))
        at = np.searchsorted(self.keys, probe)
        found = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probe)) if len(self.keys) else []
        for j in found:
            k = at[j]
            while k < len(self.keys) and self.keys[k] == probe[j]:
                if self.hosts[k] == size[j] and self.text[self.ends[k] : self.ends[k + 1]].tobytes() == cand[j]:
                    if (len(cand[j]), size[j]) > best[of[j]]:
                        best[of[j]] = (len(cand[j]), size[j])
                        out[of[j]] = (cand[j].decode(), int(self.actions[k]))
                    break
                k += 1
        return out


@lru_cache(maxsize=4)
def _mapped(name: str) -> Index:
    return Index(SparkFiles.get(name))


def build(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the index of (action, host, path) rules and send it to every executor; its name."""
    name = f"urlrules-{uuid.uuid4().hex}.bin"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="loomgraph-")), name)
    Index.write(path, rules)
    spark.sparkContext.addFile(path)
    return name


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Append host, path, rule and verdict to all rows and columns of pages (columns named so are replaced).

    A rule (action, host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest host + path wins
    (equal lengths: the longer host). No rule: rule is null and the verdict is `otherwise`. A null or odd url has an empty host and path,
    which only a rule with an empty host could fit. Repeated rows are judged alike; no rows: none. No shuffle.
    """
    name = build(pages.sparkSession, rules)
    pages = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    ready = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(name)
        for b in batches:
            found = index.longest(b.column("host").cast(pa.binary()).to_pylist(), b.column("path").cast(pa.binary()).to_pylist())
            rule = pa.array([r for r, _ in found], pa.string())
            verdict = pa.array([otherwise if r is None else ACTIONS[a] for r, a in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    return ready.mapInArrow(run, extended(ready, rule="string", verdict="string"))
