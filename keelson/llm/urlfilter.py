"""URL rules behind a sorted array of 64-bit digests.

A rule is a host and a path prefix with a verdict; it fits the host and all its subdomains.  The rule
list is written once to the shared folder as files: the sorted xxhash64 digests of the rule strings (8 bytes each), and the full
strings in the same order with their offsets.  Spark's file server hands them to the executors, which memory-map the digests:
all tasks of a machine share the pages and none holds the list on its heap.  For every url the possible rule strings
(each suffix of the host with as many labels as some rule's host, joined with each prefix of the path whose length some rule has) are
hashed together for a whole batch and probed by one vectorised binary search; a hit counts only when the stored full string is the
same, so a digest collision can't decide anything.  What a url costs thus depends on the shapes that rules have, not on its length.

Lists above ``max_local_rules`` are not shipped; the same candidates are then exploded and joined with the rule table.

The longest fitting rule string wins; if two rules spell the same string (``a`` + ``.b/x``, ``a.b`` + ``/x``), the longer host.  Two rules
with the same host and path are a contradiction and refused, however long the list is.

Defined results for odd input: urls without ``://`` and null urls have empty host and path, fit no rule and are allowed; a host of any
length is judged whole; equal rows get equal verdicts, each row its own; an empty table gives an empty result, an empty rule list
allows everything; extra columns are kept, and when a computed name is taken (ignoring case), ``added_columns`` numbers it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import scratch_path, write_file
from .common import arrow_map, fresh_name

ADDED = ("host", "path", "rule", "verdict")
DEFAULT_VERDICT = "allow"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: 10 million rules are 80 MB of digests and about 400 MB of strings on each machine's disk.
MAX_LOCAL_RULES = 10_000_000
#: (application, name) of the rule files that the file server already has.
_SERVED: set[tuple[str, str]] = set()


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of ``url``; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest, "") if slash < 0 else (rest[:slash], rest[slash:])


def refuse_contradictions(rules: Sequence[Rule]) -> None:
    if len({(r.host, r.path) for r in rules}) != len(rules):
        raise ValueError("two rules have the same host and path")


@dataclass(frozen=True)
class Shapes:
    """What rules of a list look like: label counts of hosts, the longest host, lengths of paths."""

    labels: tuple[int, ...]
    longest_host: int
    path_sizes: tuple[int, ...]

    @classmethod
    def of(cls, rules: Sequence[Rule]) -> Shapes:
        hosts = {r.host for r in rules}
        return cls(tuple(sorted({h.count(".") + 1 for h in hosts})), max(map(len, hosts), default=0), tuple(sorted({len(r.path) for r in rules})))

    def hosts(self, host: str) -> list[str]:
        """Suffixes of ``host`` that could be a rule's host."""
        if not host or not self.labels:
            return []
        parts, out = host.rsplit(".", self.labels[-1]), []
        cut, whole = len(parts) > self.labels[-1], len(parts)
        for n in self.labels:
            if n <= whole - cut or (n == whole and not cut):
                suffix = ".".join(parts[whole - n :])
                if len(suffix) <= self.longest_host:
                    out.append(suffix)
        return out

    def candidates(self, host: str, path: str) -> list[tuple[str, str]]:
        """(host, path) of every rule that could fit."""
        return [(h, path[:n]) for h in self.hosts(host) for n in self.path_sizes if n <= len(path)]


def added_columns(columns: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for c in ADDED:
        out[c] = fresh_name(c, [*columns, *out.values()])
    return out


class DigestArray:
    """Sorted digests (memory-mapped) with the rule strings that confirm a hit."""

    def __init__(self, folder: str, name: str) -> None:
        top = os.path.join(folder, name)
        self.digests = np.memmap(f"{top}.keys", dtype=np.uint64, mode="r") if os.path.getsize(f"{top}.keys") else np.zeros(0, np.uint64)
        self.offsets = np.memmap(f"{top}.offsets", dtype=np.uint64, mode="r")
        self.strings = np.memmap(f"{top}.strings", dtype=np.uint8, mode="r")

    @staticmethod
    def files(rules: Sequence[Rule]) -> tuple[str, dict[str, bytes]]:
        """The files of ``rules`` by kind, and their common name, made from their content."""
        refuse_contradictions(rules)
        records = sorted((xxhash.xxh64_intdigest(r.key.encode()), f"{r.verdict}\0{r.host}\0{r.path}".encode()) for r in rules)
        blob = b"".join(s for _, s in records)
        sizes = [len(s) for _, s in records]
        name = "rules-" + hashlib.sha256(blob + repr(sizes).encode()).hexdigest()[:24]
        return name, {"keys": np.array([k for k, _ in records], dtype=np.uint64).tobytes(), "offsets": np.cumsum([0, *sizes]).astype(np.uint64).tobytes(), "strings": blob or b"\0"}

    def record(self, i: int) -> tuple[str, str, str]:
        verdict, host, path = bytes(self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])]).decode().split("\0")
        return verdict, host, path

    def probe(self, found: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """For each candidate (host, path) the confirmed (rule string, verdict), or None."""
        out: list[tuple[str, str] | None] = [None] * len(found)
        if not found or not len(self.digests):
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest((h + p).encode()) for h, p in found), dtype=np.uint64, count=len(found))
        first, last = np.searchsorted(self.digests, keys, "left"), np.searchsorted(self.digests, keys, "right")
        for i in np.flatnonzero(first < last):
            for j in range(first[i], last[i]):
                verdict, host, path = self.record(j)
                if (host, path) == found[i]:
                    out[i] = (host + path, verdict)
        return out


def longest(hits: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """Rule string and verdict of the longest of ``(string, verdict, host)``; of equal strings the longer host, then block."""
    best = max(hits, key=lambda x: (len(x[0]), len(x[2]), x[1] == "block"), default=None)
    return best and (best[0], best[1])


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", max_local_rules: int = MAX_LOCAL_RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict of ``url_col`` appended."""
    spark = pages.sparkSession
    refuse_contradictions(rules)
    if len(rules) > max_local_rules:
        return _filter_by_join(pages, rules, url_col)
    name, files = DigestArray.files(rules)
    if (served := (spark.sparkContext.applicationId, name)) not in _SERVED:
        folder = scratch_path(spark, "rules")
        for kind, content in files.items():
            write_file(spark, f"{folder}/{name}.{kind}", [content])
            spark.sparkContext.addFile(f"{folder}/{name}.{kind}")
        _SERVED.add(served)
    del files
    shapes = Shapes.of(rules)
    where, names = pages.columns.index(url_col), added_columns(pages.columns)
    schema = T.StructType([*pages.schema.fields, *(T.StructField(names[c], T.StringType()) for c in ADDED)])

    def run(batches):
        index = DigestArray(SparkFiles.getRootDirectory(), name)
        for b in batches:
            parts = [split_url(u) for u in b.column(where).to_pylist()]
            parts = [(h.translate(LOWER), p) for h, p in parts]
            flat, owner = [], []
            for i, (h, p) in enumerate(parts):
                c = shapes.candidates(h, p)
                flat += c
                owner += [i] * len(c)
            hits: list[list] = [[] for _ in parts]
            for i, c, hit in zip(owner, flat, index.probe(flat), strict=True):
                if hit:
                    hits[i].append((*hit, c[0]))
            won = [longest(x) for x in hits]
            added = ([h for h, _ in parts], [p for _, p in parts], [w and w[0] for w in won], [w[1] if w else DEFAULT_VERDICT for w in won])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in added)], names=[*b.schema.names, *names.values()])

    return arrow_map(pages, run, schema)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.key, r.host, r.path, r.verdict) for r in rules], "rule string, rule_host string, rule_path string, rule_verdict string")


def _filter_by_join(pages: DataFrame, rules: Sequence[Rule], url_col: str) -> DataFrame:
    """The same verdicts for lists too long to ship: distinct (host, path) are exploded into candidates and joined."""
    names, shapes = added_columns(pages.columns), Shapes.of(rules)
    host, path = names["host"], names["path"]
    tail = F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    slash = F.instr(tail, "/")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = pages.withColumns(
        {
            host: F.translate(F.when(slash > 0, F.substring(tail, F.lit(1), slash - 1)).otherwise(tail), upper, lower),
            path: F.when(slash > 0, F.substring(tail, slash, F.length(tail))).otherwise(F.lit("")),
        }
    )
    sizes = F.array(*map(F.lit, shapes.path_sizes))
    suffixes = F.array_distinct(F.transform(F.array(*map(F.lit, shapes.labels)), lambda n: F.call_function("substring_index", F.col("h"), F.lit("."), -n)))
    fitting = F.filter(suffixes, lambda x: F.length(x) <= shapes.longest_host)
    wanted = (
        split.select(F.col(f"`{host}`").alias("h"), F.col(f"`{path}`").alias("p"))
        .distinct()
        .where(F.col("h") != "")
        .withColumn("rule_host", F.explode(fitting))
        .withColumn("n", F.explode(F.filter(sizes, lambda n: n <= F.length("p"))))
        .withColumn("rule_path", F.substring(F.col("p"), F.lit(1), F.col("n")))
    )
    order = F.struct(F.length("rule"), F.length("rule_host"), F.col("rule_verdict") == "block", "rule", "rule_verdict")
    won = wanted.join(rule_table(pages.sparkSession, rules), ["rule_host", "rule_path"]).groupBy("h", "p").agg(F.max(order).alias("w"))
    joined = split.join(won, (F.col(f"`{host}`") == won["h"]) & (F.col(f"`{path}`") == won["p"]), "left")
    added = {names["rule"]: F.col("w.rule"), names["verdict"]: F.coalesce("w.rule_verdict", F.lit(DEFAULT_VERDICT))}
    return joined.withColumns(added).drop("w", "h", "p")
