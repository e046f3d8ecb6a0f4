"""URL filters: rules by host and path, in a memory-mapped array of sorted 64-bit digests.

A rule's key is the XXH64 of its string, host and then path. The keys are written once as a sorted array with the rule
strings beside it, sent to every executor as a file, and memory-mapped there. A URL is probed under its host and each
domain above, with each beginning of its path that is as long as some rule's path, by one vectorised binary search for a
batch; where a key is found, the stored string must be the probed one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.cluster import fresh_path, put_bytes
from geoloom.llm.text import lower_ascii

#: ``host/path-beginning`` and the verdict; a path begins with its slash.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"
#: Up to so many bytes of index are sent to every executor; longer lists are probed by a join.
MOST_BYTES = 512 << 20
_MAGIC = b"URLRULE1"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _rest(url)
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def build(rules: list[tuple[str, str]]) -> bytes:
    """The index file: header, sorted keys, string ends, verdicts, path lengths, strings. The last of equal rules holds."""
    last = dict(rules)
    strings = [r.encode() for r in last]
    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
    order = np.argsort(keys, kind="stable")
    strings = [strings[k] for k in order]
    verdicts = np.array([last[s.decode()] == "block" for s in strings], np.uint8)
    ends = np.cumsum([0, *map(len, strings)]).astype("<u8")
    # Beginnings of paths are measured in characters, so that no probe splits one.
    lengths = np.unique([len(s.decode().partition("/")[2]) + ("/" in s.decode()) for s in strings]).astype("<u4")
    head = np.array([len(strings), len(lengths)], "<u8")
    return b"".join([_MAGIC, head.tobytes(), keys[order].astype("<u8").tobytes(), ends.tobytes(), lengths.tobytes(), verdicts.tobytes(), b"".join(strings)])


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"{path} isn't an index of URL rules")
        n, m = (int(x) for x in raw[8:24].view("<u8"))
        at = 24
        self.keys = raw[at : (at := at + 8 * n)].view("<u8")
        self.ends = raw[at : (at := at + 8 * (n + 1))].view("<u8")
        self.lengths = raw[at : (at := at + 4 * m)].view("<u4").tolist()
        self.blocks = raw[at : (at := at + n)]
        self.strings = raw[at:]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The place of each probed string, or -1. Keys that collide stand side by side and are tried in turn."""
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests):
            p = int(at[k])
            while p < len(self.keys) and self.keys[p] == digests[k]:
                if self.strings[int(self.ends[p]) : int(self.ends[p + 1])].tobytes() == probes[k]:
                    out[k] = p
                    break
                p += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, bool]]:
        """For each URL the longest rule that fits, and whether it blocks; the longer host wins, then the longer path."""
        probes: list[bytes] = []
        places: dict[str, int] = {}
        each: list[list[int]] = []
        for host, path in zip(hosts, paths, strict=True):
            own, domain = [], host
            while domain:
                for n in reversed(self.lengths):
                    if n <= len(path):
                        probe = domain + path[:n]
                        if (k := places.get(probe)) is None:
                            k = places[probe] = len(probes)
                            probes.append(probe.encode())
                        own.append(k)
                domain = domain.partition(".")[2]
            each.append(own)
        found = self.find(probes)
        out = []
        for own in each:
            k = next((k for k in own if found[k] >= 0), None)
            out.append((None, False) if k is None else (probes[k].decode(), bool(self.blocks[found[k]])))
        return out


_OPEN: dict[str, Index] = {}


def _index(name: str) -> Index:
    if name not in _OPEN:
        _OPEN[name] = Index(SparkFiles.get(name))
    return _OPEN[name]


def filtered(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    A rule fits its host and all subdomains, if the path begins with the rule's. Without a fitting rule ``rule`` is null
    and the verdict ``default``. Null URLs and those without ``://`` have an empty host and path, which no rule fits.
    Repeated rows are judged alike; an empty table stays empty.
    """
    spark = pages.sparkSession
    data = build(rules)
    if len(data) > MOST_BYTES:
        raise ValueError(f"an index of {len(data)} bytes is too large for every executor; use joined()")
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:24]}"
    _send(spark, name, data)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            got = _index(name).judge(list(hosts), list(paths))
            yield pd.DataFrame({"rule": [r for r, _ in got], "verdict": [("block" if b else "allow") if r is not None else default for r, b in got]}, dtype=object)

    judge = F.pandas_udf(run, "rule string, verdict string")
    out = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    own = _unused(out, "_judged")
    return out.withColumn(own, judge("host", "path")).withColumns({"rule": F.col(own)["rule"], "verdict": F.col(own)["verdict"]}).drop(own)


def _unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _send(spark: SparkSession, name: str, data: bytes) -> None:
    """Write the index in the shared folder, whence each executor, also one that joins later, fetches its own copy."""
    sc = spark.sparkContext
    if name in {os.path.basename(f) for f in sc.listFiles}:
        return
    uri = f"{fresh_path(spark, 'url-rules')}/{name}"
    put_bytes(spark, uri, data)
    sc.addFile(uri)


def joined(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """As ``filtered``, for lists of any length in a table ``(rule, verdict)``: probes meet the digests in a join.

    One row of ``pages`` becomes a row for each domain and each length of a rule's path; the lengths are few.
    """
    last = rules.groupBy("rule").agg(F.max("verdict").alias("_v")).withColumn("_key", F.xxhash64("rule"))
    lengths = [r[0] for r in rules.select(F.length(F.regexp_extract("rule", "(?s)(/.*)", 1)).alias("n")).distinct().collect()]
    out = pages.drop("rule", "verdict").withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    distinct = out.select("host", "path").distinct()
    parts = F.split("host", r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    probes = distinct.where("host <> ''").select("host", "path", F.explode(domains).alias("_d"))
    probes = probes.select("host", "path", "_d", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")).alias("_n")).where(F.length("path") >= F.col("_n"))
    probes = probes.select("host", "path", F.length("_d").alias("_l"), "_n", F.concat("_d", F.substring("path", F.lit(1), F.col("_n"))).alias("_probe")).withColumn("_key", F.xxhash64("_probe"))
    hits = probes.join(last, "_key").where("_probe = rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "_v"), F.struct("_l", "_n")).alias(own := _unused(out, "_hit")))
    out = out.join(hits, ["host", "path"], "left")
    return out.withColumns({"rule": F.col(own)["rule"], "verdict": F.coalesce(F.col(own)["_v"], F.lit(default))}).drop(own)
