"""URL lists as a sorted array of 64-bit digests, memory-mapped by the tasks.

A rule is a host and a path prefix, e.g. ``example.org/fr/``. It fits the host and
its subdomains where the url's path starts with the rule's. The digests of all
rules are sorted; the host endings and path prefixes of a batch of urls are
hashed and found by one vectorised binary search, and every hit is compared with
the stored rule, so that a collision of digests decides nothing.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``host`` in lower case, ``path`` from its first slash; ``base`` rules go before the others."""

    host: str
    path: str
    verdict: str
    base: bool = True


# The rules of the registered query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Hosts that the method itself blocks where no rule fits.
LISTED = (Rule("cheap-pills.example.com", "/", "block", False), Rule("spam-farm.example.org", "/", "block", False))
#: Bytes of rules that are sent to the executors as a file; longer lists go through ``judge_by_join``.
MOST_BYTES = 1 << 30


@dataclass(frozen=True)
class Index:
    """Names of the index files as the executors know them, and which lengths occur in rules."""

    prefix: str
    host_lengths: tuple[int, ...]
    path_lengths: tuple[int, ...]


def build_index(spark: SparkSession, rules: Iterable[Rule], most_bytes: int = MOST_BYTES) -> Index:
    """Sort the rules by digest and hand the arrays to the executors as files.

    Of rules with the same host and path a base rule stands, then "block".
    """
    chosen: dict[str, Rule] = {}
    for rule in sorted(rules, key=lambda r: (r.base, r.verdict == "block")):
        chosen[rule.host + rule.path] = rule
    names = sorted(chosen, key=xxhash.xxh64_intdigest)
    blobs = [name.encode() for name in names]
    if sum(map(len, blobs)) + 24 * len(blobs) > most_bytes:
        raise ValueError("the list is larger than most_bytes: use judge_by_join")
    arrays = {
        "keys": np.array([xxhash.xxh64_intdigest(b) for b in blobs], np.uint64),
        "ends": np.cumsum([0, *map(len, blobs)]),
        "text": np.frombuffer(b"".join(blobs) or b"\0", np.uint8),
        "flags": np.array([2 * chosen[n].base + (chosen[n].verdict == "block") for n in names], np.uint8),
    }
    prefix, folder = f"urls-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="urls-")
    for name, array in arrays.items():
        path = os.path.join(folder, f"{prefix}-{name}.npy")
        np.save(path, array)
        spark.sparkContext.addFile(path)
    return Index(
        prefix,
        tuple(sorted({len(r.host) for r in chosen.values()})),
        tuple(sorted({len(r.path) for r in chosen.values()})),
    )


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path of a url; both empty for null or without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + F.lit(3))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower()), path


def endings(host: str, lengths: frozenset[int]) -> Iterator[str]:
    """The host and its parent domains that are as long as some rule's host."""
    at = 0
    while True:
        if len(host) - at in lengths:
            yield host[at:]
        at = host.find(".", at) + 1
        if not at:
            return


class _Mapped:
    def __init__(self, index: Index) -> None:
        load = lambda name: np.load(SparkFiles.get(f"{index.prefix}-{name}.npy"), mmap_mode="r")
        self.keys, self.ends, self.text, self.flags = map(load, ("keys", "ends", "text", "flags"))

    def find(self, probes: list[str]) -> np.ndarray:
        """Place of each probe in the list, or -1."""
        blobs = [p.encode() for p in probes]
        digests = np.array([xxhash.xxh64_intdigest(b) for b in blobs], np.uint64)
        low = np.searchsorted(self.keys, digests, "left")
        high = np.searchsorted(self.keys, digests, "right")
        found = np.full(len(blobs), -1)
        for i in np.flatnonzero(high > low):
            for k in range(low[i], high[i]):
                if self.text[self.ends[k] : self.ends[k + 1]].tobytes() == blobs[i]:
                    found[i] = k
        return found


def judge_urls(pages: DataFrame, index: Index, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``listed``.

    The longest fitting base rule decides and is named in ``rule``; without one
    the longest other rule (named in ``listed``); else the verdict is "allow". Of
    rules of one length the one with the longer host counts. Null and empty urls,
    and urls without ``://``, have neither host nor path and fit no rule. Null
    ids and repeated rows are judged like any other. One narrow pass; other
    columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    hosts, paths = frozenset(index.host_lengths), index.path_lengths
    schema = pa.schema([(n, pa.string()) for n in ("host", "path", "rule", "verdict", "listed")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _Mapped(index)
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                probes, owners = [], []
                for i in range(batch.num_rows):
                    host, path = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    for ending in endings(host, hosts):
                        for n in paths:
                            if n <= len(path):
                                probes.append(ending + path[:n])
                                owners.append((i, len(probes[-1]), len(ending)))
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for k, (i, size, host_size) in zip(rules.find(probes).tolist(), owners, strict=True):
                    if k >= 0:
                        key = (i, int(rules.flags[k]) >> 1)
                        best[key] = max(best.get(key, (0, 0, 0)), (size, host_size, k))
                name = lambda hit: rules.text[rules.ends[hit[2]] : rules.ends[hit[2] + 1]].tobytes().decode()
                named, verdicts, listed = [], [], []
                for i in range(batch.num_rows):
                    base, other = best.get((i, 1)), best.get((i, 0))
                    hit = base or other
                    named.append(name(base) if base else None)
                    verdicts.append("block" if hit and rules.flags[hit[2]] & 1 else "allow")
                    listed.append(name(other) if other and not base else None)
                columns = [batch.column(1), batch.column(2), *(pa.array(c, pa.string()) for c in (named, verdicts, listed))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *schema.names])

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(id_col, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, listed string")


def judge_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same for a list of any size, a table (host, path, verdict, base): prefixes are joined, not sent around.

    The host endings and path prefixes of the distinct hosts and paths meet the
    rules in an equi-join; rows with a null id or url are judged like above.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(id_col, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    # Lengths of rule paths: a few distinct numbers, however long the list.
    sizes = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())
    first = F.min(F.struct((F.col("verdict") != "block").alias("v"), "verdict", F.length("host").alias("h")))
    names = rules.groupBy(F.concat("host", "path").alias("name"), "base").agg(first.alias("r"))
    labels = F.split("host", r"\.")
    each = rows.select("host", "path").distinct()
    each = each.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k"))
    ending = F.array_join(F.slice(labels, F.col("k"), F.lit(1 << 30)), ".")
    each = each.select("host", "path", ending.alias("ending"), F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    each = each.where(F.length("path") >= F.col("n"))
    each = each.withColumn("name", F.concat("ending", F.substring(F.col("path"), F.lit(1), F.col("n"))))
    hit = F.struct(F.length("name").alias("size"), F.col("r.h").alias("h"), "name", F.col("r.verdict").alias("verdict"))
    best = each.join(names, "name").groupBy("host", "path").agg(
        F.max(F.when(F.col("base"), hit)).alias("b"), F.max(F.when(~F.col("base"), hit)).alias("o")
    )
    out = rows.join(best, ["host", "path"], "left")
    verdict = F.coalesce("b.verdict", "o.verdict", F.lit("allow"))
    listed = F.when(F.col("b").isNull(), F.col("o.name"))
    return out.select(id_col, "host", "path", F.col("b.name").alias("rule"), verdict.alias("verdict"), listed.alias("listed"))
