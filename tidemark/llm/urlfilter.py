"""URL filters: rules by host and path, looked up in a sorted array of 64-bit digests.

A rule (host, path, action) fits its host and all subdomains where the url's path starts with the rule's path; the longest
rule that fits decides, and a url without one gets the default action. A url's host lies between its first ``://`` and the
next ``/``, ``?``, ``#`` or its end, with A-Z lower-cased; its path reaches from there to ``?``, ``#`` or the end. Without ``://``
both are empty, which no rule fits.

The rules' XXH64 digests are sorted into a file beside the rules' strings and the lengths that their hosts and paths have;
``SparkContext.addFile`` puts the files on every executor, where each Python worker maps them into memory once, so that an executor's
workers share one copy. A batch's candidates (the suffixes of a host and the beginnings of a path of lengths that rules have)
are hashed, found by binary search over the whole batch, and every hit is confirmed against the stored string, so that two
strings with one digest never pass for each other. ``MAX_RULE_BYTES`` bounds what is shipped; ``judge_by_join`` does the same
with a shuffle join for rule tables of any size. Spark keeps the files until the session ends, and the driver's own copy goes with the
driver.

Edge cases: a null url has host and path '' and the default action; repeated rows are judged alike; of rules with the same
host and path the last counts; of equally long rules the one with the longer host; an empty rule list leaves every url to
the default; extra columns are ignored.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at

MAX_RULE_BYTES = 256 << 20
ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]


def parts_of(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    stop = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    tail = rest[stop:]
    end = min((k for c in "?#" if (k := tail.find(c)) >= 0), default=len(tail))
    return rest[:stop].encode().lower().decode(), tail[:end]


class DigestIndex:
    """The memory-mapped rules of one folder prefix: digests, the strings' places, the strings, and the lengths of hosts and paths."""

    def __init__(self, prefix: str):
        self.digests, self.starts, lengths = (np.load(f"{prefix}-{part}.npy", mmap_mode="r") for part in ("digests", "starts", "lengths"))
        self.text = np.load(f"{prefix}-strings.npy", mmap_mode="r")
        self.host_lengths, self.path_lengths = (set(lengths[lengths[:, 0] == k, 1].tolist()) for k in (0, 1))
        self.path_lengths = sorted(self.path_lengths)

    @staticmethod
    def write(rules: Sequence[Rule], folder: str) -> list[str]:
        """Writes the rules (keys unique) and gives the files, whose names begin alike."""
        keyed = {(h + "\n" + p).encode(): a for h, p, a in rules}
        size = sum(len(k) + len(a) + 17 for k, a in keyed.items())
        if size > MAX_RULE_BYTES:
            raise ValueError(f"rules take over {MAX_RULE_BYTES} bytes; use judge_by_join")
        ordered = sorted((xxhash.xxh64_intdigest(k), k) for k in keyed)
        strings = [k + b"\n" + keyed[k].encode() for _, k in ordered]
        lengths = {(i, len(x)) for h, p, _ in rules for i, x in enumerate((h, p))}
        arrays = {
            "digests": np.array([d for d, _ in ordered], np.uint64), "starts": np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)]).astype(np.int64),
            "strings": np.frombuffer(b"".join(strings) or b"\n", np.uint8), "lengths": np.array(sorted(lengths), np.int64).reshape(-1, 2),
        }
        name = os.path.join(folder, f"rules-{uuid.uuid4().hex}")
        for part, array in arrays.items():
            np.save(f"{name}-{part}.npy", array)
        return [f"{name}-{part}.npy" for part in arrays]

    def _string(self, place: int) -> bytes:
        return self.text[self.starts[place] : self.starts[place + 1]].tobytes()

    def _fields(self, place: int) -> tuple[str, str, str]:
        host, path, action = self._string(place).decode().split("\n")
        return host, path, action

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key, or -1: binary search of its digest, then comparison with the stored string."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.digests) == 0 or not keys:
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        place = np.searchsorted(self.digests, digests)
        for i in np.flatnonzero(self.digests[np.minimum(place, len(self.digests) - 1)] == digests).tolist():
            k = int(place[i])
            while k < len(self.digests) and self.digests[k] == digests[i]:
                stored = self._string(k)
                if stored[: stored.rindex(b"\n")] == keys[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def decide(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, action) of each (host, path), or Nones."""
        keys, owner = [], []
        for i, (host, path) in enumerate(urls):
            if not host and not path:
                continue
            beginnings = [path[:n] for n in self.path_lengths if n <= len(path)]
            start = 0
            while start >= 0:  # the host and what follows each of its dots
                if len(host) - start in self.host_lengths:
                    suffix = host[start:]
                    keys += [f"{suffix}\n{p}".encode() for p in beginnings]
                    owner += [i] * len(beginnings)
                start = host.find(".", start) + 1 or -1
        best: list[tuple] = [(-1, -1, None, None)] * len(urls)
        place = self.find(keys)
        for k in np.flatnonzero(place >= 0).tolist():
            host, path, action = self._fields(int(place[k]))
            best[owner[k]] = max(best[owner[k]], (len(host) + len(path), len(host), host + path, action))
        return [(b[2], b[3]) for b in best]


@lru_cache(maxsize=4)
def _index(prefix: str) -> DigestIndex:
    """A worker's index, mapped once."""
    return DigestIndex(prefix)


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict for every row."""
    context = pages.sparkSession.sparkContext
    folder = tempfile.mkdtemp(prefix="url-rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    files = DigestIndex.write(rules, folder)
    for file in files:
        context.addFile(file)
    name = os.path.basename(files[0]).removesuffix("-digests.npy")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(SparkFiles.get(f"{name}-digests.npy").removesuffix("-digests.npy"))
        for batch in batches:
            for part, _ in at.slices(batch, "url"):
                urls = [parts_of(u) for u in part.column(1).to_pylist()]
                found = index.decide(urls)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array([a or default for _, a in found], pa.string())],
                    ["page_id", "host", "path", "rule", "verdict"],
                )

    return pages.select("page_id", "url").mapInArrow(judged, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """The same for a table of rules (host, path, action) of any size: candidates meet the rules in a shuffle join on (host, path).

    Candidates are the suffixes of a host and beginnings of a path of lengths that rules have (one broadcast row; lengths are bounded by
    the longest rule's), and the distinct urls alone are joined. A url, or a rule, that many rows share is met once."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = pages.select("page_id", F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))
    sizes = rules.agg(F.collect_set(F.length("host")).alias("host_sizes"), F.collect_set(F.length("path")).alias("path_sizes"))
    fits = lambda c: lambda n: n <= F.length(c)
    ends = F.filter(F.transform(F.filter("host_sizes", fits("host")), lambda n: F.struct(n.alias("n"), F.concat(F.lit("."), F.col("host")).alias("w"))), lambda e: F.substring(e["w"], F.length(e["w"]) - e["n"], F.lit(1)) == ".")
    suffixes = F.transform(ends, lambda e: F.substring(e["w"], F.length(e["w"]) - e["n"] + 1, e["n"]))
    prefixes = F.transform(F.filter("path_sizes", fits("path")), lambda k: F.substring("path", F.lit(1), k))
    urls = split.select("host", "path").distinct().where("host <> '' or path <> ''").join(F.broadcast(sizes))
    tried = urls.select("host", "path", "path_sizes", F.explode(suffixes).alias("h")).select("host", "path", "h", F.explode(prefixes).alias("p"))
    known = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "action").dropDuplicates(["h", "p"])
    size = F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"), F.col("action"))
    best = tried.join(known, ["h", "p"]).groupBy("host", "path").agg(F.max(size).alias("best"))
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
