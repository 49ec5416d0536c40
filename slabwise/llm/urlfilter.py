"""URL filtering by a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot, so that a rule's
host and all its subdomains are the interval of keys that start with the rule's
key. Rules and urls are dealt by ranges of that key, sorted together, and one sweep
keeps the stack of rules whose interval is open.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, shuffle_width, slices

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of urls that are looked at, for each range, to place the ranges' borders.
SAMPLED_PER_RANGE = 40


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """`blog.example.net` -> `net.example.blog.`; the empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class _Level:
    """The rules of one host, open while the sweep is within the host's interval."""

    def __init__(self, key: str):
        self.key, self.paths, self.known, self.sizes = key, {}, set(), []  # sizes: the paths' lengths, ascending

    def add(self, path: str, verdict: str, rule: str) -> None:
        if self.paths.get(path, ("allow",))[0] != "block":
            self.paths[path] = (verdict, rule)
            if len(path) not in self.known:
                self.known.add(len(path))
                insort(self.sizes, len(path))

    def fitting(self, path: str):
        for n in reversed(self.sizes):
            if n <= len(path) and (hit := self.paths.get(path[:n])):
                return hit
        return None


def _sweep(batches):
    """Rows come sorted by (rng, key, rules first). The stack holds the nested hosts that contain the current key."""
    rng, stack = None, []
    for batch in batches:
        rows = batch.to_pydict()
        verdicts, rules, at = [], [], []
        for i, (r, key, is_url) in enumerate(zip(rows["rng"], rows["key"], rows["is_url"])):
            if r != rng:
                rng, stack = r, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if not is_url:
                if not stack or stack[-1].key != key:
                    stack.append(_Level(key))
                stack[-1].add(rows["path"][i], rows["verdict"][i], rows["rule"][i])
                continue
            best = None
            for level in reversed(stack):
                hit = level.fitting(rows["path"][i])
                if hit and (best is None or len(hit[1]) > len(best[1])):
                    best = hit
            verdicts.append(best[0] if best else None)
            rules.append(best[1] if best else None)
            at.append(i)
        picked = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [picked.column("id"), picked.column("host"), picked.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            names=["id", "host", "path", "rule", "verdict"],
        )


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url by the longest rule that fits it.

    rules has (host, path, verdict), verdict block or allow. A rule fits its host and
    that host's subdomains if the url's path starts with the rule's path. Longest is
    by the length of host + path, then by the longer host; of equal rules that
    disagree, block wins. A rule with a null host or verdict is ignored, a null path
    is empty. A url that is null or has no `://` has an empty host and path and can
    only fit a rule with an empty host. Repeated rows and null ids are judged each.

    Returns (id_col, host, path, rule, verdict, matched); verdict is `default` where no
    rule fits. Borders of the key ranges come from a bounded sample and include the
    id's hash, so one host with most urls is spread over many ranges; a rule is sent
    to each range its interval meets.
    """
    ranges = shuffle_width(urls.sparkSession)
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    rows = rows.withColumn("salt", F.hex(F.xxhash64("id", "path")))
    # about as many rows as wanted, whatever the number of tasks; copies of a row can't be told apart by a border
    share = SAMPLED_PER_RANGE * ranges / max(1, urls.count())
    sample = rows.select("key", "salt").filter(hashed_share(share, "salt")).distinct().collect()
    points = sorted((r.key, r.salt) for r in sample)
    borders = sorted(set(points[SAMPLED_PER_RANGE // 2 :: SAMPLED_PER_RANGE][1:]))
    id_type = rows.schema["id"].dataType.simpleString()

    def deal(batches):
        for batch in batches:
            keys, salts = batch.column("key").to_pylist(), batch.column("salt").to_pylist()
            rng = pa.array([bisect_right(borders, p) for p in zip(keys, salts)], pa.int32())
            yield pa.RecordBatch.from_arrays([rng, *(batch.column(c) for c in ("id", "host", "path", "key"))], names=["rng", "id", "host", "path", "key"])

    def deal_rules(batches):
        for batch in slices(batches):
            to, at = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                # from the range of the interval's least key to that of its greatest
                met = range(bisect_right(borders, (key, "")), bisect_right(borders, (key + "\U0010ffff", "")) + 1)
                to += met
                at += [i] * len(met)
            sent = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(sent.column(c) for c in ("key", "path", "verdict", "rule"))], names=["rng", "key", "path", "verdict", "rule"])

    dealt = rows.select("id", "host", "path", "key", "salt").mapInArrow(deal, f"rng int, id {id_type}, host string, path string, key string")
    known = rules.filter("host is not null and verdict is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    known = known.select(host_key(F.col("host")).alias("key"), "path", "verdict", F.concat("host", "path").alias("rule"))
    sent = known.mapInArrow(deal_rules, "rng int, key string, path string, verdict string, rule string")
    merged = dealt.withColumns({"is_url": F.lit(True), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}).unionByName(
        sent.withColumns({"is_url": F.lit(False), "id": F.lit(None).cast(id_type), "host": F.lit(None).cast("string")})
    )
    swept = (
        merged.repartitionById(max(ranges, len(borders) + 1), "rng")
        .sortWithinPartitions("rng", "key", "is_url", "path")
        .mapInArrow(_sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    )
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), F.col("rule").isNotNull().alias("matched"))
