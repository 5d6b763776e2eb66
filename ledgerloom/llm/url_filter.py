"""URL rules by Bloom filter cascades.

A rule is a host and a path prefix; it fits its host and all subdomains when the url's path starts with the prefix. The
possible keys of a url are each suffix of its host that has as many labels as some rule's host, with each prefix of its
path that is as long as some rule's path. The corpus's keys, all of them, are the universe. One cascade encodes the blocked keys, another the allowed ones:
level 1 is a Bloom filter of the listed keys, level 2 one of the universe's other keys that level 1 passes, level 3 one of
the listed keys that level 2 passes, and so on until nothing passes wrongly. A key is listed if and only if the first level
that rejects it is even, or no level does and their number is odd. That is exact for each key of the universe, so urls
are judged in one pass without a join.

Keys are known by 128 bits of hash. Level 1 is sized so that about as many other keys pass it as keys are listed, so each
level's size is bounded by the number of rules, not by the corpus.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import held
from ledgerloom.session import durable

#: Rules that one cascade may list. They and the filters made from them are broadcast: 16 bytes of key and at most
#: 1.44 * log2(universe / rules) bits of level 1 each, so under 200 MB at the bound. More rules are an error.
MAX_RULES = 5_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Cascade:
    """Filters of alternating levels; each is (bits, number of hashes)."""

    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key (two 64-bit halves) of the universe is listed."""
        found = np.full(len(a), len(self.levels) % 2 == 1)
        open_ = np.arange(len(a))
        for depth, level in enumerate(self.levels):
            passed = passes(level, depth, a[open_], b[open_])
            found[open_[~passed]] = depth % 2 == 1
            open_ = open_[passed]
        return found


def places(depth: int, k: int, size: int, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """The k bit positions of each key on a level."""
    with np.errstate(over="ignore"):
        salted = (a ^ np.uint64(depth + 1)) * MIX
        salted ^= salted >> np.uint64(29)
        for i in range(k):
            x = (salted + np.uint64(i) * (b | np.uint64(1))) * MIX
            yield (x ^ (x >> np.uint64(32))) % np.uint64(size)


def bloom(depth: int, a: np.ndarray, b: np.ndarray, rate: float) -> tuple[np.ndarray, int]:
    """A filter of the keys that passes others at about ``rate``."""
    k = max(1, round(-math.log2(rate)))
    size = -(-max(64, math.ceil(len(a) * k / math.log(2))) // 8) * 8
    bits = np.zeros(size, dtype=bool)
    for at in places(depth, k, size, a, b):
        bits[at] = True
    return np.packbits(bits), k


def passes(level: tuple[np.ndarray, int], depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits, k = level
    found = np.ones(len(a), dtype=bool)
    for at in places(depth, k, bits.size * 8, a, b):
        found &= (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return found


def key_halves(keys: Column) -> list[Column]:
    """Two arrays of hashes of an array of keys."""
    return [F.transform(keys, lambda k: F.xxhash64(k)).alias("a"), F.transform(keys, lambda k: F.xxhash64(k, F.lit("b"))).alias("b")]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the
    path goes on to ``?``, ``#`` or the end. A url that is null or has no ``://`` has both empty."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def split_rule(rule: str) -> tuple[str, str]:
    """``example.com/de/`` is the host ``example.com`` and the path ``/de/``; without a slash every path fits."""
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at], rule[at:])


def candidates(host: Column, path: Column, rules: list[str]) -> Column:
    """Every key of a url, longest first (of keys of one length, the one with the longer host)."""
    split = [split_rule(r) for r in rules]
    lengths = sorted({len(p) for _, p in split})
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in sorted({h.count(".") + 1 for h, _ in split})]))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.struct(
        (-(F.length(s) + n)).alias("size"), (-F.length(s)).alias("host"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")
    ))))
    return F.transform(F.array_sort(keys), lambda x: x["key"])


def _arrays(rows: list, *names: str) -> list[np.ndarray]:
    return [np.array([r[n] for r in rows], dtype=np.int64).view(np.uint64) for n in names]


def build(spark: SparkSession, universe: DataFrame, rules: list[str]) -> Cascade:
    """The cascade that tells ``rules`` from every other key of ``universe`` (columns a, b, distinct)."""
    rules = sorted(set(rules))
    if len(rules) > MAX_RULES:
        raise ValueError(f"a cascade lists at most {MAX_RULES} rules, not {len(rules)}")
    if not rules:
        return Cascade([])
    hashed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rules)), "array<string>")).alias("k"))
    a, b = _arrays(hashed.select(F.xxhash64("k").alias("a"), F.xxhash64("k", F.lit("b")).alias("b")).collect(), "a", "b")
    others = max(universe.count(), 1)
    first = bloom(0, a, b, min(0.5, len(rules) / others))
    shipped = spark.sparkContext.broadcast((first, set(zip(a.tolist(), b.tolist(), strict=True))))

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, listed = shipped.value
        for frame in frames:
            x, y = (frame[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
            passed = np.flatnonzero(passes(level, 0, x, y))
            wrong = [i for i in passed if (int(x[i]), int(y[i])) not in listed]
            yield frame.iloc[wrong]

    # about as many as there are rules, by the size of level 1
    wrong = _arrays(universe.mapInPandas(through, "a long, b long").collect(), "a", "b")
    levels, inside, outside = [first], wrong, (a, b)
    while len(inside[0]):
        if len(levels) > 200:
            raise ValueError("two keys share all 128 bits of their hash")
        depth = len(levels)
        levels.append(bloom(depth, *inside, 0.5))
        passed = passes(levels[-1], depth, *outside)
        inside, outside = [x[passed] for x in outside], inside
    return Cascade(levels)


def judge(pages: DataFrame, block: list[str], allow: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; of the rules that fit the longest wins (by characters, then by host; a
    rule in both lists blocks). Where none fits, rule is null and the verdict is ``default``: what is not listed passes.

    Null urls and urls without ``://`` have an empty host, which no rule fits. Other columns are carried along; columns of
    ``pages`` named like a result are replaced. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    located = held(pages, url=F.col(url)).select("row", host.alias("host"), path.alias("path"))
    carried = [F.col(f"row.`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    if not block and not allow:
        return located.select(*carried, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = located.withColumn("keys", candidates(F.col("host"), F.col("path"), [*block, *allow]))
    hashed = keyed.select("*", *key_halves(F.col("keys")))
    universe = durable(
        hashed.select(F.explode(F.arrays_zip("a", "b")).alias("k")).select("k.*").distinct(),
        "url-keys",
    )
    # the levels, not the cascades: a broadcast instance of a class needs the package where it is read
    shipped = spark.sparkContext.broadcast((build(spark, universe, block).levels, build(spark, universe, allow).levels))

    @F.pandas_udf("int")
    def winner(a: pd.Series, b: pd.Series) -> pd.Series:
        """1-based place of the longest listed key, negative when it is allowed, 0 without one."""
        blocked, allowed = (Cascade(levels) for levels in shipped.value)
        counts = np.array([len(x) for x in a], dtype=np.int64)
        if not counts.sum():
            return pd.Series(np.zeros(len(a), dtype=np.int32))
        x, y = (np.concatenate([np.asarray(v, dtype=np.int64) for v in s]).view(np.uint64) for s in (a, b))
        stops, passed = blocked.listed(x, y), allowed.listed(x, y)
        starts = np.cumsum(counts) - counts
        place = np.arange(len(x)) - np.repeat(starts, counts) + 1
        hit = np.flatnonzero(stops | passed)
        rows = np.repeat(np.arange(len(a)), counts)[hit]
        rows, first = np.unique(rows, return_index=True)
        out = np.zeros(len(a), dtype=np.int32)
        out[rows] = np.where(stops[hit[first]], place[hit[first]], -place[hit[first]])
        return pd.Series(out)

    won = hashed.withColumn("won", winner("a", "b"))
    fits = F.col("won") != 0
    return won.select(
        *carried,
        "host",
        "path",
        F.when(fits, F.get("keys", F.abs("won") - 1)).alias("rule"),
        F.when(fits, F.when(F.col("won") > 0, "block").otherwise("allow")).otherwise(default).alias("verdict"),
    )
