"""Archives, url rules and exact top-k search."""

import gzip
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mtree, url_filter, warc

# archives -----------------------------------------------------------------------------------------------------------


def odd_pages(spark):
    big, rng = "<p>é\r\n\r\nWARC/1.1\r\n" * 60_000, random.Random(1)
    rows = [
        (1, "http://a/", big),
        (2, "http://b/\r\nX: 1", big),
        (3, None, None),
        (4, "", ""),
        (5, "u", "short"),
        (6, "u", "short"),
        (None, "n", "z" * 1500),
        (7, "n", "z" * 1500),
        (8, "é", "é" * 500),
        (9, "é", "é" * 500),
        (10, "é", "é" * 499),
        (11, "é", "é" * 499),
        (-3, "m", "\r\n\r\n"),
        *[(100 + i, f"http://x/{i}", "".join(rng.choice("ab\r\n") for _ in range(rng.randint(0, 3000)))) for i in range(50)],
    ]
    return rows, spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "page_id long, url string, html string, payload int")


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 300_000)
    rows, pages = odd_pages(spark)
    newest = defaultdict(list)
    for p, _, h in rows:
        newest[h or ""].append(p)
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        top = max((x for x in newest[h or ""] if x is not None), default=None)
        revisit = len(body) >= 1000 and len(newest[h or ""]) > 1 and p != top
        want.append((str(p), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive(pages.limit(0)).count() == 0


def test_chunks_carry_incremental_digests(spark, tmp_path):
    rows, pages = odd_pages(spark)
    manifest = warc.write(warc.plan(pages), str(tmp_path / "w"))
    chunks = warc.read(manifest, chunk=100_000).collect()
    assert max(len(c.payload) for c in chunks) == 100_000
    records = defaultdict(list)
    for c in chunks:
        records[c.path, c.record].append(c)
    assert len(records) == len(rows) == sum(r.records for r in manifest.collect())
    for parts in records.values():
        parts.sort(key=lambda c: c.chunk_no)
        assert [c.chunk_no for c in parts] == list(range(len(parts))) and [c.last for c in parts] == [False] * (len(parts) - 1) + [True]
        whole = b""
        for c in parts:
            whole += c.payload
            assert c.bytes_so_far == len(whole) and c.sha1_so_far == hashlib.sha1(whole).hexdigest()
        if parts[0].record_type == "response":
            assert parts[-1].sha1_so_far == parts[0].header_digest


def test_archives_are_plain_warc(spark, tmp_path):
    _, pages = odd_pages(spark)
    manifest = warc.write(warc.plan(pages), str(tmp_path / "w")).collect()
    data = b"".join(gzip.open(r.path).read() for r in manifest)
    assert data.count(b"WARC-Record-ID: ") == pages.count()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_a_cut_archive_is_an_error(spark, tmp_path):
    _, pages = odd_pages(spark)
    path = warc.write(warc.plan(pages).coalesce(1), str(tmp_path / "w")).first().path
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) // 2])
    with pytest.raises(EOFError):
        for _, body in warc.records(warc.Stream(path)):
            for _ in body:
                pass


# url rules ----------------------------------------------------------------------------------------------------------


def brute_judge(url, block, allow):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rules, verdict in ((block, "block"), (allow, "allow")):
        for r in rules:
            h, p = url_filter.split_rule(r)
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(r), len(h), verdict == "block", r, verdict))
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_rules(spark):
    rng = random.Random(6)
    parts = ["a", "b", "net", "org", "Example", "com", "é", ""]
    urls = [None, "", "no scheme", "http://", "://", "http://net", "http://NET/", "x://a.net?q=/", "x://a.net#/", "http://xnet/", "a://b://net/", "http://net/\nb", "//a.net/"]
    urls += [f"{rng.choice(['http', 'https', ''])}://{'.'.join(rng.choice(parts) for _ in range(rng.randint(1, 5)))}/{'/'.join(rng.choice(parts) for _ in range(rng.randint(0, 4)))}{rng.choice(['', '?x', '#y'])}" for _ in range(600)]
    urls += ["http://" + "a." * 20_000 + "net/x", "http://net/" + "y" * 100_000]
    block, allow = ["net/", "example.com/a/", "b.net/a", "com", "org/b/"], ["a.net/", "a.com/b", "example.com/a/b", "org/b/"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, keys long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, block, allow).collect()}
    assert got == {i: brute_judge(u, block, allow) for i, u in enumerate(urls)}
    assert {r.keys for r in url_filter.judge(pages, block, allow).collect()} == set(range(len(urls)))
    assert {r.verdict for r in url_filter.judge(pages, [], []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), block, allow).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.net/" for i in range(6000)]
    rules = keys[::7]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    universe = df.select(F.xxhash64("k").alias("a"), F.xxhash64("k", F.lit("b")).alias("b"))
    cascade = url_filter.build(spark, universe, rules)
    rows = df.select("k", F.xxhash64("k").alias("a"), F.xxhash64("k", F.lit("b")).alias("b")).collect()
    a, b = (np.array([r[n] for r in rows], dtype=np.int64).view(np.uint64) for n in ("a", "b"))
    assert len(cascade.levels) > 1
    assert {r.k for r, x in zip(rows, cascade.listed(a, b), strict=True) if x} == set(rules)


# top-k --------------------------------------------------------------------------------------------------------------


def brute_top(vectors, queries, k):
    width = max((len(v) for _, v in vectors), default=0)
    pad = lambda v: [*v, *[0] * (width - len(v))]
    out = set()
    for q, v in queries:
        scores = sorted((-sum(x * y for x, y in zip(pad(v), pad(w), strict=True)), i) for i, w in vectors if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "one", "few", "huge", "ragged"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(mtree, "TREE", 64), monkeypatch.setattr(mtree, "LEAF", 8), monkeypatch.setattr(mtree, "SAMPLE", 40)
    monkeypatch.setattr(mtree, "BLOCK", 7), monkeypatch.setattr(mtree, "BLOCKS_A_GROUP", 2)
    rng = random.Random(8)
    vectors = {
        "random": [(i, [rng.randint(-60, 60) for _ in range(6)]) for i in range(400)],
        "ties": [(i, [1, 2, 3]) for i in range(300)] + [(300 + i, [rng.randint(0, 1) for _ in range(3)]) for i in range(100)],
        "one": [(0, [5, 5])],
        "few": [(i, [i, -i]) for i in range(5)],
        "huge": [(i, [rng.randint(-(2**29), 2**29) for _ in range(4)]) for i in range(120)],
        "ragged": [(i, [rng.randint(-9, 9) for _ in range(rng.randint(0, 4))]) for i in range(90)],
    }[kind]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<bigint>")
    df = df.unionByName(spark.createDataFrame([(None, [1, 1]), (999, None)], df.schema))
    got = mtree.top_k(df, df.filter("vec_id % 20 = 0"), k=10).collect()
    assert {tuple(r) for r in got} == brute_top(vectors, [v for v in vectors if v[0] % 20 == 0], 10)


def test_top_k_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, vector array<bigint>")
    assert mtree.top_k(df, df).count() == 0
    one = spark.createDataFrame([(1, [1])], df.schema)
    assert mtree.top_k(one, df).count() == 0 and mtree.top_k(df, one).count() == 0


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [0.5, -0.01]), (2, None), (3, [nan]), (4, [inf]), (5, [1.0, None]), (6, [])], "id long, v array<float>")
    got = {r.id: r.q for r in df.filter(mtree.usable(F.col("v"))).select("id", mtree.quantised(F.col("v")).alias("q")).collect()}
    assert got == {1: [32, -1], 6: []}


def test_search_skips_most_of_clustered_vectors():
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 1000, (20, 8))
    v = np.rint(np.concatenate([c + rng.normal(0, 1, (200, 8)) for c in centers])).astype(np.int64)
    space = mtree.Space(8, float((v * v).sum(axis=1).max()), True)
    import pandas as pd

    pages = pd.DataFrame(mtree.build(0, np.arange(len(v)), v, space), columns=[c.split()[0] for c in mtree.PAGES.split(", ")])
    seen, whole = [], mtree.Space.scores
    space_scores = lambda self, q, x: (seen.append(q.shape[0] * x.shape[0]), whole(self, q, x))[1]
    mtree.Space.scores = space_scores
    try:
        best = mtree.walk(pages, np.array([0]), v[:1], np.array([-np.inf]), 5, space)
    finally:
        mtree.Space.scores = whole
    scores = v @ v[0]
    scores[0] = np.iinfo(np.int64).min
    assert list(best.score) == sorted(scores, reverse=True)[:5] and sum(seen) < len(v) / 2
