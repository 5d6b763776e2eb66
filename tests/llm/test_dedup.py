"""Exact and near duplicates, boilerplate lines."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import components, exact_dedup, line_dedup, simhash

BLANKS = r"[\x20\x09-\x0D]+"


def plain(text):
    return re.sub(BLANKS, " ", text or "")


def exact_classes(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[plain(t)].append(d)
    return groups


def test_exact_duplicates(frame, odd):
    got = exact_dedup.duplicates(frame(odd)).collect()
    groups = exact_classes(odd)
    assert len(got) == len(odd)
    least = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = defaultdict(int)
    for r in got:
        t = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (least[t], len(groups[t]))
        kept[t] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_drop_keeps_columns_and_one_row_a_class(frame, odd):
    docs = frame(odd)
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(plain(r.text) for r in rows) == sorted(exact_classes(odd))
    assert {r["_key"] for r in rows} == {"k"} and {r.row for r in rows} == {1}


@pytest.mark.parametrize("fn", [exact_dedup.duplicates, exact_dedup.drop_duplicates, simhash.near_duplicates, simhash.drop_near_duplicates])
def test_empty_table(frame, fn):
    assert fn(frame([])).count() == 0


def test_only_nulls(frame):
    assert simhash.drop_near_duplicates(frame([(None, None, None, None)] * 3)).count() == 1
    assert exact_dedup.drop_duplicates(frame([(None, None, None, None)] * 3)).count() == 1


def test_filter_round_trip_and_lossless_merge(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 5000, dtype=np.int64)
    values = np.concatenate([values, values[:700], values[:100], np.repeat(values[:1], 20_000)]) >> 11  # 52 bits of 53
    df = spark.createDataFrame([(int(v),) for v in rng.permutation(values)], "fp long").repartition(7)
    merged = exact_dedup.filters(df, 32)
    got = {r.fp: r.n for r in exact_dedup.repeated(merged, 32).collect()}
    keys, counts = np.unique(values, return_counts=True)
    assert got == {int(k): int(c) for k, c in zip(keys, counts, strict=True) if c > 1}
    total = sum(exact_dedup.unpacked(*r[1:])[2].sum() for r in merged.collect())
    assert total == len(values)


def test_a_shared_fingerprint_is_parted_by_bytes(spark, frame, monkeypatch):
    monkeypatch.setattr(exact_dedup, "layout", lambda rows: (6, 1))  # 22 bits: some of the texts must collide
    rows = [(i, f"text {i}", None, None) for i in range(6000)] + [(9000, "text  5", None, None)]
    got = {r.doc_id: r for r in exact_dedup.duplicates(frame(rows)).collect()}
    assert sum(not r.kept for r in got.values()) == 1
    assert (got[9000].keep_id, got[9000].group_size, got[5].group_size, got[6].group_size) == (5, 2, 2, 1)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, budget=2):
    """The smallest id of each row's component."""
    roots = brute_roots(fps, budget)
    least = {}
    for r, d in zip(roots, ids, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(r) for r in roots]


def brute_roots(fps, budget=2):
    f = np.array(fps, dtype=np.uint64)
    group = list(range(len(f)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= budget):
            a, b = find(i), find(int(j))
            group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_near_duplicates(frame, odd):
    fps = [brute_fingerprint(t) for _, t, *_ in odd]
    want = sorted(zip([str(d) for d, *_ in odd], [f"{f:016x}" for f in fps], map(str, brute_components([d for d, *_ in odd], fps)), strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame(odd)).collect())
    assert got == want


def test_near_drop(frame, odd):
    docs = frame(odd)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    fps = [brute_fingerprint(t) for _, t, *_ in odd]
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == len(set(brute_roots(fps)))
    assert set(kept) == set(brute_components([d for d, *_ in odd], fps))


@pytest.mark.parametrize("page", [16, 4096])
def test_trie_join_finds_every_link(spark, monkeypatch, page):
    monkeypatch.setattr(simhash, "PAGE", page)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for b in base[:60]:  # chains and dense groups
        for _ in range(6):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {0, 1, 2**64 - 1, 2**63}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(nodes)).collect()}
    label = [roots.get(int(x), int(x)) for x in signed]
    want = brute_components(list(range(len(fps))), fps)
    assert len(set(label)) == len(set(want)) == len(set(zip(label, want, strict=True)))


def test_walk_yields_each_pair_once(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(4)
    a = np.unique(np.concatenate([rng.integers(0, 2**63, 200).astype(np.uint64), np.arange(300, dtype=np.uint64)]))
    pairs = [(int(i), int(j)) for x, y in simhash.walk(a, a, True, 0, 2) for i, j in zip(x, y, strict=True)]
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if np.bitwise_count(a[i] ^ a[j]) <= 2}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("shape", ["chain", "star", "cliques", "none"])
def test_components(spark, shape):
    edges = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(0, i) for i in range(1, 300)] + [(299, 500)],
        "cliques": [(g * 100 + i, g * 100 + j) for g in range(5) for i in range(12) for j in range(i)] + [(7, 7)],
        "none": [],
    }[shape]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        whole = want[a] | want[b]
        for x in whole:
            want[x] = whole
    assert got == {x: min(s) for x, s in want.items() if min(s) != x}


def test_line_dedup(frame, odd):
    shared = "All rights reserved."
    rows = [*odd, *[(100 + i, f"own {i}\n{shared if i % 2 else '  All  rights reserved. '}\n\nend", None, f"site{i % 5}") for i in range(20)], (200, f"{shared}", None, None)]
    sites = defaultdict(set)
    for _, t, _, s in rows:
        for line in (t or "").split("\n"):
            sites[plain(line).strip(" ")].add(s)
    bad = {x for x, s in sites.items() if x and len(s) >= 4}
    assert shared in bad
    want = []
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if plain(x).strip(" ") not in bad]
        want.append((str(d), None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    got = [(str(r.doc_id), r.text, r.n_lines, r.removed_lines) for r in line_dedup.clean(frame(rows), 4).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.clean(frame([]), 4).count() == 0


def test_line_sketches_agree_with_exact_counts_around_the_threshold(spark):
    rows = [(line, 0, f"s{i}") for line in range(60) for i in range(170 + line) for _ in range(2)]
    lines = spark.createDataFrame(rows, "a long, b long, site string")
    assert sorted(r.a for r in line_dedup.boilerplate(lines, 200, 6).collect()) == list(range(30, 60))


@pytest.mark.parametrize("local", [0, 3, 1 << 18])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)]
    label = list(range(120))
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: x for i, x in enumerate(label) if i != x}
