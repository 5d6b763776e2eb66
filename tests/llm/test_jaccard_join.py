"""The Jaccard join of shingle sets against brute force, and the near stage that uses it."""

import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import jaccard_join, simhash
from tests.llm.test_dedup import brute_fingerprint


def brute_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_groups(rows, width=5, num=4, den=5, empties=True):
    """A group number for each row: components at a similarity of num / den."""
    sets = [brute_set(t, width) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j] and (empties or sets[i]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def brute_kept(rows):
    """The least id of each component, nulls last."""
    least = {}
    for g, (d, *_) in zip(brute_groups(rows), rows, strict=True):
        least[g] = min(least.get(g, (True, 0)), (d is None, d or 0))
    return sorted((None if null else d for null, d in least.values()), key=str)


def brute_near_sets(rows):
    """(doc_id, n_shingles, component_id) of every row, as op11 has them."""
    group, least = brute_groups(rows, 3, 9, 10, empties=False), {}
    for g, (d, *_) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, (True, 0)), (d is None, d or 0))
    return sorted(((d, len(brute_set(t, 3)), None if least[g][0] else least[g][1]) for g, (d, t, *_) in zip(group, rows, strict=True)), key=str)


@pytest.fixture(scope="module")
def near():
    """Copies with words changed so that similarities lie on both sides of 0.8, chains, a dense group, a common passage."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], text(30)
    for n in (3, 5, 6, 12, 40, 60, 150, 400):
        base = text(n)
        rows.append(base)
        for changes in (0, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(changes * max(1, n // 150)):
                copy[rng.randrange(n)] = rng.choice(words)
            rows.append(copy)
    link = text(100)
    for _ in range(12):  # a chain: each near the one before
        link = link[4:] + text(4)
        rows.append(link)
    base = text(80)
    for i in range(60):
        rows.append([*base[:79], f"own{i}"])
    rows += [passage + text(rng.choice([2, 4, 30])) for _ in range(40)]
    rng.shuffle(rows)
    return [(i, " ".join(t), "en", "a") for i, t in enumerate(rows)]


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("short, block, worth", [(4, 8, 0.1), (1, 3, 2.0)])
def test_every_link_is_found(frame, near, monkeypatch, short, block, worth):
    """With many long lists and small blocks, and with one round of stars at most."""
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "WORTH", worth)
    want = brute_near_sets(near)
    assert len({c for *_, c in want}) < len(near) - 40
    assert rows_of(jaccard_join.near_sets(frame(near))) == want


@pytest.mark.parametrize("drop, short", [(jaccard_join.drop_similar, 64), (simhash.drop_similar, 4)])
def test_one_of_each_component_stays(frame, near, monkeypatch, drop, short):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    want = brute_kept(near)
    assert len(want) < len(near) - 60
    assert sorted((r.doc_id for r in drop(frame(near)).collect()), key=str) == want


def test_the_order_changes_no_result(frame, near, monkeypatch):
    monkeypatch.setattr(jaccard_join, "frequency_sketch", lambda docs, text, width: np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint32))
    assert rows_of(jaccard_join.near_sets(frame(near))) == brute_near_sets(near)


def test_dense_groups(frame, monkeypatch):
    """Copies of one text with a few own words each, whose pairs lie on both sides of the similarity: lists of all of them."""
    monkeypatch.setattr(jaccard_join, "SHORT", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    rng = random.Random(12)
    base, rows = [f"b{i}" for i in range(130)], []
    for i in range(150):
        copy = list(base[: rng.choice([110, 118, 124, 130])])
        for k in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}_{k}"
        rows.append((i, " ".join(copy), "en", "a"))
    want = brute_near_sets(rows)
    assert 3 < len({c for *_, c in want}) < 140
    assert rows_of(jaccard_join.near_sets(frame(rows))) == want


def test_sketch_counts_texts(frame, near):
    sketch = jaccard_join.frequency_sketch(frame(near).repartition(5), "text", 3)
    want = np.zeros_like(sketch)
    for _, t, *_ in near:
        np.add.at(want, jaccard_join._slots(jaccard_join.shingles(t, 3)), 1)
    assert (sketch == want).all() and sketch.max() > 30


def test_near_sets_of_odd_texts(frame, odd):
    assert rows_of(jaccard_join.near_sets(frame(odd))) == brute_near_sets(odd)
    assert jaccard_join.near_sets(frame([])).count() == 0
    assert rows_of(jaccard_join.near_sets(frame([(None, None, None, None), (3, " ", None, None), (2, "", None, None)]))) == [(2, 0, 2), (3, 0, 3), (None, 0, None)]


def test_drop_similar_of_odd_texts(frame, odd):
    docs = frame(odd)
    got = jaccard_join.drop_similar(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute_kept(odd)
    assert jaccard_join.drop_similar(frame([])).count() == 0
    assert jaccard_join.drop_similar(frame([(None, None, None, None)] * 3)).count() == 1


def test_pipeline_stage_drops_a_near_copy_of_many_bits(spark, frame):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:40], "x", *words[41:90], "y", *words[91:140], "z", *words[141:]])]
    assert (brute_fingerprint(texts[0]) ^ brute_fingerprint(texts[1])).bit_count() > 2
    assert [r.doc_id for r in corpus_pipeline.near(spark, frame([(i, t, "en", "a") for i, t in enumerate(texts)]), "").collect()] == [0]


def test_bins_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(6)
    ruled = 0
    for _ in range(400):
        n = int(rng.integers(1, 1500))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, n // 9 + 1).astype(np.uint64)]))
        left = jaccard_join.may_be_similar(jaccard_join.binned(a), jaccard_join.binned(b), len(a), len(b), 0.8)
        assert left or not jaccard_join.similar(a, b, 0.8)
        ruled += not left
    assert ruled > 20


def test_a_written_step_has_one_python_worker_a_task(spark, monkeypatch):
    """Texts are picked by one function and made into sets by another; in one task each would start a worker of its own."""
    plans, write = {}, jaccard_join.durable

    def noted(df, name="step"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(jaccard_join, "durable", noted)
    words = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join([*words[:50], words[50 + n % 10]])) for n in range(30)]
    kept = jaccard_join.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]
    assert [plans[n].count("ArrowEvalPython ") for n in ("jaccard-texts", "jaccard-sets")] == [1, 1]
