"""Language labels, mixing, token ids, shards and the pipeline."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from ledgerloom.llm import kd_shards, langid, mixing, subwords
from tests.llm.test_dedup import plain
from tests.llm.test_jaccard_join import brute_kept

SF = "/root/testdata/sf0.01"


# language -----------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    right = [r.lang == r.lang_pred for r in got if r.held_out]
    assert np.mean(right) >= 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(frame, odd):
    got = langid.identify(frame(odd)).collect()
    assert len(got) == len(odd)
    letters = {str(d): any(c.isalpha() for c in t or "") for d, t, *_ in odd if d is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred != "und") == letters[str(r.doc_id)]
            assert r.lang_pred in ("und", "en", "fr", "de", "ru") and (r.score == 0) == (r.lang_pred == "und")
    assert langid.identify(frame([])).count() == 0
    assert [r.lang_pred for r in langid.identify(frame([(2, "abc", None, None)])).collect()] == ["und"]


def test_drop_unidentified_keeps_columns(frame, odd):
    docs = frame(odd)
    got = langid.drop_unidentified(docs)
    assert got.columns == docs.columns and {r.found for r in got.collect()} == {7}
    assert {r.doc_id for r in got.collect()}.isdisjoint({1, 2, 3, 11})


def brute_labels(scores, switch):
    """The best of all label sequences."""
    best, found = -np.inf, None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[i, x] for i, x in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))
        if value > best + 1e-9:
            best, found = value, path
    return best, found


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(2)
    for _ in range(40):
        scores = rng.normal(0, 3, (rng.integers(1, 7), 3)).astype(np.float32)
        scores[rng.random(scores.shape) < 0.1] = -np.inf
        scores[np.isneginf(scores).all(axis=1)] = 0
        got = langid.labels(scores, 2.0)
        value = sum(scores[i, x] for i, x in enumerate(got)) - 2.0 * np.count_nonzero(np.diff(got))
        assert value == pytest.approx(brute_labels(scores, 2.0)[0], abs=1e-4)


def test_scores_do_not_depend_on_the_batch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = langid.fit(docs)
    texts = [r.text for r in docs.collect()]
    together = {row: (part.stop - part.start, list(own)) for row, _, part, own in langid.scored(model, texts)}
    for i, t in enumerate(texts):
        for _, _, part, own in langid.scored(model, [t]):
            assert together[i] == (part.stop - part.start, list(own))


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {}
    for r in docs.filter("length(text) between 400 and 3000").collect():
        by.setdefault(r.lang, r.text)
    model = langid.fit(docs)
    mixed = spark.createDataFrame([(by["en"] + " " + by["fr"] + " " + by["en"],)], "text string")
    spans = mixed.select(langid.spans(model, mixed, mixed["text"])).first()[0]
    assert [s.lang for s in spans] == ["en", "fr", "en"]
    assert sum(s.words for s in spans) == len(re.findall(r"[^\W\d_]+", mixed.first().text))


# mixing -------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        target = [3 * sizes[i] if i in capped else rest * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))]
        above = {i for i in free if target[i] > 3 * sizes[i]}
        if not above:
            return target
        capped |= above


def brute_seats(targets, seats):
    given = [0] * len(targets)
    for _ in range(seats):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


def test_apportionment():
    rng = random.Random(3)
    for _ in range(60):
        targets = [rng.choice([0.0, 1.0, 1.0, rng.uniform(0, 50), 7.0]) for _ in range(rng.randint(1, 12))]
        if sum(targets):
            for seats in (0, 1, 2, 7, 40):
                assert list(mixing.apportion(np.array(targets), seats)) == brute_seats(targets, seats)


def test_shards_add_up():
    sources = mixing.source_table([("a", 5000), ("b", 300), (None, 900)])
    rows = mixing.shard_quotas(sources, 7)
    assert all(r["blocks"] >= 0 for r in rows)
    for s in sources:
        assert sum(r["blocks"] for r in rows if r["source"] == s["source"]) == s["quota"]
    totals = Counter()
    for r in rows:
        totals[r["shard"]] += r["blocks"]
    assert max(totals.values()) - min(totals.values()) <= 1


def test_mix(frame, odd):
    got = mixing.mix(frame(odd)).collect()
    again = mixing.mix(frame(odd).repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(odd)
    sizes = defaultdict(int)
    for _, t, _, s in odd:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, brute_targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.01, abs=2)
    assert mixing.mix(frame([])).count() == 0
    assert [(r.size, r.taken, r.target) for r in mixing.mix(frame([(1, None, None, None)])).collect()] == [(0, 0, 0.0)]


def test_mixed_documents_keep_columns(frame, odd):
    docs = frame(odd)
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns and {r.mark for r in got.collect()} == {5}
    assert mixing.mix_documents(frame([])).count() == 0


def test_source_table_needs_no_python_workers(frame, odd):
    assert "ExistingRDD" not in mixing.mix(frame(odd))._jdf.queryExecution().toString()


# token ids ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=subwords.MODEL)


def test_ids_are_the_librarys(frame, odd, library):
    rows = {(r.doc_id, r.decoded): r for r in subwords.coded(frame(odd)).collect()}
    assert len(rows) == len({(d, t) for d, t, *_ in odd})
    for d, t, *_ in odd:
        if t is None:
            assert rows[(d, None)].ids is None and rows[(d, None)].n_ids is None
        else:
            r = rows[(d, t.replace("▁", " "))]
            assert r.ids == library.encode(t) and r.n_ids == len(r.ids)
    assert subwords.coded(frame([])).count() == 0


def test_memory_of_segments_is_bounded(library, monkeypatch):
    monkeypatch.setattr(subwords, "MEMO", 10)
    coder = subwords.Coder(subwords.Pieces(subwords.model_bytes()))
    for i in range(60):
        text = f"word{chr(97 + i % 26)}{chr(97 + i % 7)} and others"
        assert coder.encode(text).tolist() == library.encode(text)
        assert len(coder.memo) + len(coder.memo.old) <= 10


def test_random_texts(library):
    own, rng = subwords.Coder(subwords.Pieces(subwords.model_bytes())), random.Random(9)
    parts = ["a", "e", "the", " ", "  ", "\n", "\t", "é", "☃", "\U0001f600", "x", "11", "....", "ing", "\r", "日本", "_", "==", "a" * 40, " " * 30, "),", "\0"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = own.encode(text)
        assert list(ids) == library.encode(text)
        assert own.decode(ids) == text


def test_long_segments_are_committed_in_parts(library):
    own = subwords.Coder(subwords.Pieces(subwords.model_bytes()))
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(30_000))
    parts = list(own.stream("▁" + text))
    assert len(parts) > 50 and max(map(len, parts)) < 4000
    assert list(own.encode(text)) == library.encode(text)


def test_characters_without_pieces_are_committed_in_parts(library):
    own = subwords.Coder(subwords.Pieces(subwords.model_bytes()))
    text = "\U0001f600\u16a0" * 4000
    parts = list(own.stream(text))
    assert len(parts) > 50 and max(map(len, parts)) < 4000
    assert list(own.encode(text + "ab" * 600 + text)) == library.encode(text + "ab" * 600 + text)


def message(number, value):
    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])
    return bytes([number << 3 | 2]) + size(len(value)) + value


def test_unigram_model_against_all_segmentations():
    import struct

    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.4, "aba": -5.5, "▁a": -3.1, "bb": -5.1}
    data = message(1, message(1, b"<unk>") + b"\x18\x02")
    for p, score in pieces.items():
        data += message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", score))
    data += message(2, b"\x18\x01") + message(3, b"\x18\x01\x20\x00")
    own = subwords.Coder(subwords.Pieces(data))
    names = {i + 1: p for i, p in enumerate(pieces)}

    def best(text):
        if not text:
            return 0.0
        return max(pieces[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in pieces)

    long = "".join(random.Random(5).choice("ab") for _ in range(5000))
    parts = list(own.stream(long))
    own.pieces.longest = 1000
    whole = list(own.stream(long))
    assert len(parts) > 50 and len(whole) == 1 and b"".join(parts) == whole[0]
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 12)))
        ids = own.encode(text)
        assert sum(pieces[names[int(i)]] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))
        assert own.decode(ids) == text
    assert list(own.encode("axb")) == [7, 0, 3]


# shards -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards(frame, odd, shards):
    rows = [(1000 + i, "w " * (i % 90 + 1), "en" if i % 3 else None, f"s{i % 7}" if i % 5 else None) for i in range(3000)] + [o for o in odd if len(o[1] or "") < 1000]
    got = kd_shards.shard(frame(rows), shards=shards).collect()
    assert len(got) == len(rows)
    weight, slots = defaultdict(int), defaultdict(list)
    for r in got:
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(weight) == list(range(shards))
    mean = sum(weight.values()) / shards
    assert all(abs(w - mean) <= 0.1 * mean for w in weight.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == want


def test_shards_of_few_rows(frame):
    assert kd_shards.shard(frame([]), shards=24).count() == 0
    assert [(r.size, r.shard, r.slot) for r in kd_shards.shard(frame([(None, None, None, None)]), shards=24).collect()] == [(8, 0, 0)]
    same = kd_shards.shard(frame([(1, "same", "en", "a")] * 400), shards=4).collect()
    assert max(Counter(r.shard for r in same).values()) <= 130


def test_leaves_reach_the_target(frame):
    rows = [(i, "x" * 92, "en", f"s{i % 9}") for i in range(1000)]
    got = kd_shards.shard(frame(rows), target_bytes=10_000).collect()
    assert set(Counter(r.shard for r in got)) == set(range(10))


def test_small_groups_stay_together(frame):
    rows = [(i, f"text {i} " + "y" * (i % 50), "en", f"s{i % 9}") for i in range(2000)] + [(5000 + i, f"copy {i % 40}", "fr", f"s{i % 6}") for i in range(200)]
    shards = defaultdict(set)
    for r in kd_shards.shard(frame(rows), shards=6).collect():
        if r.doc_id >= 5000:
            shards[r.text_crc32].add(r.shard)
    assert len(shards) == 40 and all(len(s) == 1 for s in shards.values())


# pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, library, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90_000, None, "en", "src1", None), (90_001, "12 34 !!", "en", "src1", 8), (90_002, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    label = {r.doc_id: r for r in langid.identify(docs).collect()}
    left = [r for r in rows if label[r.doc_id].lang_pred != "und" and label[r.doc_id].score >= 0.5]
    assert {90_000, 90_001, 90_002} == {r.doc_id for r in rows} - {r.doc_id for r in left}
    first = {}
    for r in left:
        if plain(r.text) not in first or r.doc_id < first[plain(r.text)].doc_id:
            first[plain(r.text)] = r
    left = list(first.values())
    kept = set(brute_kept([(r.doc_id, r.text) for r in left]))
    left = [r for r in left if r.doc_id in kept]
    mix = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(left, docs.schema)).collect()}
    want = Counter()
    for r in left:
        m = mix[r.doc_id]
        want[r.doc_id] = int(np.floor(m.taken / m.size + 0.5))
    text = {r.doc_id: r.text for r in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == +want
    for r in got:
        assert r.ids == library.encode(text[r.doc_id]) and r.decoded == text[r.doc_id]
    taken = sum(mix[d].size * n for d, n in want.items())
    assert taken == pytest.approx(sum(m.taken for m in mix.values()), rel=0.05)


def test_stages_return_the_columns_of_documents(spark, frame, odd):
    docs = frame(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == frame(odd).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_stages_take_empty_tables(spark, frame):
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
