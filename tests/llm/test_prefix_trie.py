"""The conversation trie against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        own_words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * own_words
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def talks():
    """Conversations with few openings, equal ones, one long one, gaps, ties, nulls and negative ids."""
    rng, rows = random.Random(4), []
    for c in [*range(-45, 160), 10_000_000_019]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi  there\x0byou", "", None, "  ", f"own {c}"])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(5)]
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(900)]
    rows += [(400, None, "user", "first"), (400, 1, "user", "b"), (400, 1, "user", "a"), (400, 1, "user", "a"), (None, 1, "user", "x")]
    rng.shuffle(rows)
    return rows


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_trie_against_brute_force(spark, talks, monkeypatch):
    df = spark.createDataFrame(talks, SCHEMA).repartition(7)
    want = brute(talks)
    got = rows_of(prefix_trie.shared_prefixes(df))
    assert len(got) == len(want) and set(got) == want
    # small pieces and blocks: prefixes, sums and the list cross many of them
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rebuilt, convs = prefix_trie.with_shared_heads(prefix_trie.turns_of(df))
    assert set(rows_of(prefix_trie.trie(rebuilt, convs, bits=3))) == want


def test_clashing_columns_and_empty_tables(spark, talks):
    few = talks[:60]
    df = spark.createDataFrame(few, SCHEMA).withColumns({c: F.lit("x") for c in ("pos", "depth", "p1", "words", "idx", "n", "h", "base", "_g")})
    assert set(rows_of(prefix_trie.shared_prefixes(df))) == brute(few)
    assert prefix_trie.shared_prefixes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.shared_prefixes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    # conversation 1 takes all turns from 0, which has none
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert rows_of(prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA))) == list(brute(rows))
    assert brute(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 200_000), (2, 0, "user", "word " * 200_000), (2, 1, None, "x")]
    assert set(rows_of(prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)
