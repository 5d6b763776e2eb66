"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm import spelling

AZ = str.maketrans(spelling.UPPER, spelling.LOWER)


def edits(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slips=199):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {w: min((v for v in near[w] if n[v] >= 5 * n[w]), key=lambda v: (-n[v], v), default=None) for w in n}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def variants_of(words, rng):
    """Texts in which words occur at very different rates, with edits of edits."""
    rows, letters = [], "abcdeéßÿ÷z"
    for w in words:
        times, now = rng.choice([6, 30, 150, 700, 3000]), w
        while times >= 5:
            rows += [now] * times
            i, c = rng.randrange(len(now)), rng.choice(letters)
            now = rng.choice([now[:i] + now[i + 1 :], now[:i] + c + now[i:], now[:i] + c + now[i + 1 :]])
            times //= rng.choice([2, 5, 6, 25])
    rng.shuffle(rows)
    return [(i, " ".join(rows[at : at + 40]), "en", "a") for i, at in enumerate(range(0, len(rows), 40))]


def test_variants_against_brute_force(frame):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    docs = variants_of(words, rng)
    want = brute(docs)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] not in (None, r[2]) for r in want)
    got = rows_of(spelling.variants(frame(docs)))
    assert len(got) == len(set(got)) and set(got) == want
    assert set(rows_of(spelling.variants(frame(docs), slips=3))) == brute(docs, 3)


def test_every_single_edit_is_met(spark):
    words = ["abcdef", "bcdef", "abcde", "abXdef", "abcdeff", "Xabcdef", "abdcef", "abcXdef", "abcdeX", "aabcdef", "éabcdef", "ab", "abc", "xb"]
    n = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_words(n).collect()}
    assert got == {(a, b) for a in words for b in words if edits(a, b)}


def test_odd_texts(frame, odd):
    more = [*odd, *[(7, "ÉCOLE École xÉcoley naïveté NAÏVETÉ", "fr", "b")] * 6, (None, "strasse straße " * 9, None, None)]
    assert set(rows_of(spelling.variants(frame(more)))) == brute(more)
    docs = frame(more).withColumns({c: F.lit("x") for c in ("word", "n", "run", "form", "near", "gram")})
    assert set(rows_of(spelling.variants(docs))) == brute(more)


def test_empty_tables(frame):
    assert spelling.variants(frame([])).count() == 0
    assert spelling.variants(frame([(None, None, None, None), (1, "", "en", "a")])).count() == 0


def test_long_chains_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {r.root for r in spelling.followed(forms, 4).collect()} == {"w11"}
