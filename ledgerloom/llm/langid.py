"""Language identification of whole texts, with the spans of mixed-language ones.

Words are runs of letters. A word's script (by fixed ranges of code points) narrows its candidates to the languages that were
seen in that script; each candidate scores the word by its character n-grams (1 to 4, with word edges), hashed into a table of
fixed size, by smoothed log-probabilities. A Viterbi pass over the words, with a penalty for each change of language, labels
them; runs of one label are spans. The text's language is the one with the most labelled letters.

Scoring runs over arrays of code points of many texts at once. Most texts never leave one language, which is certain when no
run of words gains more from another language than the changes cost; only the rest take the word-by-word pass.

The model is fitted on a bounded sample (``ROWS_A_LANGUAGE`` whole texts of each language, by hash) whose counts
are made by Spark; its size is fixed by the number of languages and ``TABLE`` and does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import held

TABLE = 1 << 16
ORDERS = (1, 2, 3, 4)
ROWS_A_LANGUAGE = 1500
MAX_LANGUAGES = 500
SWITCH = 12.0
SMOOTH = 0.5
UNKNOWN = "und"
PIECE = 1 << 20  # characters scored at a time

#: Unicode's ranges of code points for each script.
SCRIPTS: list[tuple[str, list[tuple[int, int]]]] = [
    ("latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("kana", [(0x3040, 0x30FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)]),
]
OTHER = len(SCRIPTS)  # letters of any other script

_chars: dict[str, np.ndarray] = {}


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case code point of a letter, 0 for others; the script. Made once in each worker."""
    if not _chars:
        lower = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                small = x.lower()
                lower[c] = ord(small) if len(small) == 1 else c
        script = np.full(0x110000, OTHER, dtype=np.uint8)
        for i, (_, ranges) in enumerate(SCRIPTS):
            for a, b in ranges:
                script[a : b + 1] = i
        _chars.update(lower=lower, script=script)
    return _chars["lower"], _chars["script"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, table places) of the n-gram that ends at each place of an array of words with a 0 before, between and after
    them; an n-gram that would reach over an edge takes the edge as its first character. Place 0 is left out by weight."""
    edge = points == 0
    hashed = np.zeros(len(points), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            # hashed: of the n - 1 characters before; it starts anew at each edge
            before = np.concatenate([[np.uint32(0)], hashed[:-1]]).astype(np.uint32)
            before[1:][edge[:-1]] = 0x5BD1
            hashed = (before * np.uint32(0x01000193)) ^ (points * np.uint32(0x9E3779B1))
            mixed = hashed ^ np.uint32(n * 0x27D4EB2F)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            yield n, ((mixed ^ (mixed >> np.uint32(13))) % np.uint32(TABLE)).astype(np.int64)


@dataclass
class Words:
    """Letters of some texts, with a 0 before each word and one at the end."""

    points: np.ndarray
    starts: np.ndarray  # place of each word's first letter
    lengths: np.ndarray
    script: np.ndarray  # of the word's first letter
    text: np.ndarray  # which text a word is of


def words_of(texts: list[np.ndarray]) -> Words:
    lower, scripts = char_tables()
    sizes = np.array([len(t) + 1 for t in texts])
    flat = np.zeros(int(sizes.sum()) + 1, dtype=np.uint32)
    ends = np.cumsum(sizes)
    for t, end in zip(texts, ends, strict=True):
        flat[end - len(t) : end] = t  # after a 0
    points = lower[flat]
    edge = points == 0
    keep = ~edge
    keep[1:] |= edge[1:] & ~edge[:-1]  # one 0 after a word
    keep[0] = True
    which = np.repeat(np.arange(len(texts)), sizes)
    first = np.flatnonzero(~edge[1:] & edge[:-1]) + 1
    place = np.cumsum(keep) - 1
    points = points[keep]
    starts = place[first]
    ends_at = np.flatnonzero((points[1:] == 0) & (points[:-1] != 0)) + 1
    return Words(points, starts, ends_at - starts, scripts[flat[first]], which[first])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # TABLE x languages, log-probabilities
    scripts: np.ndarray  # scripts x languages: 0, or minus infinity where a language does not use a script

    def word_scores(self, words: Words) -> np.ndarray:
        """Words x languages: mean log-probability of an n-gram order, summed over the word's letters and its end."""
        out = np.zeros((len(words.starts), len(self.languages)), dtype=np.float32)
        if not len(out):
            return out
        at = np.zeros((len(words.points), len(self.languages)), dtype=np.float32)
        for _, places in grams(words.points):
            at += self.table[places]
        at[0] = 0
        # a word's scores are those of its letters and of the edge after it
        bounds = np.column_stack([words.starts, words.starts + words.lengths + 1]).ravel()
        bounds = np.minimum(bounds, len(at) - 1) if bounds[-1] > len(at) - 1 else bounds
        if words.starts[-1] + words.lengths[-1] + 1 >= len(at):  # the last word's edge is the array's end
            bounds = bounds[:-1]
        out[:] = np.add.reduceat(at, bounds, axis=0)[::2] / len(ORDERS)
        narrowed = out + self.scripts[words.script]
        none = np.isneginf(narrowed).all(axis=1)
        narrowed[none] = 0.0  # no language has this script: the word says nothing
        return narrowed


def labels(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word: scores summed, less ``switch`` for each change."""
    n, k = scores.shape
    if k == 1:
        return np.zeros(n, dtype=np.int64)
    bounded = np.maximum(scores, scores.max(axis=1, keepdims=True) - 4 * switch)  # a change costs less than that
    whole = int(bounded.sum(axis=0, dtype=np.float64).argmax())
    other = np.delete(bounded, whole, axis=1).max(axis=1)
    line = np.concatenate([[0.0], np.cumsum((other - bounded[:, whole]).astype(np.float64))])
    inner = (line - np.minimum.accumulate(line)).max()  # the most that a run of words gains elsewhere
    if inner <= switch:
        return np.full(n, whole, dtype=np.int64)
    back = np.empty((n, k), dtype=np.int8 if k < 128 else np.int16)
    stay = np.arange(k)
    best = bounded[0].astype(np.float64)
    for t in range(n):
        if t:
            top = int(best.argmax())
            moved = best[top] - switch
            change = moved > best
            back[t] = np.where(change, top, stay)
            best = np.where(change, moved, best) + bounded[t]
    out = np.empty(n, dtype=np.int64)
    at = int(best.argmax())
    for t in range(n - 1, -1, -1):
        out[t] = at
        if t:
            at = int(back[t, at])
    return out


def pieces(texts: list[str | None], size: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Whole texts in turn, together about ``size`` characters (a longer one by itself)."""
    own, rows, n = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if n and n + len(t) > size:
            yield rows, own
            own, rows, n = [], [], 0
        own.append(code_points(t))
        rows.append(i)
        n += len(t)
    if own:
        yield rows, own


def scored(model: Model, texts: list[str | None]) -> Iterator[tuple[int, Words, slice, np.ndarray]]:
    """(text, words, the text's part of them, their labels) for each text that has letters."""
    size = max(1 << 14, PIECE // len(model.languages))
    for rows, points in pieces(texts, size):
        words = words_of(points)
        scores = model.word_scores(words)
        bounds = np.searchsorted(words.text, np.arange(len(points) + 1))
        for i, row in enumerate(rows):
            part = slice(int(bounds[i]), int(bounds[i + 1]))
            if part.stop > part.start:
                yield row, words, part, labels(scores[part], SWITCH)


def sampled(docs: DataFrame, doc_id: str, text: str, lang: str, rows_a_language: int) -> DataFrame:
    """(lang, text) of at most ``rows_a_language`` rows of each language: those first by a hash of the id and the text.

    A first count of each language sets the hash below which twice as many rows are expected; only they are exchanged.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"a model has at most {MAX_LANGUAGES} languages")
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(2.0 * rows_a_language / r["n"])) for r in counts], F.lit(1.0))
    drawn = rows.withColumn("at", F.xxhash64("id", "text")).filter(F.col("at") / F.lit(2.0**64) + 0.5 <= share)
    order = Window.partitionBy("lang").orderBy("at", "text")
    return drawn.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows_a_language).select("lang", "text")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_a_language: int = ROWS_A_LANGUAGE) -> Model | None:
    """A model of the non-null languages of ``docs``, from at most ``rows_a_language`` texts of each (see :func:`sampled`);
    None without a labelled text that has letters. The id only chooses the sample; it is no input of the model."""
    sample = sampled(docs, doc_id, text, lang, rows_a_language)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, own in frame.groupby("lang"):
                for _, points in pieces(list(own["text"]), PIECE):
                    words = words_of(points)
                    if not len(words.starts):
                        continue
                    total = np.zeros(TABLE, dtype=np.int64)
                    for _, places in grams(words.points):
                        total += np.bincount(places[1:], minlength=TABLE)
                    seen = np.flatnonzero(total)
                    found, n = np.unique(words.script, return_counts=True)
                    yield pd.DataFrame({"lang": name, "kind": "gram", "place": seen, "n": total[seen]})
                    yield pd.DataFrame({"lang": name, "kind": "script", "place": found.astype(np.int64), "n": n})

    counts = sample.mapInPandas(count, "lang string, kind string, place long, n long").groupBy("lang", "kind", "place").agg(F.sum("n").alias("n"))
    found = counts.collect()  # at most TABLE rows a language
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    number = {x: i for i, x in enumerate(languages)}
    table, scripts = np.zeros((TABLE, len(languages))), np.zeros((OTHER + 1, len(languages)))
    for r in found:
        (table if r["kind"] == "gram" else scripts)[r["place"], number[r["lang"]]] = r["n"]
    log = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * TABLE))
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, log.astype(np.float32), np.where(share >= 0.01, 0.0, -np.inf).astype(np.float32))


LABEL = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
SPAN = T.ArrayType(
    T.StructType([T.StructField("start_word", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())])
)


def _shipped(model: Model | None, docs: DataFrame) -> Broadcast:
    """The model's parts: unlike functions, a broadcast instance of a class needs the package where it is read."""
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.scripts) if model else None)


def predicted(model: Model | None, docs: DataFrame, text: Column) -> Column:
    """A struct column (lang_pred, score): the language with the most labelled letters and its share of all letters; ``und`` and
    0 for null texts and texts without a letter (or without any model). Words in a script of no language count for none: a
    text of such words alone has a score of 0."""
    shipped = _shipped(model, docs)

    @F.pandas_udf(LABEL)
    def label(texts: pd.Series) -> pd.DataFrame:
        model = Model(*shipped.value) if shipped.value else None
        names, shares = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        known = ~np.isneginf(model.scripts).all(axis=1) if model else None
        for row, words, part, own in scored(model, list(texts)) if model else ():
            lengths = words.lengths[part]
            weight = np.bincount(own, weights=lengths * known[words.script[part]], minlength=len(model.languages))
            best = int(weight.argmax())
            names[row], shares[row] = model.languages[best], weight[best] / lengths.sum()
        return pd.DataFrame({"lang_pred": names, "score": shares})

    return label(text)


def spans(model: Model | None, docs: DataFrame, text: Column) -> Column:
    """An array column of runs of words of one language: (start_word, words, lang); empty for texts without letters."""
    shipped = _shipped(model, docs)

    @F.pandas_udf(SPAN)
    def cut(texts: pd.Series) -> pd.Series:
        model = Model(*shipped.value) if shipped.value else None
        out: list[list] = [[] for _ in range(len(texts))]
        for row, _, _, own in scored(model, list(texts)) if model else ():
            at = np.flatnonzero(np.diff(own, prepend=-1))
            out[row] = [(int(a), int(b - a), model.languages[own[a]]) for a, b in zip(at, [*at[1:], len(own)], strict=True)]
        return pd.Series(out)

    return cut(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 1 modulo 3 (a null id counts as the text ``null``)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, text; learned from the rows not held out."""
    model = fit(docs.filter(~held_out(doc_id)), doc_id, text, lang)
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), predicted(model, docs, F.col(text)).alias("_p")).select(
        "doc_id", "held_out", "_p.lang_pred", "_p.score"
    )


def drop_unidentified(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without texts that have no letter or in which no language has ``least`` of the letters; columns as they were."""
    model = fit(docs.filter(~held_out(doc_id)), doc_id, text, lang)
    if model is None:
        return docs  # nothing is labelled, so nothing can be rejected
    found = held(docs, found=predicted(model, docs, F.col(text)))
    return found.filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")
