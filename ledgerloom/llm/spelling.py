"""Spelling variants by asymmetric q-chunks.

Of two words, the larger (by length, then code points) contributes two disjoint chunks, each half its length; the other
contributes its positional grams of that length. One inserted, deleted or replaced code point touches one chunk at most, so the
other is a gram of the smaller word, at its own place or one before. Grams that lie further from both chunks can meet none and
are not made. Words that meet are verified by their edit distance.

A word's form is the most frequent near word that outnumbers it clearly. Counts grow along forms, so chains are as short as
the logarithm of the largest count, and pointer doubling ends them in a number of rounds known beforehand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of
from ledgerloom.session import durable

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIPS = 199  # of so many occurrences, by hash, one loses a code point
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5


def slipped(doc_id: Column, run: Column, slips: int = SLIPS) -> Column:
    """The run, without one code point where its hash with the document's id says so."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(slips)) == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slips: int = SLIPS) -> DataFrame:
    """(word, n): the results of all runs of letters, with their number of occurrences over all texts."""
    runs = F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs).alias("run"))
    words = rows.select(slipped(F.col("doc_id"), F.col("run"), slips).alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _chunks() -> Column:
    """The two disjoint chunks of a word: (length of the word, which chunk, the chunk)."""
    n = F.char_length("word")
    half = F.floor(n / 2).cast("int")
    part = lambda c: F.struct(n.alias("of"), F.lit(c).alias("chunk"), F.substring("word", half * c + 1, half).alias("gram"))
    return F.array(part(0), part(1))


def _grams() -> Column:
    """The grams by which a word meets the chunks of words as long as itself or longer by one: same fields as of a chunk."""
    n, out = F.char_length("word"), []
    for longer, chunk, shift in ((0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0), (1, 1, -1)):
        half = F.floor((n + longer) / 2).cast("int")
        gram = F.substring("word", half * chunk + shift + 1, half)
        out.append(F.struct((n + longer).alias("of"), F.lit(chunk).alias("chunk"), gram.alias("gram")))
    return F.array(*out)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): pairs of ``words`` (word, n), of two code points or more, at an edit distance of one, both ways round."""
    chunks = words.select(F.col("word").alias("large"), F.col("n").alias("large_n"), F.explode(_chunks()).alias("c")).select("large", "large_n", "c.*")
    grams = words.select("word", "n", F.explode(_grams()).alias("c")).select("word", "n", "c.*")
    grams = grams.filter(F.char_length("gram") == F.floor(F.col("of") / 2))  # a gram over the word's end is none
    met = chunks.join(grams, ["of", "chunk", "gram"]).filter((F.char_length("word") < F.col("of")) | (F.col("word") < F.col("large")))
    pairs = durable(met.filter(F.levenshtein("large", "word", 1) == 1).select("large", "large_n", "word", "n").distinct(), "spelling-pairs")
    one = pairs.select("word", "n", F.col("large").alias("near"), F.col("large_n").alias("near_n"))
    return one.unionByName(pairs.select(F.col("large").alias("word"), F.col("large_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def followed(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): where the chains of ``forms`` (word, form), of at most 2 ** rounds steps, end."""
    to = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        then = to.select(F.col("word").alias("root"), F.col("root").alias("then"))
        to = durable(to.join(then, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "spelling-roots")
    return to


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slips: int = SLIPS) -> DataFrame:
    """One row per word: word, n, n_near (words at an edit distance of one), form and form_n (the near word of the largest count,
    ties to the smallest, if at least ``RATIO`` times as frequent; else null), root (the last of the chain of forms, else the word).

    Words are runs of letters (A-Z lower-cased) of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences or more. Null
    and empty texts have none; a null id counts as empty when slips are drawn; repeated rows count as often as they are there;
    other columns are not read; an empty table gives an empty result.
    """
    words = durable(vocabulary(docs, doc_id, text, slips), "spelling-words")
    most = words.agg(F.max("n")).first()[0] or 1
    larger = F.when(F.col("near_n") >= RATIO * F.col("n"), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(larger).alias("best"))
    found = durable(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
        ),
        "spelling-forms",
    )
    steps = 1 + max(0, math.log(most / LEAST_COUNT, RATIO))  # counts grow by RATIO a step
    roots = followed(found.filter("form IS NOT NULL").select("word", "form"), math.ceil(math.log2(steps)))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
