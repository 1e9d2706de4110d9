"""Spelling variants grouped by PartEnum signatures.

A word is taken as the multiset of its letters, a binary vector with a dimension for each letter and occurrence.  One edit
moves it by a Hamming distance of at most two.  The letters are dealt to ``parts`` parts of about equal weight; the two
dimensions that may differ lie in at most two of them, so near words agree on all the others.  Every choice of all parts but two is
enumerated, and the hash of what a word has there is a signature.  Words that share a signature are joined by
equality and verified by their edit distance.

An edit also leaves one half of a word as it is.  So a signature holds the first or the last letters too, half as many as the
shorter of two words has, and its length, which keeps the groups of a signature small where words are made of few syllables.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merkle import LOWER, UPPER
from .shared import written

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"


def typed_words(docs: DataFrame, *, key: str, text: str, least: int, slip: int | None) -> DataFrame:
    """One row ``word`` per maximal run of at least ``least`` letters, A-Z lower-cased.

    With ``slip``, the crc32 h of ``<key>:<run>`` says where a typist slips: if ``slip`` divides it, the letter at
    h modulo the length is left out.  A row with a null key has no slips.
    """
    runs = docs.select(F.col(key).cast("string").alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if slip is None:
        return lowered.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return lowered.select(F.when(h % slip == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def letter_parts(words: DataFrame, parts: int) -> list[str]:
    """The letters of ``words`` dealt to parts, the most frequent first, each to the lightest part; the alphabet bounds them."""
    letters = words.select(F.explode(F.split("word", "")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    dealt, weight = [""] * parts, [0] * parts
    for row in letters.orderBy(F.desc("n"), "x").collect():
        lightest = weight.index(min(weight))
        dealt[lightest] += row["x"]
        weight[lightest] += row["n"]
    return dealt


def signatures(words: DataFrame, dealt: list[str], least: int) -> DataFrame:
    """Rows ``(sig, base, word)``: a word's signatures as one of two words of which the shorter has ``base`` letters.

    ``words`` has ``word`` of at least ``least`` letters; a word is the shorter one, or as long, or the longer one by a letter.
    """
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    held = words.select("word", F.char_length("word").alias("len"), *[
        F.translate(ordered, "".join(x for j, x in enumerate(dealt) if j != i), "").alias(f"part{i}") for i in range(len(dealt))])
    based = held.withColumn("base", F.explode(F.array("len", F.col("len") - 1))).where(F.col("base") >= least)
    half = F.floor(F.col("base") / 2).cast("int")
    ends = based.withColumn("e", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("letters")),
        F.struct(F.lit(1).alias("side"), F.substring("word", F.col("len") - half + 1, half).alias("letters")))))
    kept = [F.xxhash64(F.lit(n), "e.side", "e.letters", "base", *[f"part{i}" for i in keep])
            for n, keep in enumerate(combinations(range(len(dealt)), len(dealt) - 2))]
    return ends.select(F.explode(F.array(*kept)).alias("sig"), "base", "word")


def near_words(words: DataFrame, *, least: int, parts: int) -> DataFrame:
    """Every two words ``(a, b)``, a before b, of which one becomes the other by one letter put in, left out or replaced."""
    signed = written(signatures(words, letter_parts(words, parts), least), "variant-signatures")
    left = signed.select("sig", "base", F.col("word").alias("a"))
    right = signed.select("sig", F.col("word").alias("b"))
    shorter = F.least(F.char_length("a"), F.char_length("b"))
    met = left.join(right, "sig").where((F.col("a") < F.col("b")) & (shorter == F.col("base")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """``(word, root)`` for the words that have a ``form``: forms followed to the last, twice as far in every round."""
    ends = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_beyond"))
        ends = written(ends.join(further, "root", "left").select("word", F.coalesce("_beyond", "root").alias("root")), "variant-roots")
    return ends


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 6, occurrences: int = 5,
                      ratio: int = 5, slip: int | None = None, parts: int = 4) -> DataFrame:
    """One row per distinct word of ``docs``: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are the maximal runs of letters (``LETTERS``; A-Z lower-cased, others as they are) of at least ``least`` code points that
    occur ``occurrences`` times or more; ``slip`` puts typing errors in, see ``typed_words``.  Two are near if one inserted,
    deleted or replaced code point makes one of the other; ``n_near`` counts them.  ``form`` is the near word of largest ``n``, of
    equal ones the smallest in code-point order, if that ``n`` is at least ``ratio`` times the word's own, else null; ``root`` is
    what following forms ends at, the word itself without a form.

    A null or empty text has no words, one of any length is read whole; a repeated row counts again, as does one with
    a null key.  An empty table gives no rows.  Other columns are not read.
    """
    if least < 2 or ratio < 2 or parts < 3:
        raise ValueError("least and ratio must be 2 or more, parts 3 or more")
    counted = typed_words(docs, key=key, text=text, least=least, slip=slip).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = written(counted.where(F.col("n") >= occurrences), "variant-words")
    pairs = written(near_words(words, least=least, parts=parts), "variant-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranked = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best: Column = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")))
    met = ranked.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    told = written(words.join(met, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "variant-forms")
    # Along forms n grows by the ratio each time, which bounds how many there are one after the other.
    most = words.agg(F.max("n")).first()[0] or occurrences
    steps = int(math.log(most / occurrences, ratio)) + 1
    roots = _roots(told.where("form IS NOT NULL"), steps)
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
