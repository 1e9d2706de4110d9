"""Spelling variants against a version that compares every two words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import messy
import pytest
from pyspark.sql import functions as F

from tagloom.llm.variants import near_words, spelling_variants, typed_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[same + 1:] == b[same + 1:] if len(a) == len(b) else a[same:] == b[same + 1:])


def by_hand(rows, slip=None, least=6, occurrences=5, ratio=5):
    counted = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{key}:{run}".encode())
            if slip and key is not None and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counted[run] += 1
    words = {w: n for w, n in counted.items() if len(w) >= least and n >= occurrences}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), words.get(form.get(w))


def check(docs, **options):
    got = sorted(map(tuple, spelling_variants(docs, **options).collect()), key=repr)
    assert got == sorted(by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], **options), key=repr)
    return got


def near_texts(seed, documents):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("aeiorsté") for _ in range(draw.randrange(6, 10))) for _ in range(25)]
    for n in range(documents):
        said = []
        for _ in range(120):
            word = draw.choice(stems[:4] if draw.random() < 0.6 else stems)
            for _ in range(draw.choice([0, 0, 0, 0, 1, 1, 2])):
                i = draw.randrange(len(word))
                word = draw.choice([word[:i] + word[i + 1:], word[:i] + draw.choice("aeét") + word[i:],
                                    word[:i] + draw.choice("aeét") + word[i + 1:]])
            said.append(draw.choice([word, word, word.title(), word.upper()]))
        yield n, draw.choice([" ", ", ", "1", "-"]).join(said)


@pytest.mark.parametrize("options", [{}, {"slip": 7, "parts": 3}, {"occurrences": 2, "ratio": 2, "parts": 6}, {"least": 3, "slip": 5}])
def test_near_words_and_forms(spark, options):
    docs = spark.createDataFrame(list(near_texts(4, 60)), "doc_id long, text string").repartition(5)
    parts = options.pop("parts", 4)
    want = sorted(by_hand([tuple(r) for r in docs.collect()], **options), key=repr)
    assert sorted(map(tuple, spelling_variants(docs, parts=parts, **options).collect()), key=repr) == want
    assert any(w[1] for w in want)


def test_forms_are_followed_to_the_last(spark):
    said = ["lanternas"] * 625 + ["lantern"] * 25 + ["lanterna"] * 125 + ["lantrrn"] * 5
    got = check(spark.createDataFrame([(1, " ".join(said)), (2, None)], "doc_id long, text string"))
    assert {(g[0], g[1], g[2]) for g in got} == {("lantrrn", "lantern", "lanternas"), ("lantern", "lanterna", "lanternas"),
                                                ("lanterna", "lanternas", "lanternas"), ("lanternas", None, "lanternas")}


def test_every_edit_of_a_word_is_found(spark):
    words = {"kartoffel", "xkartoffel", "artoffel", "kartofel", "kartoffex", "kartoffelx", "katroffel", "kartoffelxy", "leffotrak", "karroffel"}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in near_words(table, least=6, parts=4).collect()}
    assert got == {tuple(sorted(p)) for p in combinations(words, 2) if one_edit(*p)}


def test_messy_and_empty_tables(spark):
    check(messy.messy(spark), slip=3, occurrences=1, least=2)
    check(messy.messy(spark))
    assert spelling_variants(messy.empty(spark)).count() == 0


def test_runs_are_maximal_and_only_ascii_is_lowered(spark):
    docs = spark.createDataFrame([(1, "ÄPFEL2äpfel ÑANDÚS×ñ Äpfel")], "doc_id long, text string")
    got = sorted(r.word for r in typed_words(docs, key="doc_id", text="text", least=5, slip=None).collect())
    assert got == sorted(["Äpfel", "äpfel", "ÑandÚs×ñ", "Äpfel"])


def test_settings_are_checked(spark):
    with pytest.raises(ValueError):
        spelling_variants(messy.empty(spark).withColumn("text", F.lit("")), parts=2)
