"""The hidden Markov model against sums over all paths, and its blocks against plain splitting."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
import xxhash
from messy import rows
from tagloom.llm.hmm import (Classes, Hmm, HmmSettings, Lattice, _blocks, _expectation, _summed, baum_welch, coded_blocks, coded_words, improved,
                             packed, score_texts, unpacked)



def _model(draw, states, classes):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return Hmm(norm(draw.random(states)), norm(draw.random((states, states))), norm(draw.random((states, classes))).T)


def _all_paths(model, sequence):
    """Likelihood, and expected emissions, moves and starts, from every path."""
    states = len(model.start)
    total, emitted, moves, starts = 0.0, np.zeros(model.emit.shape), np.zeros((states, states)), np.zeros(states)
    for path in itertools.product(range(states), repeat=len(sequence)):
        p = model.start[path[0]] * np.prod([model.emit[c, s] for c, s in zip(sequence, path)])
        p *= np.prod([model.move[a, b] for a, b in itertools.pairwise(path)])
        total += p
        starts[path[0]] += p
        for c, s in zip(sequence, path):
            emitted[c, s] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
    return total, emitted / total, moves / total, starts / total


def test_words_of_blocks():
    texts = [r[1].encode() if r[1] else b"" for r in rows()] + ["\x0b a\x0cB\x1fc  ".encode(), "\xa0x Y é É".encode(), b"end"]
    hashes, codes, lengths = coded_words(texts)
    want = [x.lower().split() for x in texts]
    assert lengths.tolist() == [len(x) for x in want]
    assert hashes[codes].tolist() == [xxhash.xxh3_64_intdigest(w) for x in want for w in x]
    assert len(set(hashes.tolist())) == len(hashes)
    assert [len(x) for x in coded_words([b"", b" "])] == [0, 0, 2]


@pytest.mark.parametrize("words", [0, 1, 2, 256, 257, 65_536, 65_537, 1 << 24, (1 << 24) + 1])
def test_codes_are_unpacked(words):
    codes = np.random.default_rng(1).integers(0, max(words, 1), 100 if words else 0).astype(np.int32)
    codes[:1] = max(words - 1, 0)
    assert unpacked(packed(codes, words), words).tolist() == codes.tolist()


@pytest.mark.parametrize("items", [1, 2, 5, 100])
def test_expected_counts_over_borders(items):
    """Wherever the recursions are cut, their counts are those of whole sequences."""
    draw = np.random.default_rng(7)
    model = _model(draw, 3, 5)
    sequences = [draw.integers(0, 5, n).astype(np.int32) for n in (4, 1, 7, 4, 2)]
    lattice = Lattice(sequences)
    emitted, moves, starts = np.zeros((5, 3)), np.zeros((3, 3)), None
    for seen, share, moved in lattice.expected(model, items):
        np.add.at(emitted, seen, share)
        moves += moved
        starts = share[:len(sequences)].sum(axis=0)
    want = [_all_paths(model, s) for s in sequences]
    assert np.allclose(emitted, sum(w[1] for w in want)) and np.allclose(moves, sum(w[2] for w in want))
    assert np.allclose(starts, sum(w[3] for w in want))
    by_time = lattice.by_time(lattice.flat)
    assert np.allclose(lattice.log10_scales(model, lambda lo, hi: model.emit[by_time[lo:hi]], items), [np.log10(w[0]) for w in want])


TEXTS = ["a b c", "b b", None, "c d a b", "e", "a b", "d", "A  c\tb"]


@pytest.mark.parametrize("chunk_tokens", [2, 1000])
def test_counts_and_scores_of_a_tiny_table(spark, chunk_tokens):
    """Baum-Welch counts of the whole table and the scores of ``score_texts``, both by all paths."""
    settings = HmmSettings(states=2, classes=4, rounds=1, chunk_tokens=chunk_tokens, block_bytes=250)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    blocks = coded_blocks(docs, "doc_id", "text", (7, 2), settings)
    words = [[*(t or "").lower().split()] for t in TEXTS]
    train = [w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 0 < len(train) < len(words)
    counts: dict = {}
    for w in itertools.chain(*train):
        counts[w] = counts.get(w, 0) + 1
    tokens, ends = sum(counts.values()) + len(train), len(train)
    digest = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    classes = Classes(4, np.array(sorted(digest(w) for w, c in counts.items() if c * 4 >= tokens), np.uint64))
    kind = lambda w: int(classes.of(np.array([digest(w)], np.uint64))[0])
    totals = np.zeros(classes.end + 1)
    for w, c in counts.items():
        totals[kind(w)] += c
    totals[-1] = ends

    model = _model(np.random.default_rng(3), 2, classes.end + 1)
    emitted, small = _summed(blocks, _expectation(model, classes, settings), classes, settings)
    want = [_all_paths(model, [*map(kind, x), classes.end]) for x in train]
    for got, at in ((emitted, 1), (small[:-1], 2), (small[-1], 3)):
        assert np.allclose(got, sum(w[at] for w in want), atol=1e-4)
    again = improved(model, emitted, small[:-1], small[-1], totals / tokens, 10.0)
    assert np.allclose(again.emit.sum(axis=0), 1) and np.allclose(again.move.sum(axis=1), 1) and np.isclose(again.start.sum(), 1)

    trained = baum_welch(blocks, totals, classes, settings)
    once = sum(c == 1 for c in counts.values()) + (ends == 1)
    unseen = (once + 1) / (tokens + 2)
    for row in score_texts(docs, settings=settings).collect():
        told = [(classes.end, ends, True)] if not words[row.doc_id] else [*((kind(w), counts.get(w, 0), w in counts) for w in words[row.doc_id]),
                                                                        (classes.end, ends, True)]
        total = 0.0
        for path in itertools.product(range(2), repeat=len(told)):
            p = trained.start[path[0]] * np.prod([trained.move[a, b] for a, b in itertools.pairwise(path)])
            for s, (k, c, known) in zip(path, told):
                p *= trained.emit[k, s] * c / totals[k] * (1 - unseen) if known else unseen
            total += p
        assert np.isclose(row.score, np.log10(total), atol=1e-4), row


def test_blocks_hold_every_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows()], "doc_id long, text string")
    settings = HmmSettings(block_bytes=2000)
    got = []
    for record in coded_blocks(docs, "doc_id", "text", (7, 2), settings).toArrow().to_batches():
        for row, b in _blocks([record]):
            got += list(zip(row.column("docs")[0].as_py(), b.lengths.tolist()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((r[0], len((r[1] or "").split())) for r in rows()), key=key)
