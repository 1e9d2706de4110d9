"""Id files, packing, tokenisation by pieces."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import empty, messy, rows
from tokenizers import Tokenizer

from tagloom.llm.id_codec import COUNTS, WIDTHS, IdFile, decode, encode, id_round_trip, write_ids
from tagloom.llm.packing import deal, difference, pack
from tagloom.llm.shared import Encoder

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TRICKY = ["it's", "'s", "don't!x's", "a<|endoftext|>b", "<|startoftext|> x", "", " ", "  a  b  ", "\x1c!\x1cb", "é ́e", "a b c",
          "x1y2", "ΑΣ Σ.", "İ i̇", "中文字 テスト", "a\r\n\r\nb", "tail\n"]


@pytest.mark.parametrize(("path", "space"), [(WORD, False), (BYTE, True)])
@given(texts=st.lists(st.text(alphabet="ab 'st\n\t\x0b\x1c\x85\xa0.,!?09éßñ́中Σ😀<|_-", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_pieces_give_the_ids_of_the_whole_text(path, space, texts):
    coder, plain = _coder(path, space), _plain(path)
    ids, edges = coder.encode([t.encode() for t in texts + TRICKY])
    for begin, end, text in zip(edges, edges[1:], texts + TRICKY):
        assert ids[begin:end].tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "space"), [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_batches_and_parts_of_long_texts(path, space, size):
    texts = ["x, y z\u2003 " * 30, "", "été\u00a0 l'an 2000", "a  b\n\n" * 20, *TRICKY, " "]
    coder, plain = _coder(path, space), _plain(path)
    seen = 0
    for start, end, ids, edges in coder.documents([t.encode() for t in texts], 1, size):
        assert start == seen
        for begin, stop, text in zip(edges, edges[1:], texts[start:end]):
            assert ids[begin:stop].tolist() == plain.encode(text, add_special_tokens=False).ids + [1]
        seen = end
    assert seen == len(texts)


_known: dict = {}


def _coder(path, space):
    return _known.setdefault((path, space), Encoder(path, space))


def _plain(path):
    return _known.setdefault(path, Tokenizer.from_file(path))


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_000) | st.just(0), max_size=400))
def test_words_round_trip(values):
    array = np.array(values, np.uint64)
    assert decode(encode(array)).tolist() == values


def test_words_are_full():
    for selector in range(1, 15):
        values = np.full(int(COUNTS[selector]) * 10, (1 << int(WIDTHS[selector])) - 1, np.uint64)
        assert len(encode(values)) == 10


def _ids(path, text):
    return _plain(path).encode(text or "", add_special_tokens=False).ids + [1]


def test_id_files_of_messy_rows(spark):
    got = [tuple(r) for r in id_round_trip(messy(spark), WORD).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows()), key=lambda i: (i is not None, i or 0))
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    want = sorted(str((r[0], len(x := _ids(WORD, r[1])), zlib.crc32(np.array(x, "<u4").tobytes()))) for r in rows())
    assert sorted(str((g[0], g[2], g[3])) for g in got) == want
    assert id_round_trip(empty(spark), WORD).count() == 0


def test_id_file_reads_any_range(spark, tmp_path):
    docs = messy(spark).where("doc_id = 14")
    file = write_ids(docs, str(tmp_path), WORD).first()["file"]
    source, ids = IdFile(file), _ids(WORD, rows()[14][1])
    for a, b in ((0, len(ids)), (4095, 4097), (5000, 5001), (len(ids) - 1, len(ids))):
        assert source.read(a, b).tolist() == ids[a:b]


def test_pack_of_messy_rows(spark):
    got = pack(messy(spark), BYTE, shard_pieces=16).collect()
    pieces = {}
    for g in got:
        pieces.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in pieces.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= 2048
    docs = {}
    for g in got:
        docs.setdefault((g.doc_id, g.doc_tokens), []).append(g)
    for (doc, total), parts in docs.items():
        texts = [r[1] for r in rows() if r[0] == doc and len(_ids(BYTE, r[1])) == total]
        if len(texts) != 1:
            continue
        ids = np.array(_ids(BYTE, texts[0]), "<u4")
        parts.sort(key=lambda g: g.start)
        assert sum(g.length for g in parts) == total == len(ids)
        assert all(g.ids_crc32 == zlib.crc32(ids[g.start:g.start + g.length].tobytes()) for g in parts)
    assert sum(g.length for g in got) == sum(len(_ids(BYTE, r[1])) for r in rows())
    assert pack(empty(spark), BYTE).count() == 0


def test_differencing_is_near_equal_and_within_capacity():
    draw = np.random.default_rng(0)
    for n, k in ((1, 1), (1, 4), (3, 2), (40, 5), (700, 60)):
        sizes = draw.integers(1, 257, n)
        sums = np.bincount(difference(sizes, k), sizes, k)
        assert sums.sum() == sizes.sum()
        if n > 8 * k:
            assert sums.max() - sums.min() <= 8
    sizes = draw.integers(1, 257, 900)
    window, count = deal(sizes, 2048)
    assert np.bincount(window, sizes).max() <= 2048 and sizes.sum() / (count * 2048) > 0.97
    assert deal(np.array([2048, 1]), 2048)[1] == 2
