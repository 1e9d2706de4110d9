"""Benchmark decontamination by an FM-index per shard of documents.

A shard's words become numbers and its documents one sequence.  Its suffix array gives the Burrows-Wheeler transform; a
wavelet tree over that answers how often a word occurs before a place.  Phrases are searched backwards, all of them a word
at a time; what they match is located by stepping to the next sampled suffix.  The spans of the occurrences are merged
per document.

Phrases are searched in blocks of a bounded size, so the table of phrases may have any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column_bytes, fresh, open_file, put_file, scratch, tidy

#: Fixed values of the contract: how many words are a window, and the pattern of a word.
WINDOW = 10
_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

SAMPLE_EVERY = 16


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text, A-Z lower-cased."""
    return _words(text.lower())


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling.  Once a suffix stands alone its rank is final, so only ties are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    value = symbols[order]
    start = np.concatenate([[True], value[1:] != value[:-1]])
    head = np.maximum.accumulate(np.where(start, np.arange(n), 0))  # a tie shares the rank of its first place
    rank = np.empty(n, np.int64)
    rank[order] = head
    width = 1
    while True:
        alone = start & np.append(start[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        suffix = order[tied]
        beyond = suffix + width
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[suffix]))
        suffix, second = suffix[by], second[by]
        group = rank[suffix]
        order[tied] = suffix
        start[tied] = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        places = np.where(start[tied], tied, 0)
        rank[suffix] = np.maximum.accumulate(places)
        width *= 2


class Wavelet:
    """Levels of bits from the highest: each is stably parted by its bit before the next is taken."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        current = symbols
        for level in range(bits - 1, -1, -1):
            ones = (current >> level & 1).astype(bool)
            count = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            zeros = self.n - int(count[-1])
            self.levels.append((level, count, zeros))
            current = np.concatenate([current[~ones], current[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros_like(place), place
        for level, count, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = count[low], count[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for level, count, zeros in self.levels:
            ones = count[place + 1] - count[place]
            symbol |= ones.astype(place.dtype) << level
            place = np.where(ones == 1, zeros + count[place], place - count[place])
        return symbol


class FMIndex:
    def __init__(self, symbols: np.ndarray, size: int, every: int = SAMPLE_EVERY):
        """``symbols`` below ``size``, none of them 0, which ends the sequence."""
        text = np.append(symbols, 0)
        array = suffix_array(text)
        self.wavelet = Wavelet(text[array - 1], max(1, int(size - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.sampled = array % every == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = array[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted suffixes that begin with each phrase, from low to high; phrases are right-aligned."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.wavelet.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, -back]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence of rows, by steps back to a sampled suffix."""
        place, steps, rows = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            there = self.sampled[rows[live]]
            own = live[there]
            place[own] = self.samples[self.sampled_before[rows[own]]] + steps[own]
            live = live[~there]
            symbol = self.wavelet.access(rows[live])
            rows[live] = self.before[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
        return place


class Phrases:
    """The windows of items, over numbers for the words that occur in them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        rows: dict[tuple, set[str]] = {}
        for item, text in items:
            coded = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words_of(text)]
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                rows.setdefault(tuple(coded[i:i + window]), set()).add(item)
        self.size = len(self.numbers) + 2  # 0 ends a sequence, 1 is any other word
        self.items = [sorted(x) for x in rows.values()]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.table = np.zeros((len(rows), window), np.int64)
        for i, row in enumerate(rows):
            self.table[i, window - len(row):] = row
        self.shortest = int(self.lengths.min()) if rows else 0

    def occurrences(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all phrases in a sequence of numbers, and which phrase each is.

        A run of phrase words that is shorter than every phrase can hold none, so runs of that kind and other words
        are left out of the index; what stays is parted by 1, and places are told in the whole sequence.
        """
        known = coded > 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        mark = np.zeros(len(coded) + 1, np.int8)
        mark[starts] = 1
        mark[ends] = -1
        inside = np.cumsum(mark[:-1]).astype(bool)
        inside[np.minimum(ends, len(coded) - 1)] = True  # the word or end behind a run parts it from the next
        where = np.flatnonzero(inside)
        symbols = np.where(np.isin(where, ends), 1, coded[where])
        index = FMIndex(symbols, self.size)
        low, high = index.search(self.table, self.lengths)
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(low)), count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return where[index.locate(rows)], phrase


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as spans that don't touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(new[1:], True)]


def _block_uri(folder: str, block: int) -> str:
    return f"{folder}/{block:08d}.arrow"


def write_blocks(items: DataFrame, folder: str, block_bytes: int) -> list[int]:
    """Rows of item and words as a file per block of about ``block_bytes``, an item in one block; the numbers of the blocks."""
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def write(block: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema) as out:
            out.write_table(block)
        number = block.column("block")[0].as_py()
        put_file(_block_uri(folder, number), [sink.getvalue().to_pybytes()])
        return pa.table({"block": pa.array([number], pa.int64())})

    placed = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    return sorted(r.block for r in placed.groupBy("block").applyInArrow(write, "block long").collect())


def read_block(folder: str, block: int) -> list[tuple[str, bytes]]:
    with open_file(_block_uri(folder, block)) as source:
        table = pa.ipc.open_stream(source).read_all()
    return list(zip(table.column("item").to_pylist(), column_bytes(table.column("words").combine_chunks())))


def _search(folder: str, blocks: list[int], window: int, text_name: str, found_name: str, shard_words: int, shard_bytes: int):
    """Gives rows of text their count of words, and the spans and items that all blocks of phrases find in them.

    A task holds one block at a time; batches take the blocks in turns up and down, so one that was read last comes first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, last, phrases = list(blocks), None, None if blocks else Phrases([], window)
        for batch in batches:
            found = [([], [])] * batch.num_rows
            for block in order or [None]:
                if block != last:
                    phrases = None
                    last, phrases = block, Phrases(read_block(folder, block), window)
                told = passed(batch, found, phrases)
                found = [(x["spans"], x["items"]) for x in told]
            order.reverse()
            at = batch.schema.get_field_index(found_name)
            yield batch.set_column(at, found_name, pa.array(told, _FOUND_ARROW))

    def passed(batch: pa.RecordBatch, before: list, phrases: Phrases) -> list[dict]:
        get = phrases.numbers.get

        def shard(held: list, coded: list[np.ndarray]) -> list[dict]:
            sizes = np.array([len(c) for c in coded], np.int64)
            begun = np.cumsum(sizes + 1) - (sizes + 1)
            text = np.ones(int((sizes + 1).sum()), np.int64)
            for at, c in zip(begun.tolist(), coded):
                text[at:at + len(c)] = c
            place, phrase = phrases.occurrences(text)
            doc = np.searchsorted(begun, place, side="right") - 1
            order = np.argsort(doc, kind="stable")
            place, phrase, doc = place[order], phrase[order], doc[order]
            edges = np.searchsorted(doc, np.arange(len(coded) + 1))
            out = []
            for i, (n, (spans, found)) in enumerate(zip(sizes.tolist(), held)):
                lo, hi = edges[i], edges[i + 1]
                if lo < hi:
                    s = place[lo:hi] - begun[i]
                    old = np.array([(x["a"], x["b"]) for x in spans], np.int64).reshape(-1, 2)
                    a, b = merged(np.concatenate([s, old[:, 0]]), np.concatenate([s + phrases.lengths[phrase[lo:hi]], old[:, 1]]))
                    spans = [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())]
                    found = sorted({*found, *(x for p in np.unique(phrase[lo:hi]).tolist() for x in phrases.items[p])})
                out.append({"n": n, "spans": spans, "items": found})
            return out

        held, coded, out, words, size = [], [], [], 0, 0
        for text, old in zip(column_bytes(batch.column(text_name)), before):
            row = np.array([get(w, 1) for w in words_of(text)], np.int64)
            held.append(old)
            coded.append(row)
            words += len(row)
            size += len(text)
            if words >= shard_words or size >= shard_bytes:
                out += shard(held, coded)
                held, coded, words, size = [], [], 0, 0
        return out + shard(held, coded) if coded else out

    return run


_FOUND = "struct<n:long,spans:array<struct<a:long,b:long>>,items:array<string>>"
_FOUND_ARROW = pa.struct([("n", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                          ("items", pa.list_(pa.string()))])


def find_leaks(docs: DataFrame, benchmark: DataFrame, found: str, *, text: str = "text", item: str = "item_id",
               item_text: str = "text", window: int = WINDOW, block_bytes: int = 8 << 20, shard_words: int = 1 << 20,
               shard_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with a struct column ``found``: ``n`` words, merged ``spans`` of words that are hit, ``items``.

    The benchmark goes to the tasks as files of about ``block_bytes`` of text in the shared folder, and a task holds one of
    them at a time; an item stands in one block.  Null texts have no words; items without an id or words match nothing; an
    item id in several rows has the windows of all.  Rows are judged each, repeated or not; an empty table gives no rows.
    A text of any length is one shard.
    """
    usable = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item).cast("string").alias("item"), F.col(item_text).alias("words"))
    folder = scratch(docs.sparkSession, "phrases")
    blocks = write_blocks(usable, folder, block_bytes)
    out = docs.withColumn(found, F.lit(None).cast(_FOUND))
    return out.mapInArrow(tidy(_search(folder, blocks, window, text, found, shard_words, shard_bytes)), out.schema)


def leak_report(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: key, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, and the spans."""
    base = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    f = find_leaks(base, benchmark, "found", text="text", **options)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return f.select(
        F.col("doc").alias(key), F.col("found.n").alias("n_words"), hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.col("found.spans").alias("spans"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    found, = fresh(docs, "found")
    return find_leaks(docs, benchmark, found, text=text, **options).where(F.size(f"{found}.spans") == 0).drop(found)
