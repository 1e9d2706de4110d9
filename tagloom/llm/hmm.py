"""A hidden Markov language model over words.

Latent states emit classes of words, and a class its words by their counts.  Frequent words are classes of their own, the
others share classes by hash, and the number of classes grows with the root of the vocabulary.  Texts are coded once, in
blocks that hold their own distinct words; every later step reads the blocks.  Baum-Welch runs over all training texts
whole: every task adds up its expected counts, which Spark sums by class.  A text's likelihood is the scaled forward
recursion over the whole text.  Word counts, which grow with the corpus, are never in one place: a block asks for its
own words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column_bytes, in_fold, returned, slices, tidy, written


@dataclass(frozen=True)
class HmmSettings:
    states: int = 8
    classes: int | None = None  # of rare words, a power of two; without it 32 to 64 roots of the vocabulary
    rounds: int = 4
    seed_rounds: int = 1  # passes that sort whole texts among the states before
    stay: float = 0.95  # first guess of the share of words that keep the state
    prior: float = 500.0  # words' worth of the common distribution in that of each state
    chunk_tokens: int = 1 << 19  # read side by side, and between the borders that a longer text is cut at
    block_bytes: int = 8 << 20


@dataclass(frozen=True)
class Classes:
    """Rare words by hash, then the frequent words, then the end of a text."""

    rare: int
    own: np.ndarray  # hashes of the frequent words, ascending

    @property
    def end(self) -> int:
        return self.rare + len(self.own)

    def of(self, words: np.ndarray) -> np.ndarray:
        shared = (words % np.uint64(self.rare)).astype(np.int32)
        if not len(self.own):
            return shared
        at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1).astype(np.int32)
        return np.where(self.own[at] == words, self.rare + at, shared)


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # by state
    move: np.ndarray  # state to state
    emit: np.ndarray  # class by state


class Lattice:
    """Sequences side by side, the longest first, so that those still running at a time are a prefix.

    The recursions run over a span of times at once; what they hand over the border of a span is one row per sequence.
    """

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(x) for x in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.running = np.searchsorted(-self.lengths, -np.arange(steps), side="left")  # at time t: longer than t
        self.at = np.concatenate([[0], np.cumsum(self.running)])
        flat = np.concatenate([sequences[i] for i in self.order]) if len(lengths) else np.empty(0, np.int32)
        time = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.place = self.at[time] + self.ranks()  # of each item of the sequences in turn
        self.flat = flat

    def ranks(self) -> np.ndarray:
        """The sequence of each item, the longest as 0."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def by_time(self, values: np.ndarray) -> np.ndarray:
        out = np.empty((len(values), *values.shape[1:]), values.dtype)
        out[self.place] = values
        return out

    def spans(self, items: int) -> list[tuple[int, int]]:
        """Spans of time of at most so many items, or of a single time."""
        out, t = [], 0
        while t < len(self.running):
            end = max(t + 1, int(np.searchsorted(self.at, self.at[t] + items, side="right")) - 1)
            out.append((t, end))
            t = end
        return out

    def forward(self, start: np.ndarray, move: np.ndarray, weights: np.ndarray, span: tuple[int, int] | None = None,
                before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """State shares after each item of the span and the scale taken out, both by time; ``before`` is the share ahead of it."""
        alpha, scale = np.empty_like(weights), np.empty(len(weights), weights.dtype)
        first, last = span or (0, len(self.running))
        for t in range(first, last):
            n, lo = int(self.running[t]), self.at[t] - self.at[first]
            now = alpha[lo:lo + n]
            np.multiply(start if before is None else before[:n] @ move, weights[lo:lo + n], out=now)
            total = now.sum(axis=1)
            scale[lo:lo + n] = total
            now /= total[:, None]
            before = now
        return alpha, scale

    def backward(self, move: np.ndarray, weights: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State posteriors of each item by time, and expected moves."""
        return self.back_over(move, weights, alpha, scale, (0, len(self.running)), None)[:2]

    def back_over(self, move: np.ndarray, weights: np.ndarray, alpha: np.ndarray, scale: np.ndarray, span: tuple[int, int],
                  after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """``backward`` over a span: also what the span before it takes as ``after``; moves over the far border are counted."""
        moves = np.zeros(move.shape)
        turned = np.ascontiguousarray(move.T)
        first, last = span
        for t in range(last - 1, first - 1, -1):
            n, lo = int(self.running[t]), self.at[t] - self.at[first]
            now = alpha[lo:lo + n]
            beta = np.ones_like(now)
            if after is not None:
                beta[:len(after)] = after @ turned
                moves += now[:len(after)].T @ after
            here = weights[lo:lo + n] * beta
            here /= scale[lo:lo + n, None]
            now *= beta
            after = here
        return alpha, moves * move, after

    def expected(self, model: Hmm, items: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Classes, their state posteriors and expected moves, span by span from the last; the last told begins the sequences.

        Only the shares at the borders are kept from the way forward; inside a span they are computed again.
        """
        seen, spans = self.by_time(self.flat), self.spans(items)

        def ahead(span: tuple[int, int], before: np.ndarray | None) -> tuple[np.ndarray, ...]:
            classes = seen[self.at[span[0]]:self.at[span[1]]]
            weights = model.emit[classes]
            return classes, weights, *self.forward(model.start, model.move, weights, span, before)

        borders: list[np.ndarray | None] = [None]
        for span in spans[:-1]:
            alpha = ahead(span, borders[-1])[2]
            borders.append(alpha[-int(self.running[span[1] - 1]):].copy())
        after = None
        for span, before in zip(reversed(spans), reversed(borders)):
            classes, weights, alpha, scale = ahead(span, before)
            share, moves, after = self.back_over(model.move, weights, alpha, scale, span, after)
            yield classes, share, moves

    def log10_scales(self, model: Hmm, weights: Callable[[int, int], np.ndarray], items: int) -> np.ndarray:
        """By sequence as given, the log10 of what the forward recursion takes out; ``weights`` gives those of items by time."""
        total, before = np.zeros(len(self.lengths)), None
        for first, last in self.spans(items):
            lo, hi = self.at[first], self.at[last]
            alpha, scale = self.forward(model.start, model.move, weights(lo, hi), (first, last), before)
            before = alpha[-int(self.running[last - 1]):].copy()
            rank = np.arange(lo, hi) - np.repeat(self.at[first:last], self.running[first:last])
            total += np.bincount(rank, np.log10(scale), len(total))
        out = np.empty(len(total))
        out[self.order] = total
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def coded_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct words, the place of each word of all texts among them, and the words by text.

    A-Z are lower-cased; words are parted by ASCII white space.
    """
    joined = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    inside = ~_SPACE[joined]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(ends - begins, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    coded = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    borders = np.cumsum([len(x) + 1 for x in texts])
    return hashes, coded.indices.to_numpy(), np.diff(np.searchsorted(begins, borders), prepend=0).astype(np.int32)


def _width(words: int) -> int:
    """Bytes that tell so many words apart."""
    return max(1, -(-(words - 1).bit_length() // 8)) if words else 1


def packed(codes: np.ndarray, words: int) -> bytes:
    """The lowest bytes of all codes, then the next ones; the high ones are mostly equal, which compresses well."""
    return codes.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4)[:, :_width(words)].T.tobytes()


def unpacked(data: memoryview | pa.Buffer, words: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(_width(words), -1)
    codes = np.zeros(planes.shape[1], "<i4")
    codes.view(np.uint8).reshape(-1, 4)[:, :len(planes)] = planes.T
    return codes


def _to_blocks(settings: HmmSettings):
    """Rows of key, fold and text as blocks of coded texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs, held, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            hashes, codes, lengths = coded_words(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([docs], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([lengths.tolist()], pa.list_(pa.int32())), pa.array([packed(codes, len(hashes))], pa.binary()),
                 pa.array([hashes.tobytes()], pa.binary())], ["block", "docs", "held", "lengths", "codes", "words"])

        for batch in slices(batches):
            kind = batch.schema.field(0).type
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch.column(2))):
                docs.append(doc)
                held.append(out)
                texts.append(text)
                size += len(text) + 100
                if size >= settings.block_bytes:
                    yield block()
                    number, docs, held, texts, size = number + 1, [], [], [], 0
        if docs:
            yield block()

    return run


@dataclass(frozen=True)
class Block:
    held: np.ndarray
    lengths: np.ndarray  # words by text
    codes: np.ndarray  # of all texts in turn, places in ``words``
    words: np.ndarray  # distinct, as hashes

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def chunks(self, texts: np.ndarray, classes: np.ndarray, end: int, tokens: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Some of the texts with their classes and ends, about so many tokens at a time; long texts go together."""
        begun = np.cumsum(self.lengths) - self.lengths
        ranked = texts[np.argsort(-self.lengths[texts], kind="stable")]
        parts = np.cumsum(self.lengths[ranked] + 1) // tokens
        for part in np.split(ranked, np.flatnonzero(np.diff(parts)) + 1):
            if len(part):
                yield part, [np.append(classes[self.codes[begun[i]:begun[i] + self.lengths[i]]], np.int32(end)) for i in part]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for row in slices(batches, 1):
        value = lambda name: row.column(name)[0]
        words = np.frombuffer(value("words").as_buffer(), np.uint64)
        yield row, Block(value("held").values.to_numpy(zero_copy_only=False), value("lengths").values.to_numpy(),
                         unpacked(value("codes").as_buffer(), len(words)), words)


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, b in _blocks(batches):
        c = np.bincount(b.codes[~np.repeat(b.held, b.lengths)], minlength=len(b.words))
        met = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(b.words[met].view(np.int64)), pa.array(c[met], pa.int64())], ["word", "c"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, b in _blocks(batches):
        block = np.full(len(b.words), row.column("block")[0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.arange(len(b.words), dtype=np.int32)),
                                          pa.array(b.words.view(np.int64))], ["block", "i", "word"])


RANGE = 512  # classes whose sums travel in one row


def _by_class(emitted: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums by state as rows of ``RANGE`` classes; the moves of each state, then the starts, as range -1."""
    if not emitted.any():
        return
    sums = emitted.T.astype(np.float32)
    rows = {i // RANGE: sums[i:i + RANGE].tobytes() for i in range(0, len(sums), RANGE)}
    rows[-1] = np.concatenate([moves, starts[None, :]]).astype(np.float32).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.int32()), pa.array(rows.values(), pa.binary())], ["k", "sums"])


def _add_up(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in rows.column("sums"))
    return pa.table({"k": rows.column("k").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _expectation(model: Hmm, classes: Classes, settings: HmmSettings):
    """Expected emissions, moves and starts of the training texts."""
    small = Hmm(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = settings.states
        emitted, moves, starts = np.zeros((states, classes.end + 1)), np.zeros((states, states)), np.zeros(states)
        for _, b in _blocks(batches):
            for part, texts in b.chunks(np.flatnonzero(~b.held), classes.of(b.words), classes.end, settings.chunk_tokens):
                for seen, share, moved in Lattice(texts).expected(small, 2 * settings.chunk_tokens):
                    moves += moved
                    for s in range(states):
                        emitted[s] += np.bincount(seen, share[:, s], classes.end + 1)
                starts += share[:len(part)].sum(axis=0)
        yield from _by_class(emitted, moves, starts)

    return run


def _leaning(pull: np.ndarray, mean: np.ndarray, classes: Classes, settings: HmmSettings):
    """Class counts of the training texts by the state that a text's words pull to most, beyond what its length explains."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = settings.states
        emitted = np.zeros((states, classes.end + 1))
        for _, b in _blocks(batches):
            seen, text = classes.of(b.words)[b.codes], b.text_of
            pulls = np.stack([np.bincount(text, pull[:, s][seen], len(b.lengths)) for s in range(states)], axis=1)
            state = np.argmax(pulls - b.lengths[:, None] * mean, axis=1)
            for s in range(states):
                mine = ~b.held & (state == s)
                emitted[s] += np.bincount(seen[np.repeat(mine, b.lengths)], minlength=classes.end + 1)
                emitted[s, -1] += mine.sum()
        yield from _by_class(emitted, np.zeros((states, states)), np.zeros(states))

    return run


def _summed(blocks: DataFrame, function, classes: Classes, settings: HmmSettings) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all tasks: by class and state, and the moves and starts; as many rows as classes."""
    told = blocks.select("held", "lengths", "codes", "words").mapInArrow(tidy(function), "k int, sums binary") \
        .groupBy("k").applyInArrow(_add_up, "k int, sums binary").toArrow()
    emitted, small = np.zeros((classes.end + 1, settings.states)), np.zeros((settings.states + 1, settings.states))
    for k, sums in zip(told.column("k").to_pylist(), told.column("sums").to_pylist()):
        value = np.frombuffer(sums, np.float64).reshape(-1, settings.states)
        if k < 0:
            small[:] = value
        else:
            emitted[k * RANGE:k * RANGE + len(value)] = value
    return emitted, small


def _first_guess(blocks: DataFrame, common: np.ndarray, classes: Classes, settings: HmmSettings) -> Hmm:
    """Each state begins with the training texts that lean its way: first in a fixed random projection of their words, then by likelihood."""
    states = settings.states
    rarity = -np.log(np.where(common > 0, common, 1.0))
    pull = np.random.default_rng(0).standard_normal((len(common), states)) * rarity[:, None]
    mean = common[:-1] @ pull[:-1] / max(common[:-1].sum(), 1e-9)
    for _ in range(1 + settings.seed_rounds):
        own, _ = _summed(blocks, _leaning(pull.astype(np.float32), mean, classes, settings), classes, settings)
        emit = (own + settings.prior * common[:, None]) / (own.sum(axis=0) + settings.prior)
        pull, mean = np.log(np.where(emit > 0, emit, 1.0)), np.zeros(states)
    move = np.full((states, states), (1 - settings.stay) / max(1, states - 1))
    np.fill_diagonal(move, settings.stay if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, 0.5 * common[:, None] + 0.5 * emit)


def improved(model: Hmm, emitted: np.ndarray, moves: np.ndarray, starts: np.ndarray, common: np.ndarray, prior: float) -> Hmm:
    """The model that expected counts call for."""
    move, start = moves + 0.1, starts + 0.1
    emit = (emitted + prior * common[:, None]) / (emitted.sum(axis=0) + prior)
    return Hmm(start / start.sum(), move / move.sum(axis=1)[:, None], emit)


def baum_welch(blocks: DataFrame, class_counts: np.ndarray, classes: Classes, settings: HmmSettings) -> Hmm:
    """Train on the texts of all blocks outside the held-out fold; ``class_counts`` tells how often each class occurs there."""
    common = class_counts / max(class_counts.sum(), 1)
    model = _first_guess(blocks, common, classes, settings)
    for _ in range(settings.rounds):
        emitted, small = _summed(blocks, _expectation(model, classes, settings), classes, settings)
        model = improved(model, emitted, small[:-1], small[-1], common, settings.prior)
    return model


def coded_blocks(docs: DataFrame, key: str, text: str, held_out: tuple[int, int], settings: HmmSettings) -> DataFrame:
    """All texts, coded, in a table of blocks; a null text is empty."""
    base = docs.select(F.col(key).alias("doc"), in_fold(key, *held_out).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = (f"block long, docs array<{dict(docs.dtypes)[key]}>, held array<boolean>, lengths array<int>, codes binary, words binary")
    return written(base.mapInArrow(tidy(_to_blocks(settings)), kind), "word-blocks")


def score_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (7, 2),
                settings: HmmSettings = HmmSettings()) -> DataFrame:
    """Per row: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model and all counts come from every row outside the held-out fold; a row without a key is in no fold.  A null or empty
    text is its end alone.  ``base_score`` is the add-one unigram score, ``score`` the log10 probability of the whole text:
    words that training has not seen are one symbol, with the share of words that it has seen once.  Repeated rows
    are scored each.  An empty table gives no rows, and without training rows every token is that symbol.  Words are
    told apart by 64-bit hashes.  A text of any length stands in one block; its recursions keep one span at a time.
    """
    blocks = coded_blocks(docs, key, text, held_out, settings)
    counts = written(blocks.select("held", "lengths", "codes", "words").mapInArrow(tidy(_train_counts), "word long, c long")
                     .groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    words, kinds, once = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long"))).first())
    tokens, vocabulary, once = words + ends, kinds + (1 if ends else 0), once + (1 if ends == 1 else 0)
    unseen = (once + 1) / (tokens + 2) if tokens else 1.0

    rare = settings.classes or 1 << (32 * isqrt(kinds)).bit_length()
    frequent = F.col("c") * rare >= tokens  # at most as many words as there are rare classes
    owners = counts.where(frequent).toArrow()
    hashes = owners.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    classes = Classes(rare, hashes[order])
    by_class = counts.where(~frequent).groupBy(F.pmod("word", F.lit(rare)).cast("int").alias("k")).agg(F.sum("c").alias("c")).toArrow()
    totals = np.zeros(classes.end + 1)
    totals[by_class.column("k").to_numpy()] = by_class.column("c").to_numpy()
    totals[rare:-1] = owners.column("c").to_numpy()[order]
    totals[-1] = ends
    model = baum_welch(blocks, totals, classes, settings)

    answers = blocks.select("block", "held", "lengths", "codes", "words").mapInArrow(tidy(_asked), "block long, i int, word long") \
        .join(counts, "word").select("block", "i", "c")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        (row, b), = _blocks(left.to_batches())
        count = np.zeros(len(b.words) + 1)  # the end is a word more
        count[right.column("i").to_numpy()] = right.column("c").to_numpy()
        count[-1] = ends
        kind = np.append(classes.of(b.words), np.int32(classes.end))
        known = count > 0
        plain = np.log10((count + 1) / (tokens + vocabulary + 1))
        inside = np.log10(np.where(known, count / np.maximum(totals[kind], 1) * (1 - unseen), unseen))
        # A class more, for words that are not known: every state emits them alike.
        emit = np.concatenate([model.emit, np.ones((1, settings.states))])
        seen = np.where(known, kind, classes.end + 1).astype(np.int32)
        n, text_of = len(b.lengths), b.text_of
        summed = lambda x: np.bincount(text_of, x[b.codes], n) + x[-1]
        total = summed(inside)
        for part, texts in b.chunks(np.arange(n), seen[:-1], int(seen[-1]), settings.chunk_tokens):
            lattice = Lattice(texts)
            by_time = lattice.by_time(lattice.flat)
            total[part] += lattice.log10_scales(model, lambda lo, hi: emit[by_time[lo:hi]], settings.chunk_tokens // 2)
        returned()
        return pa.table([row.column("docs").flatten(), row.column("held").flatten(), pa.array(b.lengths.astype(np.int64) + 1),
                         pa.array(np.rint(summed(known.astype(float))).astype(np.int64)), pa.array(np.full(n, tokens, np.int64)),
                         pa.array(summed(plain)), pa.array(total)], names=names)

    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, kind)
