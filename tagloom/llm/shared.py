"""What several operators share: scratch tables, files in a shared store, words and token ids."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java class, and the bytes that ``bytes.split()`` splits at.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor sees.

    Without that setting a local session gets a temporary folder; a cluster is refused, since its executors would
    not see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: later reads don't repeat what made them."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """Outlives the task in a reused Python worker; functions travel by value, so module globals don't."""
    return sys.__dict__.setdefault("_llm_worker_cache", {})


def put_file(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file under a name of its own, then move it: a repeated or speculative task leaves one whole file."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft, size = f"{path}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(draft, path)
    return size


def open_file(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def in_fold(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key never does."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def column_bytes(column: pa.Array) -> list[bytes]:
    """Text as UTF-8 bytes, null as none."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """xxHash64 of each word met lately, by the word; bounded, and emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 60_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def returned() -> None:
    """Give memory that freed values leave behind back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(function: Callable) -> Callable:
    """A function over record batches that gives its memory back when its task ends."""
    def run(batches):
        yield from function(batches)
        returned()
    return run


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased, parted by ASCII white space."""
    known = worker_cache().setdefault("word hashes", WordHashes())
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


#: Of an Arrow batch; a task holds its rows several times over, in the JVM, in the worker and as Python values.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about ``BATCH_BYTES``, a longer row alone.  A bound of the session's own stays."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in spark.conf.getAll:
        spark.conf.set(bound, BATCH_BYTES)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterable[pa.RecordBatch]:
    """Record batches in parts, so that little more than a part is held as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(10_000) if (n := f"_{w}{i or ''}").lower() not in taken) for w in wanted]


# White space beyond ASCII as the pre-tokenizers see it, in UTF-8.
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_OTHER, _SPACE, _MARK, _LETTER = range(4)
MET_PIECES = 120_000  # that an encoder remembers


def _byte_kinds() -> np.ndarray:
    """What a byte is: white space, a letter, a mark that surely parts from a letter before it, or anything else."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[0x21:0x7F] = _MARK
    for first in b"Aa":
        kinds[first:first + 26] = _LETTER
    return kinds


class Encoder:
    """Token ids by the tokenizers library, each distinct piece of text in a batch encoded once.

    A text is cut where every pre-tokenizer cuts it, whatever stands around: at white space, and after the first letters of
    a word where a mark follows.  So the ids of a text are those of its pieces in a row.  Cuts are found on
    the bytes of all texts at once, pieces are numbered by a dictionary of the batch, and their ids gathered.
    """

    def __init__(self, path: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # every core has a task of its own
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space, self.kinds = Tokenizer.from_file(path), keep_space, _byte_kinds()
        self.met: dict[str, bytes] = {}  # pieces that came more than once in an earlier batch, the recent ones
        self.old: dict[str, bytes] = {}  # and those before them
        self.word = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        wide = re.compile(_WIDE_SPACE.pattern.decode("latin-1"))
        self.wide = lambda piece: not piece.isascii() and wide.search(piece.encode().decode("latin-1"))
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of a token, in vocabularies that spell bytes by letters
        self.last = None  # whether a token ends a word, in vocabularies that mark it
        for token, number in vocabulary.items():
            self.bytes[number] = len(token)
        ends = [i for t, i in vocabulary.items() if t.endswith("</w>")]
        if ends:
            self.last = np.zeros(len(self.bytes), bool)
            self.last[ends] = True

    def _cuts(self, blob: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Where pieces begin in ``blob``, which holds the texts between ``edges``; and again, in the bytes of pieces alone.

        Vocabularies that keep no white space give it no ids, so it is in no piece.
        """
        data = np.frombuffer(blob, np.uint8)
        kinds = self.kinds[data]
        # À to ÿ but for the two signs among them: C3 and a byte from 80 on.
        first = np.flatnonzero(data[:-1] == 0xC3)
        first = first[(data[first + 1] != 0x97) & (data[first + 1] != 0xB7)]
        kinds[first] = kinds[first + 1] = _LETTER
        space = kinds == _SPACE
        begin = np.empty(len(data), bool)
        if self.keep_space:  # before white space, unless that only goes on
            for wide in _WIDE_SPACE.finditer(blob):
                space[wide.end() - 1] = True
            begin[1:] = (kinds[1:] == _SPACE) & ~space[:-1]
        else:
            begin[1:] = space[:-1] & ~space[1:]
        first = edges[:-1][edges[:-1] < len(data)]
        begin[first] = True if self.keep_space else ~space[first]
        # A mark right after letters, with nothing but letters since the white space in front of the piece.
        marks = np.flatnonzero((kinds[1:] == _MARK) & (kinds[:-1] == _LETTER)) + 1
        marks = marks[~begin[marks]]
        at = np.flatnonzero(begin)
        own = at[np.searchsorted(at, marks, side="right") - 1]
        strange = np.cumsum((kinds != _LETTER) & (kinds != _SPACE), dtype=np.int32)
        clear = strange[marks - 1] - strange[own] + ((kinds[own] != _LETTER) & (kinds[own] != _SPACE)) == 0
        begin[marks[clear]] = True
        cuts = np.flatnonzero(begin).astype(np.int32)
        if self.keep_space:
            return cuts, cuts, blob
        solid = kinds != _SPACE
        return cuts, np.cumsum(solid, dtype=np.int32)[cuts] - 1, data[solid].tobytes()

    def _each(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), 10_000):  # the library holds far more of a piece than its ids
            coded = self.tokenizer.encode_batch_fast(pieces[at:at + 10_000], add_special_tokens=False)
            out += [array("I", c.ids).tobytes() for c in coded]
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece.  Many go as one line, which costs far less than one by one, where its ids tell them apart."""
        out: list[bytes] = [b""] * len(pieces)
        if self.keep_space:  # white space in front, and none that could go on in the next one at the end
            joins = [p[0] in " \t\n\r\v\f" and p[-1] not in " \t\n\r\v\f" and not self.wide(p) for p in pieces]
        else:
            joins = list(map(self.word, pieces))
        joined = [i for i, j in enumerate(joins) if j]
        lines = [joined[i:i + 256] for i in range(0, len(joined), 256)]
        others = [i for i, j in enumerate(joins) if not j]
        texts = [("" if self.keep_space else " ").join([pieces[i] for i in x]) for x in lines]
        for line, flat in zip(lines, self._each(texts)):
            ends = self._ends([pieces[i] for i in line], np.frombuffer(flat, np.uint32))
            if ends is None:
                others += line
                continue
            at = 0
            for i, end in zip(line, (4 * ends).tolist()):
                out[i] = flat[at:end]
                at = end
        for i, ids in zip(others, self._each([pieces[i] for i in others])):
            out[i] = ids
        return out

    def _ends(self, pieces: list[str], ids: np.ndarray) -> np.ndarray | None:
        """Where in the ids of a line each piece ends: by the tokens that end words, or by how many bytes tokens stand for."""
        if not self.keep_space:
            ends = np.flatnonzero(self.last[ids]) + 1 if self.last is not None else []
            return ends if len(ends) == len(pieces) and ends[-1] == len(ids) else None
        upto = np.cumsum(self.bytes[ids])
        wanted = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        ends = np.searchsorted(upto, wanted)
        fits = len(upto) and ends[-1] == len(upto) - 1 and (upto[ends] == wanted).all()
        return ends + 1 if fits else None

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8) in a row, and where each text's begin and end."""
        blob = b"".join(texts)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        if not blob:
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        cuts, own, solid = self._cuts(blob, edges)
        offsets = np.append(own, np.int32(len(solid)))
        pieces = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
        often = np.bincount(pieces.indices.to_numpy(), minlength=len(pieces.dictionary)) > 1
        coded = self._known(pieces.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False).tolist(), often.tolist())
        taken = pa.array(coded, pa.binary()).take(pieces.indices)  # their ids in a row
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(own) + 1) // 4
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4", int(ends[-1]))
        return ids, ends[np.searchsorted(cuts, edges)].astype(np.int64)

    def _known(self, pieces: list[str], often: list[bool]) -> list[bytes]:
        """The ids of distinct pieces, remembered ones first; a piece that came only once is not worth its place."""
        coded = list(map(self.met.get, pieces))
        missing = [i for i, ids in enumerate(coded) if ids is None]
        before = [self.old.get(pieces[i]) for i in missing]
        new = iter(self._pieces([pieces[i] for i, ids in zip(missing, before) if ids is None]))
        for i, ids in zip(missing, before):
            coded[i] = next(new) if ids is None else ids
            if often[i] or ids is not None:
                self.met[pieces[i]] = coded[i]
        if len(self.met) > MET_PIECES // 2:
            self.met, self.old = {}, self.met
        return coded

    def documents(self, texts: list[bytes], end_id: int, max_bytes: int) -> Iterable[tuple[int, int, np.ndarray, np.ndarray]]:
        """Texts in batches of about ``max_bytes``: (from, to, ids with ``end_id`` after each text, where each begins and ends).

        A text longer than that is encoded in parts, cut before a blank that follows a visible ASCII character, where every
        pre-tokenizer cuts as well.
        """
        for start, end in ranges_of(texts, max_bytes):
            if end - start == 1 and len(texts[start]) > 2 * max_bytes:
                ids = np.concatenate([self.encode([part])[0] for part in _parts(texts[start], max_bytes)])
                edges = np.array([0, len(ids)])
            else:
                ids, edges = self.encode(texts[start:end])
            yield start, end, np.insert(ids, edges[1:], end_id), edges + np.arange(len(edges))


_BLANK = re.compile(rb"(?<=[!-~])[ \t-\r]")


def _parts(text: bytes, size: int) -> Iterable[bytes]:
    at = 0
    while blank := _BLANK.search(text, at + size):
        yield text[at:blank.start()]
        at = blank.start()
    yield text[at:]


def ranges_of(texts: list[bytes], max_bytes: int) -> Iterable[tuple[int, int]]:
    """The numbers of texts in a row, of about ``max_bytes`` together, or one alone that is longer."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > max_bytes:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def batches_of(columns: list[list], max_bytes: int, text_at: int) -> Iterable[list[list]]:
    """The rows of equally long column lists in slices of about ``max_bytes`` of the text column."""
    start, size = 0, 0
    for i, text in enumerate(columns[text_at]):
        size += len(text)
        if size >= max_bytes:
            yield [c[start:i + 1] for c in columns]
            start, size = i + 1, 0
    if start < len(columns[text_at]):
        yield [c[start:] for c in columns]
