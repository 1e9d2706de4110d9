"""Language identification by nearest centroid.

A text is a vector of letter n-gram counts in hashed cells, weighted by TF-IDF and normalised.  Every language has several
centroids, found by spherical k-means over a bounded sample of its labelled texts; a text gets the language of the centroid
with the largest cosine.  A text that lies much farther from its centroid than labelled texts of its length did is
rejected, and so is one that has no letter of the labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, in_fold, tidy, written

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangSettings:
    cells: int = 1 << 13
    orders: tuple[int, ...] = (1, 2, 3)
    centroids: int = 4  # per language
    sample_per_lang: int = 1000  # labelled texts per language, in expectation, that k-means sees: the documented bound
    rounds: int = 10
    slack: float = 0.5  # a text is rejected below this share of the smallest cosine that labelled texts of its length had
    least_grams: int = 128  # a shorter text must also lie below what longer labelled texts had


LENGTH_CLASSES = 32  # powers of two of the count of n-grams


def letters(text: str) -> np.ndarray:
    """Code points in lower case; whatever is no letter is a blank, runs of blanks are one, and one stands at each end."""
    if text.isascii():
        points = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
        alpha = (points >= 97) & (points <= 122)
    else:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = (points >= 97) & (points <= 122)
        odd = np.flatnonzero(points >= 128)
        kinds, back = np.unique(points[odd], return_inverse=True)
        alpha[odd] = np.array([chr(k).isalpha() for k in kinds.tolist()], bool)[back]
    points = np.where(alpha, points, 32)
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    return points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]


def grams(text: str, settings: LangSettings) -> np.ndarray:
    """The cell of each n-gram that has a letter."""
    points = letters(text)
    if not (points != 32).any():
        return np.empty(0, np.int64)
    out = []
    for n in settings.orders:
        if len(points) < n:
            continue
        mixed = np.full(len(points) - n + 1, n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ points[k:len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        if n == 1:
            mixed = mixed[points != 32]
        out.append(mixed % np.uint32(settings.cells))
    return np.concatenate(out).astype(np.int64)


def vectors(texts: list[str | None], weight: np.ndarray, settings: LangSettings) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF vectors with damped counts, and how many n-grams each text has."""
    out = np.zeros((len(texts), settings.cells), np.float32)
    count = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        cells = grams(text, settings) if text else ()
        count[i] = len(cells)
        if len(cells):
            np.sqrt(np.bincount(cells, minlength=settings.cells), out=out[i], casting="unsafe")
    out *= weight
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.where(norm > 0, norm, 1)[:, None]
    return out, count


def _document_frequency(settings: LangSettings):
    """Texts by cell; below them, as cell -1, all texts, and as -2 and so on the letters met, by code point."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, known = np.zeros(settings.cells, np.int64), 0, set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                cells = grams(text, settings) if text else ()
                if len(cells):
                    seen += np.bincount(cells, minlength=settings.cells) > 0
                    docs += 1
                    known.update(text.lower())
        if docs:
            points = [ord(c) for c in known if c.isalpha()]
            cell = np.concatenate([np.flatnonzero(seen), [-1], -2 - np.array(points, np.int64)])
            told = np.concatenate([seen[seen > 0], [docs], np.ones(len(points), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(told, pa.int64())], ["cell", "docs"])

    return run


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids.  It starts from the text nearest to the mean and goes on with those farthest from all chosen."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        for j in range(len(centre)):
            if (own == j).any():
                total = x[own == j].sum(axis=0)
                centre[j] = total / max(np.linalg.norm(total), 1e-12)
    return centre


@dataclass(frozen=True)
class LangModel:
    settings: LangSettings
    weight: np.ndarray  # by cell
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    floor: np.ndarray  # by length class, the cosine below which a text is rejected
    known: frozenset[str]  # letters of the labelled texts

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine, whether rejected."""
        out = []
        for at in range(0, len(texts), 256):
            x, count = vectors(texts[at:at + 256], self.weight, self.settings)
            cosine = x @ self.centroids.T if len(self.langs) else np.zeros((len(x), 1), np.float32)
            best = np.argmax(cosine, axis=1)
            top = np.clip(cosine[np.arange(len(x)), best], 0, 1)
            low = top < self.floor[_length_class(count)]
            for i in np.flatnonzero(count):
                low[i] |= not any(c in self.known for c in texts[at + i].lower())
            out += [(self.langs[b] if self.langs and n else UNDETERMINED, float(c) if n else 0.0, bool(r) or not n or not self.langs)
                    for b, c, n, r in zip(best.tolist(), top.tolist(), count.tolist(), low.tolist())]
        return out


def _length_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(count, 0).astype(np.float64))[1], LENGTH_CLASSES - 1)


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
          settings: LangSettings = LangSettings()) -> LangModel:
    """Fit a model to labelled rows.

    Document frequencies count all of them.  K-means sees about ``sample_per_lang`` texts of each language, chosen
    by a hash of key and text, so which ones depends on nothing else; each language is a task of its own.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("draw"))
    found = rows.select("text").mapInArrow(tidy(_document_frequency(settings)), "cell long, docs long").groupBy("cell").agg(F.sum("docs"))
    seen = {r[0]: r[1] for r in found.collect()}  # a row per cell
    total = seen.pop(-1, 0)
    known = frozenset(chr(-2 - cell) for cell in seen if cell < -1)
    seen = {cell: n for cell, n in seen.items() if cell >= 0}
    weight = np.zeros(settings.cells, np.float32)
    for cell, n in seen.items():
        weight[cell] = np.log((1 + total) / (1 + n)) + 1
    weight[weight == 0] = np.log(1 + total) + 1
    share = rows.groupBy("lang").agg((F.lit(float(settings.sample_per_lang)) / F.count(F.lit(1))).alias("share"))
    drawn = rows.join(F.broadcast(share), "lang").where(  # a row per language
        (F.pmod("draw", F.lit(1_000_003)) / 1_000_003.0) < F.col("share")).select("lang", "draw", "text")

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, count = vectors(batch.column(2).to_pylist(), weight, settings)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(count)],
                ["lang", "draw", "vector", "grams"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["grams"] > 0].sort_values("draw")
        if not len(group):
            return pd.DataFrame({"lang": [], "centroid": [], "low": []})
        x = np.frombuffer(b"".join(group["vector"]), np.float32).reshape(len(group), -1)
        centre = spherical_kmeans(x, settings.centroids, settings.rounds)
        cosine = (x @ centre.T).max(axis=1)
        low = np.full(LENGTH_CLASSES, np.inf)
        np.minimum.at(low, _length_class(group["grams"].to_numpy()), cosine)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.tobytes() for c in centre],
                             "low": [low.astype("<f8").tobytes()] * len(centre)})

    sample = drawn.mapInArrow(tidy(vectorise), "lang string, draw long, vector binary, grams long")
    fitted = written(sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, low binary"), "lang-centroids")
    got = fitted.orderBy("lang", "centroid").collect()  # a few rows per language
    low = np.full(LENGTH_CLASSES, np.inf)
    for row in got:
        low = np.minimum(low, np.frombuffer(row["low"], "<f8"))
    # A class without labelled texts takes the floor of the next shorter one that has some.
    floor, last = np.zeros(LENGTH_CLASSES), 0.0
    for k in range(LENGTH_CLASSES):
        short = k < int(settings.least_grams).bit_length()
        last = settings.slack * (low[k:].min() if short else low[k]) if np.isfinite(low[k]) else last
        floor[k] = last
    centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in got]).reshape(len(got), settings.cells)
    return LangModel(settings, weight, [r["lang"] for r in got], centroids, floor, known)


def with_language(docs: DataFrame, model: LangModel, verdict: str, *, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``verdict`` of ``lang``, ``score`` and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text where nothing was
    learned.  A text whose letters were all unseen there is rejected.  Repeated rows are judged alike; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # cells times centroids
    kind = "struct<lang:string,score:double,rejected:boolean>"
    arrow = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    out = docs.withColumn(verdict, F.lit(None).cast(kind))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [{"lang": a, "score": s, "rejected": r} for a, s, r in held.value.judge(batch.column(text).to_pylist())]
            yield batch.set_column(batch.schema.get_field_index(verdict), verdict, pa.array(told, arrow))

    return out.mapInArrow(tidy(judge), out.schema)


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: tuple[int, int] = (3, 1),
             settings: LangSettings = LangSettings()) -> DataFrame:
    """Per row: key, ``held_out``, ``lang_pred``, ``score``, ``rejected``; the model learns from the other folds of the rows.

    A row without a key is in no fold and is learned from.
    """
    parts, part = held_out
    model = train(docs.where(~in_fold(key, parts, part)), key=key, text=text, lang=lang, settings=settings)
    base = docs.select(F.col(key).alias("doc"), in_fold(key, parts, part).alias("held_out"), F.col(text).alias("text"))
    judged = with_language(base, model, "verdict", text="text")
    return judged.select(F.col("doc").alias(key), "held_out", F.col("verdict.lang").alias("lang_pred"),
                         F.col("verdict.score").alias("score"), F.col("verdict.rejected").alias("rejected"))


def drop_unidentified(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
                      held_out: tuple[int, int] = (3, 1), settings: LangSettings = LangSettings()) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    model = train(docs.where(~in_fold(key, *held_out)), key=key, text=text, lang=lang, settings=settings)
    verdict, = fresh(docs, "verdict")
    return with_language(docs, model, verdict, text=text).where(~F.col(f"{verdict}.rejected")).drop(verdict)
