"""Near-duplicates by circulant MinHash.

Two permutations of the 32-bit numbers make a whole signature: the first scatters the shingles, the second is shifted
circularly by k for coordinate k, whose value is the least that any shingle takes.  Bands of coordinates bring likely
pairs together, and the Jaccard similarity of full shingle sets confirms them.

Documents with the same set of shingles are one class, and only its smallest id goes on.  In a bucket the others are
first compared with two hubs, which joins most of what belongs together in a number of pairs that grows as the bucket.
What stays apart inside a bucket is settled by a prefix filter: two sets that are similar enough share one of the few
rarest shingles of either, so only those who do are compared.  No bucket is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column_bytes, fresh, slices, tidy, word_hashes, written

BANDS, ROWS = 32, 5
#: Odd multipliers that mix word hashes into shingle hashes.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, in ascending order.

    A-Z count as lower case and ASCII white space parts words.  A text of fewer words is one shingle, one without words none.
    """
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    mixed = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k:len(hashes) - size + 1 + k]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    mixed *= _END
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    """Coordinate k is the least of pi(sigma(shingle) - k) over the shingles, numbers taken modulo 2^32."""
    scattered = (shingles >> np.uint64(32)).astype(np.uint32)
    scattered = (scattered ^ (scattered >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    scattered ^= scattered >> np.uint32(12)
    out = np.empty(length, np.uint32)
    step = max(1, min(length, 32_768 // max(1, len(scattered))))
    for k in range(0, length, step):
        shifted = scattered[None, :] - np.arange(k, min(k + step, length), dtype=np.uint32)[:, None]
        shifted ^= shifted >> np.uint32(16)
        shifted *= np.uint32(0x85EBCA6B)
        shifted ^= shifted >> np.uint32(13)
        shifted *= np.uint32(0xC2B2AE35)
        out[k:k + step] = shifted.min(axis=1)
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band with its number."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * _END
    for column in coordinates.reshape(bands, rows).T:
        key = (key ^ column.astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(31)
    return key


MARKS = 8


def marks(shingles: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the shingles that fall on it: two sets differ in at least as many shingles as their bits do."""
    bits = np.bincount((shingles % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS).astype(np.uint64) & np.uint64(1)
    return (bits.reshape(MARKS, 64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


_FEATURES = "id long, words long, n long, node binary, bands array<long>"


def _features(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, sets, keys = [], [], []
            for text in column_bytes(batch.column(2)):
                shingles = shingle_set(text, size)
                counts.append(len(shingles))
                sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys.append(band_keys(signature(shingles, bands * rows), bands, rows).view(np.int64) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sets, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["id", "words", "n", "node", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(text, size) for text in column_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                 pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                 pa.array([marks(x) for x in sets], pa.list_(pa.int64()))], ["node", "shingles", "marks"])

    return run


def components(spark: SparkSession, links: DataFrame, purpose: str = "near-components") -> DataFrame:
    """``(node, label)`` of every node of the links ``(a, b)``: the smallest node it is connected with.

    Every round links the larger neighbours of a node to the smallest of all, then the smaller ones among themselves,
    until nothing changes.
    """
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), purpose)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node go to its smallest neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            below.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = written(small, purpose)
        if state(after) == state(edges):
            break
        edges = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough: 100 times the intersection is at least ``percent`` times the union."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(zero_copy_only=False), right[i].values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(compare), "a binary, b binary")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.octet_length(F.col(text)))


def near_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked when their sets of ``size``-word shingles have a Jaccard similarity of at least ``percent``
    hundredths; a component's id is its smallest key, and the row that has it is kept.  A null or empty text has no
    shingles and is linked with nothing, as is a row with a null key, which has a null component and is kept.  Rows that repeat
    a key are judged each by its text.  An empty table gives no rows.  Sets are compared as 64-bit hashes.  A pair at
    exactly 80 hundredths shares no band with probability 3 in a million for the default bands, one at 85 with 2 in a
    hundred million.
    """
    judged = _judged(docs, key, text, size, percent, bands, rows)
    return judged.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _judged(docs: DataFrame, key: str, text: str, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """One row per document: ``id``, ``words`` (a hash of its text), ``n``, ``component``, ``kept``."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), _text_hash(text).alias("words"))
    features = written(base.select("id", "words", "text").mapInArrow(tidy(_features(size, bands, rows)), _FEATURES), "minhash-features")
    usable = features.where(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = written(usable.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                              F.first("bands").alias("bands")), "minhash-classes")
    members = reps.select("node", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = written(members.join(sizes, "band"), "minhash-buckets")
    # Who stands in the most crowded buckets lies in the middle of what is alike, and most of it links with that hub.
    crowd = sized.groupBy("node").agg(F.sum("size").alias("crowd"))
    hubs = sized.join(crowd, "node").groupBy("band").agg(F.max(F.struct("crowd", "node"))["node"].alias("hub"),
                                                         F.min("node").alias("other"))
    placed = written(sized.select("node", "band").join(hubs, "band"), "minhash-hubs")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tested = placed.select(F.explode(F.array(pair("node", "hub"), pair("node", "other"))).alias("p")).select("p.*").where("a <> b").distinct()
    needed = placed.select("node").distinct().join(reps, "node").select(F.col("rep").alias("id")).distinct()
    sets = written(base.join(needed.hint("shuffle_hash"), "id", "left_semi").select("id", "text")
                   .mapInArrow(tidy(_sets(size)), "node binary, shingles array<long>, marks array<long>").dropDuplicates(["node"]), "minhash-sets")
    first = written(_linked(tested, sets, percent), "near-links")
    labels = components(spark, first)
    # Buckets in which more than one component is left, and who is in them.
    told = placed.select("node", "band").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = told.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    open_nodes = written(told.join(apart, "band", "left_semi").select("node", "label").distinct(), "near-open")
    rest = written(_linked(_prefix_pairs(sets.join(open_nodes, "node"), percent), sets, percent), "near-links")
    final = components(spark, first.unionByName(rest))
    linked = reps.join(final, "node").select("node", "rep", "label")
    smallest = linked.groupBy("label").agg(F.min("rep").alias("component"))
    alone = reps.where("copies > 1").join(final, "node", "left_anti").select("node", F.col("rep").alias("component"))
    known = written(linked.join(smallest, "label").select("node", "component").unionByName(alone), "near-components")
    out = features.select("id", "words", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("node")).alias("node")).join(known, "node", "left")
    component = F.coalesce("component", "id")
    return out.select("id", "words", "n", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80,
                     bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that their component keeps.  Where a key is repeated, each row goes or stays by its own text."""
    other, words, own = fresh(docs, "other", "words", "own")
    gone = _judged(docs, key, text, size, percent, bands, rows).where(~F.col("kept")).select(
        F.col("id").alias(other), F.col("words").alias(words)).distinct()
    staged = docs.withColumn(own, _text_hash(text))
    return staged.join(gone, (F.col(key) == F.col(other)) & (F.col(own) == F.col(words)), "left_anti").drop(own)


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different labels that share one of the rarest shingles of both.

    In a common order of shingles, from rare to frequent, let the first one that two sets share stand at place i of the
    one and j of the other.  What they share is then at most 1 + min(m - i, n - j), which sets that are similar enough
    must reach; so places beyond a short prefix need not be looked at, and a row that fails is no first shared shingle
    of a pair that counts.

    Sets that are similar enough also differ in few shingles, and so in few of their ``marks``; the join asks for that
    too, so that only pairs come out of it which mostly are links, however many rows share a shingle.
    """
    each = sets.select(F.col("node").alias("id"), "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(often, "s").groupBy("id", "label", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "s"))).alias("r"))
    lead = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    places = ranked.select("id", "label", "n", F.posexplode(F.slice("r", F.lit(1), lead.cast("int"))).alias("at", "e")).where(
        "e.df > 1").select("id", "label", "n", "at", F.col("e.s").alias("s"))
    bits = [f"m{i}" for i in range(MARKS)]
    prefix = places.join(sets.select(F.col("node").alias("id"), *[F.col("marks")[i].alias(m) for i, m in enumerate(bits)]), "id")
    a = prefix.select("s", *[F.col(c).alias(f"{c}_a") for c in ("id", "label", "n", "at", *bits)])
    b = prefix.select("s", *[F.col(c).alias(f"{c}_b") for c in ("id", "label", "n", "at", *bits)])
    differ = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in bits), F.lit(0))
    alike = differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # places count from 0
    enough = most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    return a.join(b, "s").where((F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b")) & enough & alike).select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
