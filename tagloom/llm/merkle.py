"""Merkle manifest of a dataset by slot pivots.

The rows of a language are the leaves of a tree, the languages' subroots those of another.  Every level is one grouping: the
children of a parent are spread over ``fanout`` columns by conditional aggregates, one for each slot.  All columns in
a row make the parent's digest, all but the own one the siblings of a child.  Paths then go down from the root: a group
meets the path of its parent once, and its children, at most ``fanout`` of them, each put their own siblings in front.

Leaves are numbered over range partitions, so that a language may hold any share of the rows; no window, group or task
grows with a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<l:string,r:string>>"


def field_text(value: Column) -> Column:
    """A field as the leaf sees it: its length in UTF-8 bytes, a colon and the value, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, group: str, order: list[str], out: str, purpose: str) -> DataFrame:
    """Add ``out``, the place from 0 of a row within its group, groups being neighbours in the order of rows.

    Rows are dealt by ranges of (group, order) and sorted there; a row's place is that within its partition, less the first
    one of its group there, plus the group's rows in earlier partitions.  Those are one row per partition and group.
    """
    placed = written(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                     .withColumn("_at", F.monotonically_increasing_id()), purpose)
    part = F.shiftright("_at", 33).alias("_part")
    shares = placed.groupBy(group, part).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shares.select(group, "_part", (before - F.col("_first")).alias("_start"))
    return placed.withColumn("_part", part).join(starts, [group, "_part"]).withColumn(out, F.col("_at") + F.col("_start")).drop(
        "_at", "_part", "_start")


def _pivot(nodes: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """One row per (tree, parent): column ``c<slot>`` is that child's digest with the columns to carry, or null."""
    slot = F.col("place") % fanout
    child = F.struct("digest", *carried)
    return nodes.groupBy("tree", F.shiftright("place", fanout.bit_length() - 1).alias("parent")).agg(
        *[F.max(F.when(slot == j, child)).alias(f"c{j}") for j in range(fanout)])


def _joined(slots) -> Column:
    parts = [F.coalesce(F.col(f"c{j}.digest"), F.lit("")) for j in slots]
    return F.concat(*parts) if parts else F.lit("")


def _children(pivot: DataFrame, paths: DataFrame, fanout: int) -> DataFrame:
    """Each child of a pivot row with ``place`` and ``path``: its siblings left and right, level by level up to the root."""
    met = pivot.join(paths.select("tree", F.col("place").alias("parent"), "path"), ["tree", "parent"])
    each = [F.when(F.col(f"c{j}").isNotNull(), F.struct(
        (F.col("parent") * fanout + j).alias("place"), F.col(f"c{j}").alias("child"),
        _joined(range(j)).alias("l"), _joined(range(j + 1, fanout)).alias("r"))) for j in range(fanout)]
    opened = met.select("tree", "path", F.explode(F.array_compact(F.array(*each))).alias("e"))
    own = F.array(F.struct(F.col("e.l").alias("l"), F.col("e.r").alias("r")))
    return opened.select("tree", "e.place", F.concat(own, "path").alias("path"), "e.child.*")


def _levels(nodes: DataFrame, fanout: int, purpose: str, *carried: str) -> list[DataFrame]:
    """The pivots of all trees, lowest first, each read from a table; ``nodes`` have ``tree``, ``place``, ``size``, ``digest``.

    ``size`` is the number of nodes of a tree at the level, so a tree of one node is done and drops out.
    """
    levels, most = [], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        sizes = F.max("size").alias("size")
        grouped = _pivot(nodes.where("size > 1"), fanout, *carried)
        counts = nodes.where("size > 1").groupBy("tree").agg(sizes)
        # the size goes along as a column of the pivot, from the few rows of trees
        levels.append(written(grouped.join(counts, "tree"), purpose))
        carried = ()
        up = F.ceil(F.col("size") / fanout).cast("long")
        nodes = levels[-1].select("tree", F.col("parent").alias("place"), up.alias("size"), digest(_joined(range(fanout))).alias("digest"))
        most = -(-most // fanout)
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame], fanout: int) -> DataFrame:
    """``(tree, height, digest)``: the one node that remains of each tree, ``height`` levels above its leaves."""
    tops = nodes.where("size = 1").select("tree", F.lit(0).alias("height"), "digest")
    for height, level in enumerate(levels, 1):
        tops = tops.unionByName(level.where(F.col("size") <= fanout).select(
            "tree", F.lit(height).alias("height"), digest(_joined(range(fanout))).alias("digest")))
    return tops


def manifest(docs: DataFrame, tampered: Column | None = None, *, key: str = "doc_id", group: str = "lang",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text",
             fanout: int = 8) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A leaf is the digest of the ``fields`` in their order.  Leaves of a ``group`` ascend by ``key``; while there are several
    nodes, every ``fanout`` of them (a power of two; the last ones may be fewer) become the digest of their digests.  The
    groups' subroots, null first and then bytewise, likewise make the root.  ``proof_sha256`` is the digest of a leaf's
    siblings from the lowest level up, ``folded_root`` what the siblings make of the leaf as it is found:
    where ``tampered`` holds, with A-Z of ``text`` lower-cased.  ``verified`` tells whether that is the root.

    A null field is ``-``, an empty one ``0:``.  Rows with a null key come first in their group; rows that share a key are
    ordered by their digests, and equal rows each are a leaf.  A leaf that is alone in its group is the subroot, a group that is alone
    makes the root, and the proof of a leaf without siblings is the digest of nothing.  An empty table gives no rows.
    Columns other than the fields are not read.
    """
    if fanout < 2 or fanout & (fanout - 1):
        raise ValueError("fanout must be a power of two")
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    whole = [field_text(F.col(c)) for c in fields]
    found = [field_text(F.translate(F.col(c), UPPER, LOWER)) if c == text else w for c, w in zip(fields, whole)]
    # A name of a group that sorts as the contract orders groups, null before all.
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(key).alias("id"),
                         digest(*whole).alias("digest"), F.when(tampered, digest(*found)).alias("found"))
    placed = numbered(leaves, "tree", ["id", "digest"], "place", "manifest-leaves")
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    nodes = written(placed.join(sizes, "tree"), "manifest-nodes")
    levels = _levels(nodes, fanout, "manifest-level", "id", "found")
    tops = written(_tops(nodes, levels, fanout), "manifest-subroots")

    # The tree over the subroots, as one tree of its own.
    heads = numbered(tops.select("tree", "height", "digest").withColumn("all", F.lit("")), "all", ["tree"], "place", "manifest-heads")
    count = tops.agg(F.count(F.lit(1)).alias("size"))
    heads = written(heads.withColumnRenamed("tree", "name").withColumnRenamed("all", "tree").withColumn("size", count.scalar()),
                    "manifest-heads")
    upper = _levels(heads, fanout, "manifest-top", "name", "height")
    root = _tops(heads, upper, fanout).select("digest").scalar()
    nothing = F.array().cast(_PATH)
    paths = heads.where("size = 1").select("tree", "place", nothing.alias("path"), "digest", "name", "height") if not upper else None
    for level in reversed(upper):
        above = level.where(F.col("size") <= fanout).select("tree", F.col("parent").alias("place"), nothing.alias("path")) if paths is None else paths
        paths = _children(level, above, fanout)
    heads = written(paths.select(F.col("name").alias("tree"), "height", F.lit(0).cast("long").alias("place"), "path",
                                 F.col("digest").alias("subroot"), root.alias("root")), "manifest-paths")

    # Down again: the trees of a height join at that level.
    down = None
    for height in range(len(levels), 0, -1):
        start = heads.where(F.col("height") == height).select("tree", "place", "path")
        down = _children(levels[height - 1], start if down is None else down.unionByName(start), fanout)
        if height > 1:
            down = written(down.select("tree", "place", "path"), "manifest-down")
    lone = nodes.where("size = 1").join(heads.select("tree", "path"), "tree").select("tree", "path", "digest", "id", "found")
    rows = lone if down is None else down.select(*lone.columns).unionByName(lone)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["l"], p["r"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("found", "digest"), lambda acc, p: F.sha2(F.concat(p["l"], acc, p["r"]), 256))
    done = rows.select("tree", "id", "digest", proof.alias("proof_sha256"), folded.alias("folded_root")).join(
        heads.select("tree", "subroot", "root"), "tree")
    return done.select(F.col("id").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_third(key: str = "doc_id") -> Column:
    """Where 3 divides the crc32 of the key's decimal text."""
    return F.crc32(F.col(key).cast("string")) % 3 == 0
