"""Ordered operators that survive hot keys.

A plain ``lag`` or running sum over ``partitionBy(key)`` puts a whole key into
one task.  The helpers here cut the order column, a unique integer, into
slices of ``2**slice_bits`` values.  A (key, slice) group then holds at most
``2**slice_bits`` rows whatever the key distribution, because the order values
in it are distinct.  What crosses a slice border is resolved on the border rows
or on one summary row per group.  Those summaries are carried the same way, over
slices of slices up to the whole range of 64 bits, so that no window exceeds the
bound where order values are sparse either.

``number_reads`` makes the unique, dense arrival numbers that the stateful
operators ask for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 22
LEAST_LEVEL_BITS = 16  # slices of slices hold at least 2**16 of them, so that few levels do

_SLICE, _FIRST, _LAST, _PREV = "_ord_slice", "_ord_slice_first", "_ord_slice_last", "_ord_slice_prev"


def slice_of(order: str, slice_bits: int = SLICE_BITS) -> Column:
    """Slice number of an integer order column (floor division by a power of two)."""
    # Never null, so that joins on it add no filter to one of two branches that share a shuffle.
    return F.shiftright(F.coalesce(F.col(order).cast("bigint"), F.lit(0).cast("bigint")), slice_bits)


def with_previous(df: DataFrame, keys: Sequence[Column], value: Column, out: str, *, order: str = "seq",
                  active: Column | None = None, rescan: bool = True, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``out``: ``value`` of the preceding active row of the same key, NULL if none.

    Rows are shuffled once, by (key, slice), and look back within their slice.
    For the first row of a slice there are two ways.  With ``rescan`` the input
    is read a second time for the last value of every (key, slice), which
    partial aggregation reduces ahead of its shuffle, and the summary is joined
    on the partitioning the rows already have.  Without it, for inputs that are
    costly to compute twice, the border rows of the slices are shuffled again.
    Keys and values must not be NULL.
    """
    active = F.lit(True) if active is None else active
    named = {f"_ord_key{i}": key for i, key in enumerate(keys)}
    staged = df.withColumns({**named, "_ord_active": active, _SLICE: slice_of(order, slice_bits), "_ord_value": value})
    if rescan:
        return _previous_by_summary(staged, list(named), out, order, slice_bits)
    return _previous_by_borders(staged, list(named), out, order)


def number_reads(df: DataFrame, order_by: Sequence[str | Column], out: str = "seq", *, first: int = 1,
                 slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``out``: 1, 2, 3 and so on in the order of ``order_by``, which must tell all rows apart.

    The first column is an integer such as a message number or an offset; rows
    are numbered within slices of its values and start behind the rows of the
    slices before.  A slice holds as many rows as share its values, so begin with
    a column that few rows share.  Decoders that make several reads of a message
    are numbered by message and place in it.
    """
    lead, *rest = [c if isinstance(c, Column) else F.col(c) for c in order_by]
    staged = df.withColumn("_num_at", lead.cast("bigint"))
    offsets = slice_totals(staged, [], F.count(F.lit(1)), order="_num_at", slice_bits=slice_bits)
    within = Window.partitionBy(_SLICE).orderBy("_num_at", *rest)
    numbered = staged.withColumn(_SLICE, slice_of("_num_at", slice_bits)).withColumn("_num", F.row_number().over(within).cast("bigint"))
    joined = numbered.join(offsets.select(_SLICE, "_ord_before"), _SLICE)
    return joined.withColumn("_num", F.col("_num") + F.col("_ord_before") + (first - 1)).drop(
        "_num_at", _SLICE, "_ord_before", out).withColumnRenamed("_num", out)


def _key_window(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


# How values of earlier slices are put together: within a window or group, and two of them.
_CARRIES = {
    "sum": (lambda c: F.sum(c), lambda c, at: F.sum(c), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (lambda c: F.min(c), lambda c, at: F.min(c), lambda a, b: F.least(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c, at: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))),
             lambda a, b: F.coalesce(a, b)),
}


def carried(groups: DataFrame, keys: Sequence[str], value: str, out: str, how: str, *, slice_bits: int = SLICE_BITS,
            bits_left: int | None = None) -> DataFrame:
    """Add ``out`` to one row per (key, slice): ``value`` of the key's earlier slices put together.

    Slices stand in slices of their own, each a window of at most
    ``2**slice_bits`` rows; what lies before such a slice is carried from level
    to level until one level holds all.
    """
    over, within, both = _CARRIES[how]
    step = max(slice_bits, LEAST_LEVEL_BITS)
    bits_left = 64 - slice_bits if bits_left is None else bits_left
    if bits_left <= step:
        earlier = _key_window(keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        return groups.withColumn(out, over(value).over(earlier))
    up, inner, total, outer = (f"_ord_{n}{bits_left}" for n in ("up", "inner", "total", "outer"))
    staged = groups.withColumn(up, F.shiftright(_SLICE, step))
    earlier = Window.partitionBy(*keys, up).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summary = staged.groupBy(*keys, up).agg(within(value, _SLICE).alias(total)).withColumnRenamed(up, _SLICE)
    above = carried(summary, keys, total, outer, how, slice_bits=slice_bits, bits_left=bits_left - step)
    joined = staged.withColumn(inner, over(value).over(earlier)).join(
        above.select(*keys, F.col(_SLICE).alias(up), outer), [*keys, up])
    return joined.withColumn(out, both(F.col(inner), F.col(outer))).drop(up, inner, outer)


def _previous_by_summary(staged: DataFrame, keys: list[str], out: str, order: str, slice_bits: int) -> DataFrame:
    before = Window.partitionBy(*keys, _SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last(F.when(F.col("_ord_active"), F.col("_ord_value")), ignorenulls=True).over(before)
    alive = [F.when(F.col("_ord_active"), F.col(c)) for c in ("_ord_value", order)]
    groups = staged.groupBy(*keys, _SLICE).agg(F.max_by(*alive).alias("_ord_last"))
    across = carried(groups, keys, "_ord_last", "_ord_across", "last", slice_bits=slice_bits).drop("_ord_last")
    joined = staged.withColumn(_PREV, inside).join(across, [*keys, _SLICE], "left")
    return joined.withColumn(out, F.coalesce(_PREV, "_ord_across")).drop(
        *keys, "_ord_active", _SLICE, "_ord_value", _PREV, "_ord_across")


def _previous_by_borders(staged: DataFrame, keys: list[str], out: str, order: str) -> DataFrame:
    """Look back within slices; the border rows then look back among themselves, two for each slice of a key."""
    within = Window.partitionBy("_ord_active", *keys, _SLICE).orderBy(order)
    staged = staged.withColumns({
        _PREV: F.lag("_ord_value").over(within),
        _FIRST: F.lag(order).over(within).isNull(),
        _LAST: F.lead(order).over(within).isNull(),
    })
    border = F.col("_ord_active") & (F.col(_FIRST) | F.col(_LAST))
    inner = staged.where(~border).withColumn(out, F.col(_PREV))
    across = F.lag("_ord_value").over(_key_window(keys).orderBy(order))
    edges = staged.where(border).withColumn("_ord_across", across).withColumn(
        out, F.when(F.col(_FIRST), F.col("_ord_across")).otherwise(F.col(_PREV))).drop("_ord_across")
    return inner.unionByName(edges).drop(*keys, "_ord_active", _SLICE, "_ord_value", _PREV, _FIRST, _LAST)


def with_first_flag(df: DataFrame, keys: Sequence[Column], out: str, *, order: str = "seq",
                    active: Column | None = None, rescan: bool = True, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``out``: whether the row is the first active one of its key.

    With ``rescan`` the input is read twice: the least order value of every key,
    partially aggregated ahead of the shuffle, is joined back on key and order
    value, which together spread evenly.  Without it the first row of each (key,
    slice) group is a candidate, and only candidates are shuffled again.  The
    result has the rows of the input; of active rows that share key and order
    value, which ``number_reads`` rules out, all or one count as the first.
    """
    active = F.lit(True) if active is None else active
    named = {f"_ord_key{i}": key for i, key in enumerate(keys)}
    if rescan:
        firsts = df.where(active).groupBy(*[k.alias(n) for n, k in named.items()]).agg(F.min(order).alias(order))
        joined = df.withColumns({**named, "_ord_active": active}).join(
            firsts.withColumn("_ord_first", F.lit(True)), [*named, order], "left")
        return joined.withColumn(out, F.col("_ord_active") & F.col("_ord_first").isNotNull()).select(*df.columns, out)
    staged = df.withColumns({**named, "_ord_active": active, _SLICE: slice_of(order, slice_bits)})
    within = Window.partitionBy("_ord_active", *named, _SLICE).orderBy(order)
    staged = staged.withColumn(_FIRST, F.lag(order).over(within).isNull())
    candidate = F.col("_ord_active") & F.col(_FIRST)
    across = Window.partitionBy(*named).orderBy(order)
    others = staged.where(~candidate).withColumn(out, F.lit(False))
    candidates = staged.where(candidate).withColumn(out, F.lag(order).over(across).isNull())
    return others.unionByName(candidates).drop(*named, "_ord_active", _SLICE, _FIRST)


def slice_totals(df: DataFrame, keys: Sequence[str], total: Column, *, order: str = "seq",
                 slice_bits: int = SLICE_BITS) -> DataFrame:
    """One row per (key, slice) with ``_ord_total`` and ``_ord_before``, the sum over earlier slices.

    Partial aggregation shrinks the input ahead of the shuffle, so this table has
    one row per group rather than per input row.
    """
    totals = df.groupBy(*keys, slice_of(order, slice_bits).alias(_SLICE)).agg(total.alias("_ord_total"))
    before = carried(totals, keys, "_ord_total", "_ord_before", "sum", slice_bits=slice_bits)
    return before.withColumn("_ord_before", F.coalesce("_ord_before", F.lit(0)))


def with_running_total(df: DataFrame, keys: Sequence[str], value: Column, out: str, *, order: str = "seq",
                       inclusive: bool = True, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``out``: the sum of ``value`` over this key's rows up to this one.

    Keys must not be NULL.  The join runs on (key, slice), the partitioning the
    in-slice window already has, so the rows are shuffled once.
    """
    staged = df.withColumns({_SLICE: slice_of(order, slice_bits), "_ord_value": value})
    within = Window.partitionBy(*keys, _SLICE).orderBy(order)
    frame = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    running = staged.withColumn("_ord_running", F.coalesce(F.sum("_ord_value").over(frame), F.lit(0)))
    offsets = slice_totals(df.withColumn("_ord_value", value), keys, F.sum("_ord_value"), order=order, slice_bits=slice_bits)
    joined = running.join(offsets.select(*keys, _SLICE, "_ord_before"), [*keys, _SLICE])
    return joined.withColumn(out, F.col("_ord_before") + F.col("_ord_running")).drop(_SLICE, "_ord_value", "_ord_running", "_ord_before")


def with_row_number(df: DataFrame, keys: Sequence[str], out: str, *, order: str = "seq",
                    offsets: DataFrame | None = None, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``out``: the 1-based position of the row among its key's rows.

    ``offsets`` (key columns, ``_ord_slice``, ``_ord_before``) replaces the plain counts
    of earlier slices where a caller starts numbering elsewhere.
    """
    if offsets is None:
        offsets = slice_totals(df, keys, F.count(F.lit(1)), order=order, slice_bits=slice_bits)
    staged = df.withColumn(_SLICE, slice_of(order, slice_bits))
    within = Window.partitionBy(*keys, _SLICE).orderBy(order)
    numbered = staged.withColumn("_ord_rn", F.row_number().over(within).cast("bigint"))
    joined = numbered.join(offsets.select(*keys, _SLICE, "_ord_before"), [*keys, _SLICE])
    return joined.withColumn(out, F.col("_ord_before") + F.col("_ord_rn")).drop(_SLICE, "_ord_rn", "_ord_before")


def with_running_minimum(df: DataFrame, keys: Sequence[str], value: str, out: str, *, order: str,
                         slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``out``: the minimum of ``value`` over this key's rows up to this one."""
    staged = df.withColumn(_SLICE, slice_of(order, slice_bits))
    frame = Window.partitionBy(*keys, _SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    lows = carried(staged.groupBy(*keys, _SLICE).agg(F.min(value).alias("_ord_low")), keys, "_ord_low", "_ord_before", "min",
                   slice_bits=slice_bits).drop("_ord_low")
    return staged.withColumn("_ord_running", F.min(value).over(frame)).join(lows, [*keys, _SLICE]).withColumn(
        out, F.least("_ord_running", "_ord_before")).drop(_SLICE, "_ord_running", "_ord_before")
