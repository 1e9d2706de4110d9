"""The ordered filter chain.

The chain keeps every read and annotates it: ``drop_stage``, ``drop_code`` and
``drop_reason`` are NULL on a read that passed.  The first stage that drops a
read decides; later stages neither judge it nor let it touch their state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.clock import local_time, weekday_name
from ..schema import DailyRule, FilterConfig, MetadataRule, ScheduleRule, SlidingRule
from .dedup import daily_verdict, sliding_verdict
from .ordering import SLICE_BITS

ALIVE = "drop_stage IS NULL"


@dataclass(frozen=True)
class CustomRule:
    """A stage supplied by the user.

    ``keep`` is a boolean Column, or a function that adds a boolean column named
    ``_keep`` to a DataFrame.
    """

    name: str
    keep: Column | Callable[[DataFrame], DataFrame]
    reason: str = "Dropped by custom stage."


Rule = SlidingRule | DailyRule | MetadataRule | ScheduleRule | CustomRule


def plain_number(value: float) -> str:
    """Digits without an exponent and without zeros at the end."""
    return f"{Decimal(str(value)).normalize():f}"


def _cases(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Value of the first condition that holds, NULL if none does."""
    (condition, value), *rest = pairs
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain


def _metadata_checks(rule: MetadataRule) -> list[tuple[str, Column, Column]]:
    """(code, dropped, reason) in the order the checks are made."""
    checks = []
    if rule.min_rssi is not None:
        checks.append(("rssi", P.rssi_below(rule.min_rssi),
                       F.format_string(f"RSSI %.1f dBm is below threshold {rule.min_rssi:.1f} dBm.", F.col("rssi"))))
    if rule.antenna_mask is not None:
        checks.append(("antenna", P.antenna_masked(rule.antenna_mask),
                       F.format_string(f"Antenna port %d disabled by bitmask 0x{rule.antenna_mask:X}.",
                                       F.col("antenna_port"))))
    if rule.min_length is not None:
        checks.append(("min_length", P.epc_shorter(rule.min_length),
                       F.format_string(f"EPC length %d is below minimum {rule.min_length}.", F.char_length("epc"))))
    if rule.max_length is not None:
        checks.append(("max_length", P.epc_longer(rule.max_length),
                       F.format_string(f"EPC length %d exceeds maximum {rule.max_length}.", F.char_length("epc"))))
    if rule.prefix:
        checks.append(("prefix", P.epc_without_prefix(rule.prefix),
                       F.concat(F.lit("EPC '"), F.col("epc"),
                                F.lit(f"' does not start with required prefix '{rule.prefix}'."))))
    if rule.suffix:
        checks.append(("suffix", P.epc_without_suffix(rule.suffix),
                       F.concat(F.lit("EPC '"), F.col("epc"),
                                F.lit(f"' does not end with required suffix '{rule.suffix}'."))))
    if rule.regex and rule.regex.strip():
        P.check_pattern(rule.regex)
        checks.append(("regex", P.epc_not_matching(rule.regex),
                       F.concat(F.lit("EPC '"), F.col("epc"),
                                F.lit(f"' does not match regex pattern '{rule.regex}'."))))
    return checks


def _schedule_checks(rule: ScheduleRule) -> list[tuple[str, Column, Column]]:
    checks = []
    local = local_time(F.col("eval_ts"), rule.tz)
    if rule.days:
        checks.append(("day", P.day_not_operating(rule.days, rule.tz),
                       F.concat(F.lit("Tag read on "), weekday_name(local),
                                F.lit(" outside configured operating days."))))
    if rule.start is not None and rule.end is not None:
        checks.append(("hours", P.outside_hours(rule.start, rule.end, rule.tz),
                       F.concat(F.lit("Time "), F.date_format(local, "HH:mm:ss"),
                                F.lit(f" is outside operating window ({rule.start:%H:%M:%S} - {rule.end:%H:%M:%S})."))))
    return checks


def _annotate(df: DataFrame, stage: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """Record the first failing check on reads no earlier stage dropped."""
    if not checks:
        return df
    coded = df.withColumn("_code", F.when(F.expr(ALIVE), _cases([(c, F.lit(code)) for code, c, _ in checks])))
    reason = _cases([(F.col("_code") == code, text) for code, _, text in checks])
    return coded.withColumns({
        "drop_stage": F.coalesce("drop_stage", F.when(F.col("_code").isNotNull(), F.lit(stage))),
        "drop_code": F.coalesce("drop_code", "_code"),
        "drop_reason": F.coalesce("drop_reason", reason),
    }).drop("_code")


def metadata_filter(df: DataFrame, rule: MetadataRule) -> DataFrame:
    """Annotate reads that fail a metadata check."""
    return _annotate(start(df), rule.name, _metadata_checks(rule))


def schedule_filter(df: DataFrame, rule: ScheduleRule) -> DataFrame:
    """Annotate reads outside the operating schedule."""
    return _annotate(start(df), rule.name, _schedule_checks(rule))


def start(df: DataFrame) -> DataFrame:
    """Add the empty annotation columns."""
    if "drop_stage" in df.columns:
        return df
    none = F.lit(None).cast("string")
    return df.withColumns({"drop_stage": none, "drop_code": none, "drop_reason": none})


def _apply(df: DataFrame, rule: Rule, order: str, rescan: bool, slice_bits: int) -> DataFrame:
    alive = F.expr(ALIVE)
    if isinstance(rule, MetadataRule):
        return _annotate(df, rule.name, _metadata_checks(rule))
    if isinstance(rule, ScheduleRule):
        return _annotate(df, rule.name, _schedule_checks(rule))
    if isinstance(rule, SlidingRule):
        marked = sliding_verdict(df, rule, "_gap", active=alive, order=order, rescan=rescan, slice_bits=slice_bits)
        window = plain_number(rule.window_seconds)
        text = F.concat(F.lit("Tag '"), F.col("epc"),
                        F.format_string(f"' deduplicated (last seen %.1fs ago, window: {window}s).",
                                        F.col("_gap") / 1_000_000))
        return _annotate(marked, rule.name, [("sliding", F.col("_gap").isNotNull(), text)]).drop("_gap")
    if isinstance(rule, DailyRule):
        marked = daily_verdict(df, rule, "_first", active=alive, order=order, rescan=rescan, slice_bits=slice_bits)
        text = F.concat(F.lit("Tag '"), F.col("epc"), F.lit("' already processed in shift '"),
                        F.col("shift_id"), F.lit("'."))
        return _annotate(marked, rule.name, [("daily", ~F.col("_first"), text)]).drop("_first", "shift_id")
    judged = rule.keep(df) if callable(rule.keep) and not isinstance(rule.keep, Column) \
        else df.withColumn("_keep", rule.keep)
    dropped = ~F.coalesce(F.col("_keep"), F.lit(False))
    return _annotate(judged, rule.name, [("custom", dropped, F.lit(rule.reason))]).drop("_keep")


def _split_for_pushdown(rule: MetadataRule, scope: str) -> tuple[MetadataRule, MetadataRule]:
    """The checks that depend on a dedup key alone, and the remaining ones."""
    ahead = {"min_length", "max_length", "prefix", "suffix", "regex"}
    if scope == "antenna":
        ahead.add("antenna_mask")
    fields = ("min_rssi", "antenna_mask", "min_length", "max_length", "prefix", "suffix", "regex")
    return (replace(rule, **{f: None for f in fields if f not in ahead}),
            replace(rule, **{f: None for f in fields if f in ahead}))


def commute(rules: Sequence[Rule]) -> list[Rule]:
    """Move metadata checks that are functions of the dedup key ahead of the dedup stages.

    The set of passing reads stays the same and fewer rows reach the shuffle; a
    read that both stages would drop is credited to the metadata stage instead.
    """
    ordered: list[Rule] = []
    for rule in rules:
        at = len(ordered)
        while isinstance(rule, MetadataRule) and at and isinstance(ordered[at - 1], (SlidingRule, DailyRule)):
            at -= 1
        if at == len(ordered):
            ordered.append(rule)
            continue
        scopes = {r.scope for r in ordered[at:]}
        ahead, behind = _split_for_pushdown(rule, "antenna" if scopes == {"antenna"} else "global")
        if _metadata_checks(ahead):
            ordered.insert(at, ahead)
        if _metadata_checks(behind):
            ordered.append(behind)
    return ordered


def filter_pipeline(df: DataFrame, rules: Sequence[Rule], *, optimize: bool = False, order: str = "seq",
                    rescan: bool = True, keep_dropped: bool = True, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Run the stages in order over one annotated DataFrame.

    With ``keep_dropped=False`` a dropped read leaves the chain at its stage, so
    that later shuffles carry survivors only; the result is what passes.

    The first dedup stage reads the input twice, with the second pass pruned to
    its key and clock.  Set ``rescan=False`` if the input is costly to compute,
    such as text decoded in the same job; later dedup stages never recompute the
    stages before them.
    """
    out = start(df)
    for rule in commute(rules) if optimize else rules:
        out = _apply(out, rule, order, rescan, slice_bits)
        out = out if keep_dropped else out.where(ALIVE)
        rescan = rescan and isinstance(rule, (MetadataRule, ScheduleRule))
    return out


def default_rules(config: FilterConfig) -> list[Rule]:
    """Stages a configuration switches on, in the fixed order window, shift, metadata, schedule."""
    rules: list[Rule] = []
    if config.sliding_window_seconds > 0:
        rules.append(SlidingRule(config.sliding_window_seconds, config.sliding_scope))
    if config.daily_unique:
        rules.append(DailyRule(config.shift_start, config.tz, config.daily_scope))
    metadata = MetadataRule(config.min_rssi, config.antenna_mask, config.min_length, config.max_length,
                            config.prefix, config.suffix, config.regex)
    if _metadata_checks(metadata):
        rules.append(metadata)
    if config.schedule_days or (config.schedule_start is not None and config.schedule_end is not None):
        rules.append(ScheduleRule(config.schedule_days, config.schedule_start, config.schedule_end, config.tz))
    return rules


def default_pipeline(df: DataFrame, config: FilterConfig, **options) -> DataFrame:
    """The chain a configuration describes."""
    return filter_pipeline(df, default_rules(config), **options)


def passed(annotated: DataFrame) -> DataFrame:
    """Reads that survived the chain, without the annotation columns."""
    return annotated.where(ALIVE).drop("drop_stage", "drop_code", "drop_reason")


def pipeline_counters(annotated: DataFrame) -> DataFrame:
    """One row: reads evaluated, passed and dropped."""
    return annotated.agg(F.count(F.lit(1)).alias("evaluated"),
                         F.count_if(F.expr(ALIVE)).alias("passed"),
                         F.count_if(~F.expr(ALIVE)).alias("dropped"))


def observe_counters(annotated: DataFrame, observation: Observation | str) -> DataFrame:
    """The same reads, with the counters collected on the way through: no second pass, and usable on streams."""
    return annotated.observe(observation, F.count(F.lit(1)).alias("evaluated"),
                             F.count_if(F.expr(ALIVE)).alias("passed"), F.count_if(~F.expr(ALIVE)).alias("dropped"))


def drop_report(annotated: DataFrame) -> DataFrame:
    """Dropped reads counted by stage and code."""
    return annotated.where(~F.expr(ALIVE)).groupBy("drop_stage", "drop_code").agg(F.count(F.lit(1)).alias("reads"))

