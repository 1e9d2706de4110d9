"""URL verdicts: rules by host and path, and for the rest a character language-model ratio.

Two variable-order Markov models, of accepted and of rejected urls, are smoothed from order to order; their difference in
log-likelihood per character is compared with a calibrated threshold.  All of it is DataFrame expressions: n-grams are
counted as they are, each distinct longest n-gram of the urls is resolved once by joins with the tables of the orders,
and the characters of the urls are joined with what was resolved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

AZ, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, AZ, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def match_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does; of equally long ones the first given."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = _fits(rule, host, path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class LmSettings:
    """``order`` characters of context at most.  ``cells`` is kept for callers that give it and changes nothing."""
    order: int = 4
    cells: int = 1 << 15
    strength: float = 2.0  # weight of the shorter context in the longer one's estimate
    alphabet: int = 256
    calibration_parts: int = 5  # one labelled url in so many is left for calibration


def _modelled(url: Column, order: int) -> Column:
    """What the models read: the url without its scheme, A-Z lower-cased, between ``order`` blanks and one."""
    body = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.concat(F.lit(" " * order), F.translate(body, AZ, LOWER), F.lit(" "))


def _ends(text: Column, order: int) -> Column:
    """The places of the characters that are predicted."""
    return F.sequence(F.lit(order + 1), F.char_length(text))


def _tallies(labelled: DataFrame, settings: LmSettings) -> DataFrame:
    """How often each n-gram occurs in accepted and rejected urls."""
    n = settings.order + 1
    ends = labelled.select("good", "text", F.explode(_ends(F.col("text"), settings.order)).alias("at"))
    longest = ends.groupBy("good", F.substring("text", F.col("at") - settings.order, F.lit(n)).alias("gram")).count()
    shorter = F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(
        k.alias("n"), F.substring("gram", n + 1 - k, k).alias("gram"))))
    each = longest.select("good", "count", shorter.alias("g")).select("good", "count", "g.n", "g.gram")
    held = lambda good: F.sum(F.when(F.col("good") == good, F.col("count")).otherwise(0))
    return each.groupBy("n", "gram").agg(held(True).alias("c_good"), held(False).alias("c_bad"))


def _smoothed(tallies: DataFrame, settings: LmSettings) -> list[tuple[DataFrame, DataFrame]]:
    """For each order, by ``gram`` the log ratio of its last character and by ``context`` that of what it leaves to shorter ones.

    The estimates of an order are written, since the next one builds on them.
    """
    floor, out, lower = 1.0 / settings.alphabet, [], None
    for n in range(1, settings.order + 2):
        context = F.substring("gram", 1, n - 1)
        over = Window.partitionBy("context")  # as many rows as characters follow a context
        here = tallies.where(F.col("n") == n).withColumn("context", context).withColumns(
            {"all_good": F.sum("c_good").over(over), "all_bad": F.sum("c_bad").over(over)})
        if lower is None:
            here = here.withColumns({"low_good": F.lit(floor), "low_bad": F.lit(floor)})
        else:
            here = here.withColumn("suffix", F.substring("gram", 2, n - 1)).join(lower, "suffix")
        for c in ("good", "bad"):
            here = here.withColumn(f"p_{c}", (F.col(f"c_{c}") + settings.strength * F.col(f"low_{c}"))
                                   / (F.col(f"all_{c}") + settings.strength))
        here = written(here.select("gram", "context", "c_good", "c_bad", "all_good", "all_bad", "p_good", "p_bad"), "url-order")
        lower = here.select(F.col("gram").alias("suffix"), F.col("p_good").alias("low_good"), F.col("p_bad").alias("low_bad"))
        ratio = here.select("gram", F.log(F.col("p_good") / F.col("p_bad")).alias("value"))
        left = here.select("context", "all_good", "all_bad").distinct().select(
            "context", F.log((F.col("all_bad") + settings.strength) / (F.col("all_good") + settings.strength)).alias("left"))
        out.append((ratio, left))
    return out


def _longest(text: Column, order: int) -> Column:
    """The n-gram of each predicted character, in rows."""
    return F.explode(F.transform(_ends(text, order), lambda at: F.substring(text, at - order, F.lit(order + 1))))


def _resolved(grams: DataFrame, orders: list[tuple[DataFrame, DataFrame]], settings: LmSettings) -> DataFrame:
    """The log ratio ``r`` of the last character of each ``gram``, all of the longest order.

    From the empty context to the longest, a context adds what it leaves to the shorter one, and an n-gram that was seen
    replaces the estimate.  Each order resolves the distinct ends of the n-grams, so a key meets as many rows as there
    are characters; it is written, since the next one builds on it.
    """
    told = None
    for n, (ratio, left) in enumerate(orders, 1):
        here = grams.select(F.substring("gram", settings.order + 2 - n, n).alias("gram")).distinct().withColumns(
            {"context": F.substring("gram", 1, n - 1), "suffix": F.substring("gram", 2, n - 1)})
        here = here.join(ratio, "gram", "left").join(left, "context", "left")
        lower = F.lit(0.0)
        if told is not None:
            here, lower = here.join(told.select(F.col("gram").alias("suffix"), F.col("r").alias("lower")), "suffix"), F.col("lower")
        told = written(here.select("gram", F.coalesce("value", F.coalesce("left", F.lit(0.0)) + lower).alias("r")), "url-resolved")
    return told


def url_verdicts(pages: DataFrame, *, key: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES,
                 settings: LmSettings = LmSettings()) -> DataFrame:
    """Per row: key, ``host``, ``path``, ``rule``, ``verdict``, and ``score``, the log-likelihood ratio per character.

    Urls that a rule fits are the training data, accepted or rejected by its verdict; one in ``calibration_parts`` of
    them, by hash, is kept for the threshold, which lies as many standard deviations below the mean of the accepted
    as above that of the rejected.  Other urls are blocked below the threshold and allowed elsewhere.  Where either class
    has no url in one of the two parts, nothing is told from the score and they are allowed.  A null url is empty and
    judged by the score of its end; rows that repeat are judged each; other columns are not read.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    rule, told = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(key).alias("page"), host.alias("host"), path.alias("path"), F.col(url).alias("url")) \
        .withColumns({"rule": rule, "told": told}).withColumn("text", _modelled(F.col("url"), settings.order))
    # Written with the numbers of the rows, which a second reading might deal out otherwise.
    base = written(rows.drop("url").withColumn("row", F.monotonically_increasing_id()), "url-rows")
    labelled = base.where(F.col("told").isNotNull()).select("row", "text", (F.col("told") == "allow").alias("good"))
    kept_back = F.pmod(F.xxhash64("text"), F.lit(settings.calibration_parts)) == 0
    tallies = written(_tallies(labelled.where(~kept_back), settings), "url-tallies")
    each = base.select("row", _longest(F.col("text"), settings.order).alias("gram"))
    resolved = _resolved(written(each.select("gram").distinct(), "url-grams"), _smoothed(tallies, settings), settings)
    scores = written(each.join(resolved, "gram").groupBy("row").agg(F.avg("r").alias("score")), "url-scores")
    scored = labelled.where(kept_back).join(scores, "row")
    of = lambda f, good: f(F.when(F.col("good") == good, F.col("score")))
    stats = scored.agg(of(F.mean, True).alias("m1"), of(F.mean, False).alias("m0"),
                       (of(F.stddev_pop, True) + 1e-6).alias("s1"), (of(F.stddev_pop, False) + 1e-6).alias("s0"))
    edge = written(stats.select(((F.col("m1") * F.col("s0") + F.col("m0") * F.col("s1")) / (F.col("s0") + F.col("s1"))).alias("edge")),
                   "url-threshold").select("edge").scalar()
    judged = base.drop("text").join(scores, "row")
    return judged.select(
        F.col("page").alias(key), "host", "path", "rule",
        F.coalesce("told", F.when(F.col("score") < edge, "block").otherwise("allow")).alias("verdict"), "score")
