"""Lookups of reads and status events in the reader registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(facts: DataFrame, dimension: DataFrame, key: str, *, spread: str, salts: int | None = None) -> DataFrame:
    """Left join of a large table with a table that is unique on ``key``.

    The optimizer broadcasts the dimension by its size in bytes and splits busy
    keys of the facts at run time.  With ``salts`` both sides are shuffled on the
    key and a salt taken from the column ``spread``, so that one busy key is
    spread over so many tasks whatever the settings.
    """
    if salts is None:
        return facts.join(dimension, key, "left")
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def first_registration(registry: DataFrame) -> DataFrame:
    """The first row of each reader id by ``ordinal``."""
    fields = [c for c in registry.columns if c not in ("reader_id", "ordinal")]
    first = registry.groupBy("reader_id").agg(F.min_by(F.struct(*fields), "ordinal").alias("_r"))
    return first.select("reader_id", "_r.*")


def enrich_with_reader(reads: DataFrame, registry: DataFrame, *, default_provider: str = "System",
                       default_brand: str = "RFID Reader", spread: str = "seq", **options) -> DataFrame:
    """Add ``provider_id`` and ``brand_name`` of the reader, or the defaults of an unregistered one."""
    known = first_registration(registry).select("reader_id", "provider_id", "brand_name",
                                                F.lit(True).alias("_registered"))
    joined = lookup(reads, known, "reader_id", spread=spread, **options)
    unknown = F.col("_registered").isNull()
    return joined.withColumns({
        "provider_id": F.when(unknown, F.lit(default_provider)).otherwise(F.col("provider_id")),
        "brand_name": F.when(unknown, F.lit(default_brand)).otherwise(F.col("brand_name")),
    }).drop("_registered")


def status_with_provider(status: DataFrame, registry: DataFrame, *, default_provider: str = "Unknown",
                         spread: str = "seq", **options) -> DataFrame:
    """Add the provider id of the reader to status events."""
    known = first_registration(registry).select("reader_id", "provider_id")
    return lookup(status, known, "reader_id", spread=spread, **options).withColumn(
        "provider_id", F.coalesce("provider_id", F.lit(default_provider)))
