"""Versions of packages: a cache with a lifetime, then a table that ships with the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How long a cached version holds.
LIFETIME_MS = 24 * 60 * 60 * 1000


def resolved(wanted: DataFrame, cache: DataFrame, fallback: DataFrame, now_ms: Column) -> DataFrame:
    """(registry, package, version, origin) of each package wanted; the latest entry of a cache counts."""
    key = ["registry", "package"]
    fresh = cache.where(now_ms - F.col("ts") <= LIFETIME_MS).groupBy(*key).agg(F.max_by("version", "ts").alias("cached"))
    own = wanted.join(fresh, key, "left").join(fallback.select(*key, F.col("version").alias("shipped")), key, "left")
    origin = F.when(F.col("cached").isNotNull(), "cache").when(F.col("shipped").isNotNull(), "fallback").otherwise("unknown")
    return own.select(*key, F.coalesce("cached", "shipped").alias("version"), origin.alias("origin"))
