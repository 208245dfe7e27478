"""Differences between two states of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on null-safe keys: the keys and whether a row is in both, only in new or only in old."""
    a, b = new.select(*keys, F.lit(True).alias("in_new")).alias("a"), old.select(*keys, F.lit(True).alias("in_old")).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    state = F.when(F.col("in_new").isNull(), "old").when(F.col("in_old").isNull(), "new").otherwise("both")
    return a.join(b, on, "full").select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), state.alias("state"))


def difference(new: DataFrame, old: DataFrame | None, key: str = "url", fingerprint: str = "full_description_hash") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new or changed rows of new, keys of removed or changed rows of old, rows of old that stay).

    Without an old state all rows are new.
    """
    if old is None:
        return new, new.select(key).limit(0), new.limit(0)
    state = marked(new, old, [key, fingerprint])
    removed = state.where("state = 'old'").select(key).distinct()
    retained = old.join(removed, key, "left_anti")
    fresh = new.join(state.where("state = 'new'").select(key).distinct(), key, "left_semi").join(retained, key, "left_anti")
    return fresh, removed, retained


def next_state(new: DataFrame, old: DataFrame | None, columns: list[str]) -> DataFrame:
    """The rows that stay, and the new ones, which the caller has enriched or not."""
    fresh, _, retained = difference(new, old)
    return retained.select(*columns).unionByName(fresh.select(*columns))
