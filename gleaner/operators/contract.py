"""What differs between two versions of a table, by the digest of canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(columns: list[str]) -> Column:
    """Digest of a row's values by column name, whatever the order of the columns; nulls are told from texts."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``change, *keys, was, now``: keys that were ``added``, ``lost`` or ``changed``, and how many rows they have.

    Both versions have the same columns, in any order. A key may have several rows: it is changed unless
    both versions have the same rows as often. Null keys are keys of their own. Rows are compared by digest,
    as often as they are there, so a key with many equal rows is one row here.
    """
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError("the versions have different columns")
    rest = [c for c in old.columns if c not in keys]

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, row_digest(rest).alias("digest"), F.lit(1).alias(name))

    both = counted(old, "was").unionByName(counted(new, "now"), allowMissingColumns=True)
    each = both.groupBy(*keys, "digest").agg(F.count("was").alias("was"), F.count("now").alias("now"))
    found = each.groupBy(*keys).agg(F.sum("was").alias("was"), F.sum("now").alias("now"), F.max(F.col("was") != F.col("now")).alias("differs"))
    change = F.when(F.col("was") == 0, "added").when(F.col("now") == 0, "lost").otherwise("changed")
    return found.where("differs").select(change.alias("change"), *keys, "was", "now")


def same_contract(old: DataFrame, new: DataFrame, keys: list[str], may: tuple[str, ...] = ()) -> DataFrame:
    """The :func:`changes` that a new version must not have; ``may`` names the kinds that it may."""
    return changes(old, new, keys).where(~F.col("change").isin(*may)) if may else changes(old, new, keys)
