"""Inserts, upserts, updates and deletes as rewrites of DataFrames.

Nothing is changed in place: each function returns the new table, which the caller writes to a fresh place. Keys are
compared null-safely, so a null key is a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.neardup import checkpointed

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id() counts a partition's rows in these bits


def _matches(old: DataFrame, new: DataFrame, keys: list[str], how: str) -> DataFrame:
    same = reduce(lambda a, b: a & b, (old[k].eqNullSafe(new[k]) for k in keys))
    return old.join(new, same, how)


def insert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old and new; an error if a key of new is in old or twice in new."""
    if not _matches(new, old, [key], "left_semi").isEmpty() or not new.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"a {key} exists already")
    return old.unionByName(new)


def with_ids(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """new with keys that follow the largest of old, in order of a column."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    columns = new.columns if key in new.columns else [*new.columns, key]
    kept = new.drop(key) if order != key else new
    return numbered(kept.orderBy(order) if order else kept, "__weft_n").orderBy("__weft_n").withColumn(key, (F.col("__weft_n") + top).cast("long")).select(columns)


def numbered(rows: DataFrame, name: str = "rank") -> DataFrame:
    """Rows, sorted as a whole by orderBy(), with their places from 1: each has its place in its partition, and the partitions before are counted.

    The rows are checkpointed once, so that counts and rows are of the same partitions; no task has all rows, the running sum is over one row a partition.
    """
    kept = checkpointed(rows.withColumn("__weft_i", F.monotonically_increasing_id()))
    kept = kept.withColumns({"__weft_p": F.shiftrightunsigned("__weft_i", 33), "__weft_k": F.col("__weft_i").bitwiseAND(F.lit(_IN_PARTITION))})
    counts = kept.groupBy("__weft_p").agg(F.count("*").alias("n"))
    before = counts.select("__weft_p", F.expr("sum(n) over (order by __weft_p rows between unbounded preceding and current row) - n").alias("__weft_before"))
    out = kept.join(before, "__weft_p").withColumn(name, (F.col("__weft_before") + F.col("__weft_k") + 1).cast("int"))
    return out.drop("__weft_i", "__weft_p", "__weft_k", "__weft_before")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new replace those of old with the same key; the others are added."""
    return _matches(old, new, list(keys), "left_anti").unionByName(new)


def replace(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new replace those of old with the same key; the others are left out."""
    return _matches(old, new, list(keys), "left_anti").unionByName(_matches(new, old, list(keys), "left_semi"))


def update(table: DataFrame, condition: Column, **values) -> DataFrame:
    """The columns named get their values where the condition holds; where it is null, nothing changes."""
    return table.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition isn't true; null is not true."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def clear(table: DataFrame) -> DataFrame:
    return table.where(F.lit(False))


def adjusted(column: str, by: int) -> Column:
    """A counter plus by, never below 0."""
    return F.greatest(F.col(column) + by, F.lit(0))
