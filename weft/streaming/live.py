"""Live queries by Structured Streaming. The catalogue's own live queries re-run; watermarks and windows are additions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery


def live(stream: DataFrame, query: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Runs an aggregating query over all rows so far on each batch, and shows its whole result as a table in memory."""
    return query(stream).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quota_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """userId, kind, window, n: events by user and day; rows that come later than delay after the newest are dropped."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", delay).groupBy("user_id", "event_type", day.alias("window")).agg(F.count("*").alias("n"))


def unique_views(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Each viewer of a story once while the story lives: state older than delay is forgotten."""
    return events.where("event_type = 'view'").withColumn("story", F.col("event_id") % 200).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["story", "user_id"])


def changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before, by key: distinct until changed."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumns({"_first": F.row_number().over(w) == 1, "_before": F.lag(value).over(w)})
    return marked.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_first", "_before")


def page(rows: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def notifications(fabrics: DataFrame, now: int) -> DataFrame:
    """kind: those of the triggers that hold: three stale fabrics, a favourite on a Friday or Saturday, a month's tips."""
    from weft.functions.text import season

    t = F.timestamp_millis(F.lit(now))
    facts = fabrics.agg((F.count_if(F.col("createdAt") < now - 30 * 86_400_000) >= 3).alias("stale"), F.coalesce(F.bool_or("isFavorite"), F.lit(False)).alias("favorite"))
    kinds = F.array_compact(F.array(F.when(F.col("stale"), "stale"), F.when(F.col("favorite") & F.dayofweek(t).isin(6, 7), "favorite"), F.concat(F.lit("season_"), season(F.month(t)))))
    return facts.select(F.explode(kinds).alias("kind"))


def latest_of_all(rows: DataFrame, slots: list[str], key: str, slot: str, value: str, order: list[str]) -> DataFrame:
    """Combine latest, over rows that are all there: for each row from that on with which every slot of its key has had a value, the key, the order and the slots' latest values (doubles).

    Null values and slots that aren't asked for change nothing and give no row. Rows of one key are ordered by `order`, which should tell them apart.
    """
    known = rows.where(F.col(slot).isin(slots) & F.col(value).isNotNull())
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    latest = known.select(key, *order, *[F.last(F.when(F.col(slot) == s, F.col(value).cast("double")), ignorenulls=True).over(so_far).alias(s) for s in slots])
    return latest.where(" and ".join(f"`{s}` is not null" for s in slots))


class Latest(StatefulProcessor):
    """The latest value of each slot of a key."""

    def __init__(self, slots: list[str], key: str, slot: str, value: str, order: list[str]):
        self.slots, self.key, self.slot, self.value, self.order = slots, key, slot, value, order

    def init(self, handle) -> None:
        self.held = handle.getMapState("latest", "slot string", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {s[0]: v[0] for s, v in self.held.iterator()} if self.held.exists() else {}
        new, out = {}, []
        table = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for slot, value, *order in zip(table[self.slot], table[self.value], *(table[c] for c in self.order), strict=True):
            held[slot] = new[slot] = float(value)
            if len(held) == len(self.slots):
                out.append((key[0], *order, *[held[s] for s in self.slots]))
        for slot, value in new.items():
            self.held.updateValue((slot,), (value,))
        yield pd.DataFrame(out, columns=[self.key, *self.order, *self.slots])


def combine_latest(stream: DataFrame, slots: list[str], key: str, slot: str, value: str, order: list[str]) -> DataFrame:
    """The same over a stream, whose batches follow each other in order: state holds a value for each slot of a key. Needs the state store of RocksDB
    (spark.sql.streaming.stateStore.providerClass)."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    known = stream.where(F.col(slot).isin(slots) & F.col(value).isNotNull()).select(key, *order, slot, F.col(value).cast("double").alias(value))
    shape = ", ".join([f"`{c}` {kinds[c]}" for c in (key, *order)] + [f"`{s}` double" for s in slots])
    return known.groupBy(key).transformWithStateInPandas(Latest(slots, key, slot, value, order), shape, "append", "none")
