"""A leaderboard change feed: the k highest running sums of each board, kept by a stateful stream."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from weft.llm.common import checked, drop_path, new_path, tidy

#: Below every sum: the guard of a leader buffer outside of which there is nothing.
NOTHING = -(1 << 62)
#: What a lower level tells the next: item has this sum after that day, and is among the level's k or no longer.
_DELTAS = "board int, part int, day long, item long, total long, leads boolean"
#: What a merging level gives: rows of what it tells, and one with its leaders for each (board, part).
_MERGED = "board int, part int, day long, item long, total long, leads boolean, change string, old_rank int, new_rank int, packed binary"
_MERGED_NAMES = [x.split()[0] for x in _MERGED.split(", ")]


def packed(items: np.ndarray, totals: np.ndarray) -> bytes:
    """Items in ascending order and their sums as compressed bytes."""
    return zlib.compress(np.diff(items, prepend=0).astype("<i8").tobytes() + totals.astype("<i8").tobytes(), 1)


def unpacked(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(zlib.decompress(bytes(data)), "<i8")
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :].copy()


def added(keys: list[np.ndarray], amounts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One entry for each different key, in the keys' order, with the sum of its amounts."""
    order = np.lexsort(keys[::-1])
    keys, amounts = [k[order] for k in keys], amounts[order]
    if not len(amounts):
        return keys, amounts
    first = np.ones(len(amounts), bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return [k[first] for k in keys], np.add.reduceat(amounts, np.flatnonzero(first))


def best(totals: dict[int, int], k: int) -> list[tuple[int, int]]:
    """The k entries of highest totals, ties to the smaller item."""
    return sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:k]


class LeaderBuffer:
    """The leaders of a set of items whose sums change: at most k + slack items with positive sums, and a guard, which no item
    outside of the buffer exceeds. While the buffer holds k items, or the guard is not positive, its first k are exactly the set's.

    scan() gives all items and their sums; it is called only when the buffer has fewer than k items and others may have positive sums.
    """

    def __init__(self, k: int, slack: int, held: dict[int, int], guard: tuple[int, int]):
        self.k, self.most, self.held, self.guard = k, k + slack, held, guard
        self.board = dict(best(held, k))
        self.scans = 0

    def take(self, items: np.ndarray, totals: np.ndarray, scan: Callable[[], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, bool]]:
        """After a day in which these items came to these totals: (item, total, whether it leads) of all that is new on the board of
        the first k, has another total there, or has left it."""
        near = (totals >= self.guard[0]) | np.isin(items, np.fromiter(self.held, np.int64, len(self.held)))
        today = dict(zip(items[near].tolist(), totals[near].tolist(), strict=True))
        for item, total in today.items():
            if total > 0 and (total, -item) > self.guard:
                self.held[item] = total
            elif self.held.pop(item, None) is not None or (total, -item) > self.guard:
                self.guard = max(self.guard, (total, -item))
        if len(self.held) > self.most:
            order = best(self.held, len(self.held))
            self.held = dict(order[: self.most])
            item, total = order[self.most]
            self.guard = max(self.guard, (total, -item))
        if len(self.held) < self.k and self.guard[0] > 0:
            self.scans += 1
            items, totals = scan()
            items, totals = items[totals > 0], totals[totals > 0]
            order = np.lexsort((items, -totals))[: self.most + 1]
            self.held = dict(zip(items[order[: self.most]].tolist(), totals[order[: self.most]].tolist(), strict=True))
            self.guard = (int(totals[order[-1]]), -int(items[order[-1]])) if len(order) > self.most else (NOTHING, 0)
        board = dict(best(self.held, self.k))
        out = [(item, total, True) for item, total in board.items() if self.board.get(item) != total]
        # one that has left was touched today, or is still held, or was only pushed out: then it has its old total
        out += [(item, today.get(item, self.held.get(item, total)), False) for item, total in self.board.items() if item not in board]
        self.board = board
        return out


class Leaders(StatefulProcessor):
    """Of one bucket of a board's items: a MapState with all running sums, in blocks by item, and a ValueState with the leader buffer and
    its guard. Blocks without a new amount are neither read nor written, but when an underflow of the buffer asks for a full scan."""

    def __init__(self, k: int, slack: int, blocks: int):
        self.k, self.slack, self.blocks = k, slack, blocks

    def init(self, handle) -> None:
        self.sums = handle.getMapState("sums", "block int", "packed binary")
        self.top = handle.getValueState("leaders", "packed binary, guard_total long, guard_item long")

    def block_of(self, items: np.ndarray) -> np.ndarray:
        return ((items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.blocks

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        (items, days), amounts = added([rows["item"].to_numpy(), rows["day"].to_numpy()], rows["amount"].to_numpy())
        first = np.flatnonzero(np.diff(items, prepend=items[0] - 1))
        touched, reps = items[first], np.diff([*first, len(items)])
        blocks = self.block_of(touched)
        own = {b: unpacked(self.sums.getValue((b,))[0] if self.sums.containsKey((b,)) else None) for b in np.unique(blocks).tolist()}
        known, before = (np.concatenate(x) for x in zip(*own.values(), strict=True))
        order = np.argsort(known)
        known, before = known[order], before[order]
        base = self.looked_up(known, before, touched)
        run = np.cumsum(amounts)
        after = run - np.repeat(run[first] - amounts[first], reps) + np.repeat(base, reps)

        def scan_of(day: int) -> Callable[[], tuple[np.ndarray, np.ndarray]]:
            def scan() -> tuple[np.ndarray, np.ndarray]:
                every = [unpacked(v[0]) for _, v in self.sums.iterator()]
                done = days <= day
                (all_items,), totals = added([np.concatenate([*(i for i, _ in every), items[done]])], np.concatenate([*(t for _, t in every), amounts[done]]))
                return all_items, totals

            return scan

        packed_top, guard_total, guard_item = self.top.get() if self.top.exists() else (None, NOTHING, 0)
        lead = LeaderBuffer(self.k, self.slack, dict(zip(*(x.tolist() for x in unpacked(packed_top)), strict=True)), (int(guard_total), int(guard_item)))
        by_day = np.argsort(days, kind="stable")
        cuts = np.flatnonzero(np.diff(days[by_day], prepend=days[by_day][0] - 1))
        out = []
        for some in np.split(by_day, cuts[1:]):
            day = int(days[some[0]])
            out += [(key[0], key[1], day, *x) for x in lead.take(items[some], after[some], scan_of(day))]

        last = np.append(first[1:], len(items)) - 1
        for b, (at, totals) in own.items():
            mine = blocks == b
            (at,), totals = added([np.concatenate([at, touched[mine]])], np.concatenate([totals, after[last][mine] - base[mine]]))
            self.sums.updateValue((b,), (packed(at, totals),))
        held = sorted(lead.held.items())
        self.top.update((packed(np.array([i for i, _ in held], np.int64), np.array([t for _, t in held], np.int64)), *lead.guard))
        yield pd.DataFrame(out, columns=["board", "part", "day", "item", "total", "leads"])

    @staticmethod
    def looked_up(known: np.ndarray, totals: np.ndarray, items: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        return np.where(known[at] == items, totals[at], 0)


def merging(k: int, last: bool) -> Callable:
    """Of fan_in lower parts: what they tell of a batch, and the leaders of all of them so far (at most fan_in * k, packed), become what this level tells, or, if it is the last,
    the changes of ranks, and the leaders from now on."""

    def told(key, day: int, old: list[tuple[int, int]], new: list[tuple[int, int]], total_of: Callable[[int], int]) -> list[tuple]:
        if not last:
            was, now = dict(old), dict(new)
            more = [(i, t, True) for i, t in new if was.get(i) != t] + [(i, total_of(i), False) for i, _ in old if i not in now]
            return [(*key, day, i, t, leads, None, None, None, None) for i, t, leads in more]
        was, now = ({item: n + 1 for n, (item, _) in enumerate(x)} for x in (old, new))
        name = lambda i: "enter" if i not in was else "exit" if i not in now else "move"
        return [(*key, day, i, total_of(i), None, name(i), was.get(i), now.get(i), None) for i in {**was, **now} if was.get(i) != now.get(i)]

    def merge(key, deltas: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(*(x.tolist() for x in unpacked(leaders["packed"].iloc[0] if len(leaders) else None)), strict=True))
        board, out = best(held, k), []
        for day, some in deltas.sort_values("day", kind="stable").groupby("day", sort=True):
            gone = {}
            for item, total, leads in zip(some["item"].tolist(), some["total"].tolist(), some["leads"].tolist(), strict=True):
                if leads:
                    held[item] = total
                else:
                    held.pop(item, None)
                    gone[item] = total
            new = best(held, k)
            out += told(key, int(day), board, new, lambda item, gone=gone: held.get(item, gone.get(item)))
            board = new
        order = sorted(held.items())
        state = packed(np.array([i for i, _ in order], np.int64), np.array([t for _, t in order], np.int64))
        found = pd.DataFrame([*out, (*key, None, None, None, None, None, None, None, state)], columns=_MERGED_NAMES)
        return found.astype({"day": "Int64", "item": "Int64", "total": "Int64", "leads": "boolean", "old_rank": "Int32", "new_rank": "Int32"})

    return merge


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings, which are put back at the end."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each small store takes megabytes of disk in advance
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a stream is started anew for each batch: else its stores stay open, a minute each, beside the next one's
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # the stores of an executor share one bound, however many partitions there are
}


def combined(most: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums amounts by board, part, item and day within a task, so that a much-repeated item is few rows in the shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).group_by(["board", "part", "item", "day"]).aggregate([("amount", "sum")])
                yield from table.rename_columns({"amount_sum": "amount"}).select(["board", "part", "item", "day", "amount"]).to_batches()
                held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield from out()
        yield from out()

    return run


def change_feed(events: DataFrame, k: int = 10, slack: int = 30, lateness: int = 3, buckets: int = 16, fan_in: int = 32, blocks: int = 16) -> DataFrame:
    """The changes of each board's k highest positive running sums, after each day: board int, day long, item long, batch int, change (enter,
    exit, move), old_rank and new_rank int (null: off the board), total long. Ties go to the smaller item.

    events: batch int, seen int (the day of the event, by which it may be late), day int (the day it arrives, by which boards
    are followed; all of a day in one batch, days ascending with batches), board int, item long, amount long. An event with seen + lateness below the largest
    seen of all earlier batches is dropped; one without board or item is ignored, but counts for that largest. Null amounts are 0, equal rows are events each.

    The events are written by batch to a new folder in the shared one, and one batch after the other is moved to the folder of a stream, which is started
    anew for each on one checkpoint. Amounts are summed within each task; then each (board, bucket of items) has its running sums in a MapState and a
    leader buffer of k + slack items with a guard in a ValueState (LeaderBuffer); it tells what changes among its first k. Each batch of that is merged, level by level, over
    fan_in parts, with the leaders that the level has stored so far; the last level knows the board. So a board with a third of all events is spread over `buckets` keys, an item
    with a third of them is a few rows a task, and what a merging key gets follows the days, not the events. buckets: such that the items of a board in
    one bucket fit into a task, tens of thousands. The driver holds one number for each batch. A lost executor's states come back from the checkpoint.

    An empty table gives an empty feed. Other columns play no part.
    """
    checked(events, "batch", "seen", "day", "board", "item", "amount")
    spark = events.sparkSession
    base = new_path(spark, "board")
    schema = events.select("seen", "day", "board", "item", "amount").schema
    events.select("batch", *schema.names).write.partitionBy("batch").parquet(f"{base}/cut")
    drop_shuffles(spark)
    cut = spark.read.schema(f"{schema.toDDL()}, batch int").parquet(f"{base}/cut")
    highest = {r.batch: r.high for r in cut.groupBy("batch").agg(F.max("seen").alias("high")).collect()}  # one row a batch
    made(spark, f"{base}/fed")
    high, levels, fed = None, 1, 0
    while fan_in**levels < buckets:
        levels += 1

    def merge(found: DataFrame, n: int) -> None:
        """The merging levels of the stream's n-th batch: their result is written by n, so a batch that is run again overwrites its own."""
        nonlocal fed
        fed = n + 1
        session = found.sparkSession
        for level in range(levels):
            last = level == levels - 1
            before = session.read.schema(_MERGED).parquet(f"{base}/merged/{n - 1}/{level}").where("packed is not null") if n else session.createDataFrame([], _MERGED)
            parts = found.withColumn("part", (F.lit(0) if last else F.floor(F.col("part") / fan_in)).cast("int"))
            merged = parts.groupBy("board", "part").cogroup(before.groupBy("board", "part")).applyInPandas(merging(k, last), _MERGED)
            merged.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/merged/{n}/{level}")
            found = session.read.schema(_MERGED).parquet(f"{base}/merged/{n}/{level}").where("packed is null")

    for batch in sorted(highest):
        moved(spark, f"{base}/cut/batch={batch}", f"{base}/fed/batch={batch}")
        stream = spark.readStream.schema(f"{schema.toDDL()}, batch int").parquet(f"{base}/fed")
        kept = stream if high is None else stream.where(F.col("seen") + F.lit(lateness) >= F.lit(high))
        with settings(spark, _STATE):
            found = followed(kept.where("board is not null and item is not null"), k, slack, buckets, blocks)
            query = found.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            finally:
                query.stop()
        high = max([x for x in (high, highest[batch]) if x is not None], default=None)
    drop_path(spark, f"{base}/checkpoint")
    drop_path(spark, f"{base}/fed")
    names = ["board", "day", "item", "batch", "change", "old_rank", "new_rank", "total"]
    if not fed:
        return spark.createDataFrame([], f"{_MERGED}, batch int").select(names)
    return spark.read.schema(f"{_MERGED}, batch int").parquet(*[f"{base}/merged/{n}/{levels - 1}" for n in range(fed)]).where("packed is null").select(names)


def followed(events: DataFrame, k: int, slack: int, buckets: int, blocks: int) -> DataFrame:
    """What each (board, bucket of items) tells of its leaders, over a stream of events."""
    part = F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int").alias("part")
    rows = events.select(F.col("board").cast("int").alias("board"), part, F.col("item").cast("long").alias("item"), F.col("day").cast("long").alias("day"), F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"))
    rows = rows.mapInArrow(combined(), "board int, part int, item long, day long, amount long")
    return rows.groupBy("board", "part").transformWithStateInPandas(Leaders(k, slack, blocks), _DELTAS, "append", "none")


def made(spark: SparkSession, *paths: str) -> None:
    """The folders, empty."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def moved(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder: its files are seen by a stream at once."""
    old, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    if not old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"{old} could not be moved")


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffle files of what has been written, which would stay until the driver's next collection."""
    spark.sparkContext._jvm.System.gc()


def whole_cents(amount: Column) -> Column:
    """An amount of money in cents, rounded half up in doubles; null for one that is null or no number of money."""
    amount = amount.cast("double")
    return F.when(F.abs(amount) < 1e15, F.floor(amount * 100 + 0.5))


def sale_events(lines: DataFrame, vendors: DataFrame, items: DataFrame, batches: int = 10, begin: int = 19723, days: int = 180, salts: int = 4) -> DataFrame:
    """sale_lines as events: the vendor's nation as board, cents as amount, the day it was shipped as seen, an arrival day made from a hash.

    h is crc32 of `sale_id,item_id,vendor_id,line_no`. A line without shipped_at is of day begin + h % 150; it arrives h % 7 days later, one in five 20 days
    more. Arrivals before begin are of the first batch, after begin + days of the last. A line without an amount has quantity times the item's price, without those 0;
    what is returned is negative. Lines of unknown vendors, vendors without a nation or unknown items have neither board nor item. Of vendors or items with one id
    the smallest values count. The joins are sort-merge joins by id and salt, for which vendors and items are repeated `salts` times; Spark splits them further where a key is hot. Nothing is broadcast.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    comma = F.lit(",")
    h = F.crc32(F.concat(text("sale_id"), comma, text("item_id"), comma, text("vendor_id"), comma, text("line_no")))
    own = whole_cents(F.col("amount"))
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    rows = lines.select("item_id", "vendor_id", "shipped_at", "flag", "quantity", h.alias("h"), own.alias("own"))
    seen = F.coalesce(F.unix_date(F.to_date("shipped_at")), (F.lit(begin) + F.col("h") % 150).cast("int"))
    later = F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    salt, every = (F.col("h") % salts).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    rows = rows.select("item_id", "vendor_id", salt, seen.alias("seen"), later.cast("int").alias("later"), (sign * F.col("own")).alias("own"), F.when(F.col("own").isNull(), sign * F.col("quantity")).cast("long").alias("pieces"))
    by_vendor = vendors.where("nation_id is not null").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("board"))
    by_item = items.where("item_id is not null").groupBy(F.col("item_id").alias("item")).agg(F.min(whole_cents(F.col("price"))).alias("price"))
    rows = rows.join(by_vendor.select("*", every).hint("merge"), ["vendor_id", "salt"], "left").drop("vendor_id")
    by_item = by_item.select("*", F.col("item").alias("item_id"), every)
    rows = rows.join(by_item.hint("merge"), ["item_id", "salt"], "left").drop("item_id", "salt")
    day = F.col("seen") + F.col("later")
    batch = F.least(F.lit(batches), F.greatest(F.lit(1), 1 + F.floor((day - F.lit(begin)) * batches / days))).cast("int")
    return rows.select(batch.alias("batch"), "seen", day.alias("day"), "board", "item", F.coalesce("own", F.col("pieces") * F.col("price"), F.lit(0)).alias("amount"))
