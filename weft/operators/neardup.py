"""Near-duplicate images by difference hashes, groups of them, and splits that keep groups whole."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.once import let

#: Hashes within NEAR bits are one picture, pictures of a class within SAME_GROUP bits one group.
NEAR, SAME_GROUP = 6, 10
BITS = 64


def difference_hash(values: Column) -> Column:
    """The 64-bit hash of a grey picture of 9 by 8 (row by row): a bit for each neighbours in a row, set if the left one is lighter;
    the first is the highest. Another number of values has none."""
    at = F.array(*[F.lit(y * 9 + x) for y in range(8) for x in range(8)])
    bit = lambda v, i: F.when(F.get(v, i) > F.get(v, i + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    made = lambda v: F.when(F.size(v) == 72, F.aggregate(at, F.lit(0).cast("long"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(bit(v, i))))
    return let(values, made)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _probes(width: int, radius: int) -> list[int]:
    """All masks of width bits with at most radius bits set."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def near_hashes(hashes: DataFrame, most: int, bands: int = 4) -> DataFrame:
    """a, b, distance of different hashes (a < b), each once, that differ in at most so many bits.

    hashes: hash, all different. The 64 bits are cut into bands; two hashes within most bits differ in at most n = most / bands bits of at least one band. They meet half-way: a goes to all
    values within one bit of its bands, b to those within n - 1, so a hash is some tens of rows rather than all values within n bits, and a look-up meets a value of 2^16. Of the values
    where two meet only the one counts at which a has turned the lowest bit that differs, and only in the first band that is near enough; so no pair comes twice, and none is missed.

    Spark takes these tens of rows for one when it estimates sizes, so the join is told to be a merge: otherwise all rows of one side may be collected and broadcast.
    """
    width, n = BITS // bands, most // bands
    cut = lambda c, k: F.shiftrightunsigned(c, width * k).bitwiseAND(F.lit((1 << width) - 1))
    banded = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), cut(F.col("hash"), k).alias("value")) for k in range(bands)])).alias("e")

    def spread(radius: int, name: str, mask: str) -> DataFrame:
        masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _probes(width, radius)])).alias("mask")
        rows = hashes.select("hash", banded).select("hash", "e.band", "e.value", masks)
        return rows.select(F.col("hash").alias(name), "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), F.col("mask").alias(mask))

    met = spread(min(n, 1), "a", "turned").hint("merge").join(spread(max(n - 1, 0), "b", "_b").hint("merge"), ["band", "value"])
    differ = F.col("a").bitwiseXOR(F.col("b"))
    own = F.expr(f"shiftrightunsigned(a ^ b, band * {width}) & {(1 << width) - 1}L")
    first = reduce(lambda x, y: x & y, [(F.col("band") <= k) | (F.bit_count(cut(differ, k)) > n) for k in range(bands - 1)], F.lit(True))
    return met.where("a < b").where((F.col("turned") == own.bitwiseAND(-own)) & first & (F.bit_count(differ) <= most)).select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


def near_pairs(pictures: DataFrame, most: int = SAME_GROUP) -> tuple[DataFrame, DataFrame]:
    """Pairs and membership of pictures (id, hash): pairs (a, b, distance) of class representatives, the smallest ids of different hashes, and
    members (id, rep) of every picture. Pictures with one hash are a class, so m copies make m rows, not their square. Pictures without a hash are classes of their own."""
    known = pictures.where(F.col("hash").isNotNull())
    reps = known.groupBy("hash").agg(F.min("id").alias("rep"))
    members = pictures.join(reps, "hash", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    found = near_hashes(reps.select("hash"), most)
    x, y = reps.select(F.col("hash").alias("a"), F.col("rep").alias("p")), reps.select(F.col("hash").alias("b"), F.col("rep").alias("q"))
    both = found.join(x, "a").join(y, "b")
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance"), members


def grouped(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, grp: the smallest id that is reachable over pairs (a, b). Labels spread with pointer jumping until nothing changes; each round is checkpointed."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)  # each round reads it
    labels = ids.select("id", F.col("id").alias("grp"))
    while True:
        heard = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("grp").alias("m"))
        up = labels.select(F.col("id").alias("u"), F.col("grp").alias("top"))
        new = labels.join(heard, labels.id == heard.a, "left").join(up, F.col("grp") == F.col("u"))
        new = checkpointed(new.select("id", F.least("grp", F.coalesce("m", "grp"), "top").alias("new"), "grp"))
        labels = new.select("id", F.col("new").alias("grp"))
        if new.where("new < grp").isEmpty():
            return labels


def groups(pictures: DataFrame, most: int = SAME_GROUP) -> DataFrame:
    """id, grp of all pictures (id, class, hash, and key if there is one): within a class, pictures with one key are a group, as are
    those without a key within most bits of each other, over any number of steps. grp is the group's smallest id."""
    rows = checkpointed(pictures if "key" in pictures.columns else pictures.withColumn("key", F.lit(None).cast("string")))
    keyed = rows.where(F.col("key").isNotNull())
    by_key = keyed.withColumn("grp", F.min("id").over(Window.partitionBy("class", "key"))).select("id", "grp")
    free = rows.where(F.col("key").isNull())
    reps = free.groupBy("class", "hash").agg(F.min("id").alias("rep"))
    met = near_hashes(free.where(F.col("hash").isNotNull()).select("hash").distinct(), most)
    x = reps.select(F.col("hash").alias("a"), F.col("class").alias("c"), F.col("rep").alias("p"))
    y = reps.select(F.col("hash").alias("b"), F.col("class").alias("c"), F.col("rep").alias("q"))
    pairs = met.join(x, "a").join(y, ["b", "c"]).select(F.col("p").alias("a"), F.col("q").alias("b"))
    # a picture without a hash is a group of its own
    found = grouped(reps.where(F.col("hash").isNotNull()).select(F.col("rep").alias("id")), pairs).withColumnRenamed("id", "rep")
    members = free.join(reps, ["class", "hash"], "left").join(found, "rep", "left")
    return by_key.unionByName(members.select("id", F.coalesce("grp", "id").alias("grp")))


def checkpointed(df: DataFrame) -> DataFrame:
    """df saved to the folder of spark.checkpoint.dir; where the session names none and all runs on one machine, as in tests, a local one is set."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="weft-"))
    return df.checkpoint()


def accepted_in_order(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, accepted: an id is accepted unless it is within the distance of a smaller accepted one.

    The greedy rule, by rounds. Each decides what follows from what is decided: an id with an accepted smaller neighbour is not accepted; one whose smaller neighbours are all turned
    down is. What is left with one undecided smaller neighbour will be the opposite of it, so chains of such ids are followed to their ends by doubling: a chain of n ids takes
    one round and log n jumps. Every round decides at least the smallest undecided id of each group.
    """
    state = ids.select("id", F.lit(None).cast("boolean").alias("accepted"))
    links = checkpointed(pairs.select(F.col("b").alias("id"), F.col("a").alias("low")))
    while True:
        below = links.join(state.select(F.col("id").alias("low"), F.col("accepted").alias("s")), "low")
        facts = below.groupBy("id").agg(F.bool_or(F.coalesce("s", F.lit(False))).alias("hit"), F.count_if(F.col("s").isNull()).alias("open"), F.max(F.when(F.col("s").isNull(), F.col("low"))).alias("up"))
        undecided = F.col("accepted").isNull() & ~F.coalesce("hit", F.lit(False))
        rule = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        known = checkpointed(state.join(facts, "id", "left").select("id", rule.alias("accepted"), F.when(undecided & (F.col("open") == 1), F.col("up")).alias("up")))
        jumps = known.where("up is not null").select("id", "up", F.lit(True).alias("opposite"))
        while True:
            on = jumps.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("opposite").alias("again"))
            met = jumps.join(on, "up", "left")
            jumps = checkpointed(met.select("id", F.coalesce("far", "up").alias("up"), (F.col("opposite") != F.coalesce("again", F.lit(False))).alias("opposite"), F.col("far").isNotNull().alias("moved")))
            if jumps.where("moved").isEmpty():
                break
            jumps = jumps.drop("moved")
        ends = known.where("accepted is not null").select(F.col("id").alias("up"), F.col("accepted").alias("end"))
        found = jumps.join(ends, "up").select("id", (F.col("end") != F.col("opposite")).alias("followed"))
        state = checkpointed(known.drop("up").join(found, "id", "left").select("id", F.coalesce("accepted", "followed").alias("accepted")))
        if state.where("accepted is null").isEmpty():
            return state


def staged(pictures: DataFrame, classes: list, least: int = 220, most: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """What becomes of candidates (id, class, stem, w, h, hash), in order of ids: outcomes (id, outcome), and credits (id, class, filename) of those that are taken, with their other columns.

    The first rule that holds: a class that isn't known; a side below `least`; a picture within most bits of one taken before, a duplicate if that has its class, else a conflict; else ok.
    Only pictures that pass the first two can be taken. A taken picture is named by its stem, with _2, _3 ... for later ones of a class with the same stem; an empty stem is the class.
    """
    side = F.least(F.coalesce("w", F.lit(0)), F.coalesce("h", F.lit(0)))
    size = F.concat(F.lit("too small ("), F.coalesce(F.col("w").cast("string"), F.lit("?")), F.lit("x"), F.coalesce(F.col("h").cast("string"), F.lit("?")), F.lit(")"))
    refused = F.when(~F.coalesce(F.col("class").isin(classes), F.lit(False)), "unknown class").when(side < least, size)
    rows = checkpointed(pictures.withColumn("_refused", refused))
    fit = rows.where("_refused is null").drop("_refused")
    judged = checkpointed(dedup(fit.select("id", "class", "hash"), most))
    stem = F.coalesce(F.nullif(F.col("stem"), F.lit("")), F.col("class").cast("string"))
    taken = fit.join(judged.where("status = 'ok'").select("id"), "id").withColumn("_stem", stem)
    n = F.row_number().over(Window.partitionBy("class", "_stem").orderBy("id"))
    name = F.concat("_stem", F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".jpg"))
    credits = checkpointed(taken.withColumn("filename", name).drop("_stem", "stem"))
    first = credits.select(F.col("id").alias("of"), F.concat_ws("/", F.col("class").cast("string"), "filename").alias("_of"))
    why = F.when(F.col("status") == "ok", "ok").when(F.col("status") == "duplicate", F.concat(F.lit("duplicate of "), "_of")).otherwise(F.concat(F.lit("cross-class conflict with "), "_of"))
    outcomes = judged.join(first, "of", "left").select("id", why.alias("outcome"))
    return rows.where("_refused is not null").select("id", F.col("_refused").alias("outcome")).unionByName(outcomes), credits


def dedup(pictures: DataFrame, most: int = NEAR) -> DataFrame:
    """id, status, of: in order of ids, a picture (id, class, hash) is ok unless an earlier ok one is within most bits: then it is a duplicate
    of the first such one if that has its class, else a conflict with it. Only the first picture of each hash can be ok, the others follow it."""
    pictures = checkpointed(pictures)
    pairs, members = near_pairs(pictures, most)
    pairs, members = checkpointed(pairs), checkpointed(members)
    reps = members.select(F.col("rep").alias("id")).distinct()
    taken = accepted_in_order(reps, pairs).where("accepted").select(F.col("id").alias("of"))
    kinds = pictures.select(F.col("id").alias("of"), F.col("class").alias("_c"))
    near = pairs.select(F.col("b").alias("rep"), F.col("a").alias("of")).join(taken, "of", "left_semi")
    first = near.groupBy("rep").agg(F.min("of").alias("_near"))
    rows = pictures.select("id", "class").join(members, "id").join(first, "rep", "left").join(taken.withColumn("_ok", F.lit(True)).withColumnRenamed("of", "rep"), "rep", "left")
    of = F.when(F.col("_ok") & (F.col("id") != F.col("rep")), F.col("rep")).when(F.col("_ok").isNull(), F.col("_near"))
    rows = rows.withColumn("of", of).join(kinds, "of", "left")
    return rows.select("id", F.when(F.col("of").isNull(), "ok").when(F.col("class") == F.col("_c"), "duplicate").otherwise("conflict").alias("status"), "of")


def near_known(pictures: DataFrame, pool: DataFrame, most: int = NEAR) -> DataFrame:
    """id of the pictures (id, hash) that any of a pool (hash) is within most bits of."""
    both = pictures.select("hash").unionByName(pool.select("hash")).where(F.col("hash").isNotNull()).distinct()
    pairs = near_hashes(both, most)
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(pool.select(F.col("hash").alias("a"), F.col("hash").alias("b")))
    hit = links.join(pool.select(F.col("hash").alias("b")).distinct(), "b", "left_semi").select(F.col("a").alias("hash")).distinct()
    return pictures.join(hit, "hash", "left_semi").select("id")


def group_split(groups: DataFrame, shares: tuple[float, ...] = (0.70, 0.15, 0.15), names: tuple[str, ...] = ("train", "val", "test"), seed: str = "42") -> DataFrame:
    """label, grp, n, split: each whole group, in order of the md5 of its name and the seed, goes to the split of its
    label that is furthest below its share.

    groups: label, grp, n. The rule is sequential within a label: its groups, sorted by Spark, stream through one task, which holds one number for each split. A null label is one.
    """
    order = F.md5(F.concat(F.col("grp").cast("string"), F.lit(seed)))
    rows = groups.select("label", "grp", F.col("n").cast("long").alias("n"), order.alias("o")).repartition("label")
    rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy("label"))).sortWithinPartitions("label", "o", "grp")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, have = object(), []
        for batch in batches:
            put = []
            for label, n, total in zip(batch["label"].astype(object).where(batch["label"].notna(), None), batch["n"].tolist(), batch["total"].tolist(), strict=True):
                if label != at:
                    at, have = label, [0.0] * len(shares)
                lack = [s * total - h for s, h in zip(shares, have, strict=True)]
                place = lack.index(max(lack))
                have[place] += n
                put.append(names[place])
            yield pd.DataFrame({"label": batch["label"], "grp": batch["grp"], "n": batch["n"], "split": put})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("label", "grp", "n", "total").mapInPandas(deal, f"label {kinds['label']}, grp {kinds['grp']}, n long, split string")


def hold_out_last(files: DataFrame, by: str, order: str, content: str) -> DataFrame:
    """Files without exact copies (the first stays), and whether each is its class's last, which validates."""
    first = files.withColumn("_r", F.row_number().over(Window.partitionBy(F.md5(content)).orderBy(order))).where("_r = 1").drop("_r")
    return first.withColumn("held_out", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) == 1)
