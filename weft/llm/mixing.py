"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import WORD, checked, row_hash, stored, text_of

#: The weights of the contract, in turn, and the fraction of the golden ratio.
WEIGHTS = (5.0, 2.0, 1.0)
GOLDEN = 0.6180339887498949

_S, _N, _H, _H2 = "__weft_source", "__weft_size", "__weft_hash", "__weft_hash2"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> list[float]:
    """Each source's share of all words by weight; what exceeds most times a source's size is shared anew by weight."""
    total, share = float(sum(n for _, n in sizes)), [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while free:
        scale = left / sum(share[i] for i in free)
        if not (full := [i for i in free if share[i] * scale > most * sizes[i][1]]):
            for i in free:
                out[i] = share[i] * scale
            break
        for i in full:
            out[i] = most * sizes[i][1]
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def source_plan(sized: DataFrame, most: float) -> tuple[DataFrame, list[tuple]]:
    """The plan's rows: number, name, words, documents, target, in order of code point, null last.

    One row for each source comes to the driver: the sources of a mix are a configuration, each with its weight.
    """
    rows = sized.groupBy(_S).agg(F.sum(_N).alias("n"), F.count("*").alias("docs")).collect()
    rows.sort(key=lambda r: (r[0] is None, str(r[0] or "").encode()))
    goals = targets([(r[0], r["n"]) for r in rows], most=most)
    plan = [(i, r[0], r["n"], r["docs"], t) for i, (r, t) in enumerate(zip(rows, goals, strict=True))]
    spark = sized.sparkSession
    kind = sized.schema[_S].dataType.simpleString()
    return spark.createDataFrame(plan, f"__weft_k int, `{_S}` {kind}, source_size long, __weft_docs long, target double"), plan


def mix(docs: DataFrame, source: str = "source", text: str = "text", seed: int = 29, block_words: int = 4096, min_slots: int = 65536, most: float = 3.0, chunk_docs: int = 4096) -> DataFrame:
    """Every row of docs with size, source_size, target and taken: the words that the mix takes from it.

    The mix is a sequence of slots of block_words words each (fewer, if all words make less than min_slots such
    slots). Slot i gets the point frac((i + 0.5) * golden ratio), which is mapped through the cumulative target
    weights to a source; its rank among its source's slots names the block that it takes. A source's documents,
    in a seeded random order, are one stream of words, cut into blocks of equal size (about block_words, at least one block); rank r takes block r modulo
    their number, so a pass is over before the next begins, and no source has more than most passes. A source's last slot ends where
    its target, rounded half up, is met; sources that the points leave short get the missing slots after all others (numbered alike).

    Sums along a stream are taken in two steps, within chunks of about chunk_docs documents and over the chunks,
    so a source with a third of all rows is no single task. Reruns agree. Equal rows follow each other in the stream
    and share what is taken from them evenly, rounded down.

    Null text has size 0 and is never taken; a null source is a source, the last. Without words every target and
    taken is 0; an empty table gives an empty one. Input columns with the names of the four new ones are replaced.
    """
    checked(docs, source, text)
    docs = docs.drop("size", "source_size", "target", "taken")
    spark, row = docs.sparkSession, [_H, _H2]
    keyed = docs.withColumns({_H: row_hash(docs, seed), _H2: row_hash(docs, seed + 1)})
    # the figures of all rows, without texts: they are read again and again
    slim = stored(keyed.select(F.col(f"`{source}`").alias(_S), word_count(text).alias(_N), *row), "mix")
    plan, rows = source_plan(slim, most)
    block = max(1, min(block_words, sum(r[2] for r in rows) // min_slots))
    # sources are configuration (see source_plan): their rows are few
    streamed = slim.join(F.broadcast(plan), slim[_S].eqNullSafe(plan[_S])).drop(plan[_S])
    unit = F.shiftrightunsigned(F.col(_H), 11) / F.lit(float(1 << 53))
    streamed = streamed.withColumn("__weft_chunk", F.floor(unit * F.ceil(F.col("__weft_docs") / chunk_docs)))
    same = streamed.groupBy("__weft_k", "__weft_chunk", *row, _N, "source_size", "target").agg(F.count("*").alias("__weft_copies"))
    words = F.col(_N) * F.col("__weft_copies")
    within = Window.partitionBy("__weft_k", "__weft_chunk").orderBy(*row).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("__weft_k").orderBy("__weft_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = same.groupBy("__weft_k", "__weft_chunk").agg(F.sum(words).alias("__weft_words"))
    before = chunks.select("__weft_k", "__weft_chunk", F.coalesce(F.sum("__weft_words").over(over), F.lit(0)).alias("__weft_before"))
    begun = same.withColumn("__weft_in", F.coalesce(F.sum(words).over(within), F.lit(0))).join(before, ["__weft_k", "__weft_chunk"])
    begun = begun.withColumn("__weft_start", F.col("__weft_before") + F.col("__weft_in")).withColumn("__weft_end", F.col("__weft_start") + words)
    begun = begun.withColumn("__weft_blocks", blocks_of(block))
    piece = F.explode(F.sequence(block_at("__weft_start"), block_at("(__weft_end - 1)"))).alias("__weft_block")
    pieces = begun.where(F.col(_N) > 0).select("__weft_k", *row, "__weft_start", "__weft_end", piece)
    takes = schedule(spark, plan, rows, block).groupBy("__weft_k", "__weft_block", "__weft_from", "__weft_to").agg(F.count("*").alias("__weft_times"))
    overlap = F.greatest(F.least("__weft_end", "__weft_to") - F.greatest("__weft_start", "__weft_from"), F.lit(0))
    taken = pieces.join(takes, ["__weft_k", "__weft_block"]).groupBy(*row).agg(F.sum(overlap * F.col("__weft_times")).alias("__weft_taken"))
    found = same.join(taken, row, "left").select(*row, F.col(_N).alias("size"), "source_size", "target", F.expr("coalesce(__weft_taken, 0) div __weft_copies").alias("taken"))
    return keyed.join(found, row).drop(*row)


def blocks_of(block: int) -> Column:
    """How many blocks a source of source_size words has."""
    return F.greatest(F.floor(F.col("source_size") / block + 0.5), F.lit(1)).cast("long")


def block_at(word: str) -> Column:
    """The block of a source's word: block b begins with word b * source_size div __weft_blocks."""
    return F.expr(f"(({word} + 1) * __weft_blocks - 1) div source_size")


def schedule(spark: SparkSession, plan: DataFrame, rows: list[tuple], block: int, chunk: int = 16384) -> DataFrame:
    """The slots of the mix: number, source's number, rank in the source, the block that the slot takes, and its words from and to.

    Ranks come in two steps too: counts of each source within chunks of consecutive slots, summed over the chunks,
    and ranks within a chunk.
    """
    total = sum(r[4] for r in rows) or 1.0
    point, sums, bounds = F.col("__weft_point"), 0.0, []
    for r in rows:
        if r[4] > 0:
            sums += r[4] / total
            bounds.append((r[0], sums))

    def search(some: list[tuple[int, float]]) -> Column:
        """The source whose interval holds the point, by halving."""
        if len(some) < 2:
            return F.lit(some[0][0] if some else 0)
        half = len(some) // 2
        return F.when(point < some[half - 1][1], search(some[:half])).otherwise(search(some[half:]))

    slots = sum(r[2] for r in rows) // block
    at = F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)")
    slot = spark.range(slots).select(F.col("id"), F.expr(f"id div {chunk}").alias("__weft_c"), at.alias("__weft_point")).select("id", "__weft_c", search(bounds).alias("__weft_k"))
    part = slot.groupBy("__weft_k", "__weft_c").agg(F.count("*").alias("n"))
    before = part.select("__weft_k", "__weft_c", F.coalesce(F.sum("n").over(Window.partitionBy("__weft_k").orderBy("__weft_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__weft_b"))
    ranked = slot.withColumn("__weft_r", F.row_number().over(Window.partitionBy("__weft_c", "__weft_k").orderBy("id")) - 1).join(before, ["__weft_k", "__weft_c"])
    ranked = ranked.select("id", "__weft_k", (F.col("__weft_r") + F.col("__weft_b")).alias("rank"))
    sized = plan.where("source_size > 0").select("__weft_k", "source_size", F.floor(F.col("target") + 0.5).alias("__weft_goal"), blocks_of(block).alias("__weft_blocks"))
    sized = sized.withColumn("__weft_rest", F.expr("__weft_goal % source_size"))
    # so many slots meet the target
    need = F.expr("(__weft_goal div source_size) * __weft_blocks") + F.when(F.col("__weft_rest") > 0, block_at("(__weft_rest - 1)") + 1).otherwise(0)
    sized = sized.withColumn("__weft_need", need)
    had = part.groupBy("__weft_k").agg(F.sum("n").alias("n"))
    short = sized.join(had, "__weft_k", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < __weft_need")
    more = short.select(F.lit(slots).cast("long").alias("id"), "__weft_k", F.explode(F.expr("sequence(n, __weft_need - 1)")).alias("rank"))
    found = ranked.unionByName(more).join(F.broadcast(sized), "__weft_k").where("rank < __weft_need").withColumn("__weft_block", F.expr("rank % __weft_blocks"))
    end = F.expr("((__weft_block + 1) * source_size) div __weft_blocks")
    last = (F.col("rank") == F.col("__weft_need") - 1) & (F.col("__weft_rest") > 0)
    return found.select(
        F.col("id").alias("slot"), "__weft_k", "rank", "__weft_block",
        F.expr("(__weft_block * source_size) div __weft_blocks").alias("__weft_from"), F.when(last, F.col("__weft_rest")).otherwise(end).alias("__weft_to"),
    )
