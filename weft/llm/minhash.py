"""b-bit MinHash near-dedup."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checked, stored, tidy
from weft.llm.components import components

#: Two bits of each minimum are kept: chance alone makes a quarter of them equal.
BITS = 2
_ODD = 0x5555555555555555


class WordHash(dict):
    """64-bit hashes of words, remembered; the memory is emptied between texts when it is full."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, known: WordHash) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles; with fewer words, of the whole sequence; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if len(known) > 500_000:
        known.clear()
    k = min(words, len(h))
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def band_count(threshold: float, rows: int, miss: float = 1e-8) -> int:
    """The bands of so many rows with which a pair at the threshold has no band in common with a chance of miss at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


class Signer:
    """Minima of a set under multiply-shift hash functions, as band keys and as packed low bits."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mixers = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def sign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        minima = np.full(len(self.factors), 0xFFFFFFFF, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(values), 2048):  # blocks that stay in the cache
                np.minimum(minima, ((values[i : i + 2048, None] * self.factors) >> np.uint64(32)).min(axis=0), out=minima)
            keys = ((minima.reshape(self.bands, self.rows) + np.uint64(1)) * self.mixers).sum(axis=1, dtype=np.uint64) ^ self.salts
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        low = (minima & np.uint64(3)).astype(np.uint64)
        low = np.concatenate([low, np.zeros(-len(low) % 32, np.uint64)]).reshape(-1, 32)
        packed = (low << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
        return keys.view(np.int64), packed.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def similarity(a: str, b: str, functions: int) -> Column:
    """The similarity estimated from two packed signatures: equal cells, corrected for those that chance makes equal."""
    differ = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(_ODD)))),
        F.lit(0), lambda s, x: s + x,
    )
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(float(functions)) - chance) / (1 - chance)


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may reach the similarity; no such pair is left out.

    sets: node, comp, n and set. Each set is put in order from rare to frequent elements. Two sets that reach the similarity
    share an element among the first n - ceil(percent * n / 100) + 1 of each. At the first such element, what follows in
    both bounds what they can share; a text with many elements of its own, as edited copies have, is bounded away
    from all others. Pairs are made only where this bound and the sizes allow the similarity.
    """
    one = sets.select("node", "comp", "n", F.explode("set").alias("s"))
    often = one.groupBy("s").agg(F.count("*").alias("f"))
    ranked = one.join(often, "s").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("l"))
    head = F.expr(f"CAST(n - ceil({percent} * n / 100) + 1 AS INT)")
    prefix = stored(ranked.select("node", "comp", "n", F.posexplode(F.slice("l", 1, head)).alias("p", "e")).select("node", "comp", "n", "p", F.col("e.s").alias("s"), F.col("e.f").alias("f")).where("f > 1"), "prefix")
    several = prefix.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("s")
    prefix = prefix.join(several, "s", "left_semi")
    x, y = prefix.alias("x"), prefix.alias("y")
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    room = (100 + percent) * F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.comp") < F.col("y.comp")) & sizes & room)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, rows: int = 4) -> DataFrame:
    """One row for each row of docs: its id, n_shingles, node, component_id and kept.

    A text is lower-cased (A-Z) and split at ASCII white space; its set holds the distinct shingles of so many words,
    or, of a shorter text, the whole sequence. Rows are linked when 100 * intersection >= percent * union.
    component_id is the smallest id that is reachable by links, kept says whether it is the row's own.

    1. Each whole text gets the minima of its set under bands * rows hash functions: a key for each band, and the two low bits
       of each, packed. Rows with equal sets are one node from here on (node: a 128-bit hash of the set).
    2. Nodes that share a band key are candidates. In each such bucket every node is compared with one hub, so a
       bucket costs as many comparisons as it has nodes. A comparison estimates the similarity by bit counts; unless
       that is six standard deviations below the threshold, the full sets are intersected. Links make components.
    3. Nodes of different components that still share a bucket meet again in prefix_pairs, which leaves no possible link
       out and makes few pairs; these are confirmed like the others. Within a component no pairs are made.

    Bands are so many that a pair at the threshold is missed with a chance of 10^-8 and one above it with less.

    Null, empty or blank texts: n_shingles 0, linked with nothing, component_id their own id. Null ids are larger than all others. Repeated
    rows and ids are rows of their own. An empty table gives an empty one.
    Other columns play no part.
    """
    checked(docs, id, text)
    bands = band_count(percent / 100, rows)
    functions = bands * rows
    plain = docs.select(F.col(f"`{id}`").alias("__weft_id"), F.col(f"`{text}`").alias("__weft_text"))
    kind = plain.schema["__weft_id"].dataType.simpleString()

    def node_of(values: np.ndarray) -> bytes:
        return xxhash.xxh3_128_digest(values.tobytes())

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = WordHash(), Signer(bands, rows)
        for batch in batches:
            sizes, nodes, keys, packed = [], [], [], []
            for t in batch.column(1):
                values = shingle_set(t.as_py(), words, known)
                sizes.append(len(values))
                nodes.append(node_of(values))
                k, s = signer.sign(values) if len(values) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                keys.append(k)
                packed.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), _lists(keys), _lists(packed)], ["id", "n", "node", "keys", "sig"])

    @tidy
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py(), words, known) for t in batch.column(1).slice(i, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.binary()), _lists([s.view(np.int64) for s in sets])], ["node", "set"])

    signed = stored(plain.mapInArrow(sign, f"id {kind}, n long, node binary, keys array<long>, sig array<long>"), "signed")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    banded = nodes.select(F.explode("keys").alias("key"), "node")
    crowded = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = stored(banded.join(crowded, "key"), "shared")
    # the hub of a bucket is the node that shares most bands with others: the copies' original, if it is there
    popular = shared.groupBy("node").agg(F.sum("c").alias("c"))
    hubs = shared.select("key", "node").join(popular, "node").groupBy("key").agg(F.max(F.struct("c", "node")).alias("top"))
    buckets = stored(shared.select("key", "node").join(hubs, "key").select("key", "node", F.col("top.node").alias("hub")), "buckets")
    facts = stored(nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "id", "n", "sig"), "facts")
    # the texts of one row for each candidate node, as sets
    wanted = facts.select(F.col("id").alias("__weft_want")).distinct()
    sets = plain.join(wanted, F.col("__weft_id").eqNullSafe(F.col("__weft_want")), "left_semi").mapInArrow(full, "node binary, set array<long>")
    sets = stored(sets.join(facts.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    t = percent / 100
    p = 0.25 + 0.75 * t
    floor = t - 6 * math.sqrt(p * (1 - p) / functions) / 0.75

    def side(name: str, *columns: str) -> DataFrame:
        return facts.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that are links on their full sets."""
        likely = pairs.join(side("a", "n", "sig"), "a").join(side("b", "n", "sig"), "b").where(similarity("sig_a", "sig_b", functions) >= floor)
        # a set's size bounds the similarity
        likely = likely.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))).select("a", "b", "n_a", "n_b")
        held = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        both = F.size(F.array_intersect("set_a", "set_b"))
        return held.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")

    def ordered(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    links = stored(confirmed(buckets.where("node != hub").select(*ordered("node", "hub")).distinct()), "links")
    comps = components(links)
    # nodes of buckets that still hold several components
    placed = buckets.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    unsettled = stored(placed.join(mixed, "key", "left_semi").select("node", "comp").distinct(), "unsettled")
    if not unsettled.isEmpty():
        more = confirmed(prefix_pairs(unsettled.join(sets, "node").join(facts.select("node", "n"), "node"), percent))
        links = stored(links.unionByName(more), "links")
        comps = components(links)
    names = comps.join(facts.select("node", "id"), "node").groupBy("comp").agg(F.min("id").alias("component_id"))
    found = comps.join(names, "comp").select("node", "component_id")
    # every row again: its node's component, or, of a node without links, the smallest id of equal rows
    alone = nodes.select("node", F.col("id").alias("__weft_least")).join(found, "node", "left").select("node", F.coalesce("component_id", "__weft_least").alias("component_id"))
    # as a table of its own, so the join with a node that a third of all rows are can be split
    rows_out = signed.select("id", "n", "node").join(stored(alone, "alone"), "node", "left")
    rows_out = rows_out.select("id", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return rows_out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("id"))).withColumnRenamed("id", id)


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that near_duplicates keeps: one document of each group.

    Rows that repeat an id and its text are one document; of rows with one id and several texts all stay if one does.
    """
    found = near_duplicates(docs, id, text, **how)
    kept = stored(found.where("kept").groupBy(F.col(id).alias("__weft_id")).agg(F.count("*").alias("__weft_n")), "kept")
    rest = docs.join(kept.select("__weft_id"), docs[id].eqNullSafe(F.col("__weft_id")), "left_semi")
    again = kept.where("__weft_n > 1").select("__weft_id")
    if again.isEmpty():
        return rest
    same = docs[id].eqNullSafe(F.col("__weft_id"))
    return rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates([id, text]))
