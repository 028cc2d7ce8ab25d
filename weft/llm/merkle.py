"""A Merkle manifest of a dataset: every row's leaf, its proof and the root, with a small top tree on the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import checked, stored

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id() counts a partition's rows in these bits


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*columns: str | Column) -> Column:
    """The leaf of a row: sha256 of its values, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


class Tree:
    """The levels of a tree over some nodes: runs of `arity` consecutive ones become their hash, until one is left, or `height` times."""

    def __init__(self, nodes: list[str], arity: int, height: int | None = None):
        self.arity, self.levels = arity, [nodes]
        while len(self.levels) - 1 < height if height is not None else len(self.levels[-1]) > 1:
            last = self.levels[-1]
            self.levels.append([digest("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
        self.root = self.levels[-1][0]

    def steps(self) -> list[list[str]]:
        """For each level but the last, of each node its run, with * in its own place."""
        out = []
        for nodes in self.levels[:-1]:
            runs = [nodes[i : i + self.arity] for i in range(0, len(nodes), self.arity)]
            out.append(["".join([*run[:i], "*", *run[i + 1 :]]) for run in runs for i in range(len(run))])
        return out

    def proof(self, i: int, steps: list[list[str]]) -> list[str]:
        return [s[i // self.arity**k] for k, s in enumerate(steps)]


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has with this proof: at each level the node takes its place in the run, whose hash is the next node."""
    up = F.aggregate(F.split(proof, "/"), leaf, lambda node, step: F.sha2(F.replace(step, F.lit("*"), node), 256))
    return F.when(proof == "", leaf).otherwise(up)


def siblings(proof: Column) -> Column:
    """All siblings of a proof in one text: level by level, left to right."""
    return F.translate(proof, "/*", "")


def manifest(rows: DataFrame, leaf: Column, order: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None, arity: int = 3, height: int = 7, most_top: int = 20_000) -> DataFrame:
    """order, group, the columns of carry, and leaf, place (long: the row's place in its group), proof, subroot and root (strings) of every row.

    A group's leaves ascend by order (null first), ties by the leaf itself; while there is more than one node, every `arity` consecutive ones become their hash. What
    remains is the group's subroot; the subroots by group (null first, bytewise) become the root in the same way. proof has the levels from the leaf to the root, between
    slashes: the texts of the run's nodes, with * for the own one; folded() replays it.

    Leaves are sorted by ranges, numbered by the ranges' counts, and brought together in blocks of arity ** height of one group, so a group with a third of all
    rows is many blocks. Each block is reduced to one node; nodes are reduced in blocks again while there are more than most_top. These come to the driver, which builds
    the top tree and broadcasts it: at most 1.5 * most_top hashes. Then blocks are opened from above: each gets the proof from its node to the root, by the broadcast at the top
    and by a join with the level above below it, and tasks finish the proofs of its rows. Texts are not shuffled, only leaves.

    Every group has a node at the top, so more than most_top groups are an error. Equal rows are leaves each; a column named as a result is only read. An empty table gives an empty one.
    """
    checked(rows, order, group)
    carry = carry or {}
    size = arity**height
    kinds = {"o": rows.schema[order].dataType, **{f"c{i}": rows.select(c).schema[0].dataType for i, c in enumerate(carry.values())}}
    leaves = stored(rows.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf.alias("leaf"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())]), "leaves")
    ranged = leaves.repartitionByRange("g", "o", "leaf").sortWithinPartitions("g", "o", "leaf")
    ranged = stored(ranged.withColumns({"part": F.spark_partition_id(), "local": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}), "ranged")
    blocks, levels = _numbered(ranged).withColumn("block", F.expr(f"idx div {size}")), []
    names = ["leaf", *kinds]
    while True:
        held = blocks.groupBy("g", "block", "n").agg(F.sort_array(F.collect_list(F.struct("idx", *names))).alias("rows"))
        held = stored(held.mapInArrow(_reduced(arity, height), T.StructType([*held.schema.fields, T.StructField("node", T.StringType())])), "blocks")
        levels.append(held)
        nodes = held.select("g", F.col("block").alias("idx"), F.col("node").alias("leaf"), F.ceil(F.col("n") / size).cast("long").alias("n"))
        if (count := nodes.count()) <= most_top:
            break
        if nodes.where("n > 1").isEmpty():
            raise ValueError(f"{count} groups, more than most_top = {most_top}")
        blocks, names = nodes.withColumn("block", F.expr(f"idx div {size}")), ["leaf"]
    top = rows.sparkSession.sparkContext.broadcast(_top(nodes, arity))
    root = top.value[1]
    above = None
    for k, held in reversed(list(enumerate(levels))):
        if above is not None:
            low = held.withColumns({"gn": F.col("g").isNull(), "gv": F.coalesce("g", F.lit(""))}).alias("l")
            high = above.select(F.col("g").isNull().alias("gn"), F.coalesce("g", F.lit("")).alias("gv"), F.col("idx").alias("block"), F.col("proof").alias("rest"), "subroot")
            held = low.join(high, ["gn", "gv", "block"]).drop("gn", "gv")
        fields = [T.StructField("g", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("leaf", T.StringType()), *[T.StructField(n, t) for n, t in kinds.items() if k == 0]]
        fields += [T.StructField("proof", T.StringType()), T.StructField("subroot", T.StringType())]
        above = held.mapInArrow(_opened(arity, height, [f.name for f in fields], top if "rest" not in held.columns else None), T.StructType(fields))
        if k:
            above = stored(above, "opened")
    carried = [F.col(f"c{i}").alias(name) for i, name in enumerate(carry)]
    return above.select(F.col("o").alias(order), F.col("g").alias(group), *carried, "leaf", F.col("idx").alias("place"), "proof", "subroot", F.lit(root).alias("root"))


def _numbered(ranged: DataFrame) -> DataFrame:
    """Rows with idx, their place in the group, and n, its size: from the counts of each group in each range."""
    key = [F.col("g").isNull().alias("gn"), F.coalesce("g", F.lit("")).alias("gv")]
    counts = ranged.groupBy("part", *key).agg(F.count("*").alias("here"), F.min("local").alias("first"))
    before = F.expr("sum(here) over (partition by gn, gv order by part rows between unbounded preceding and current row) - here")
    counts = counts.select("part", "gn", "gv", "first", before.alias("before"), F.expr("sum(here) over (partition by gn, gv)").alias("n"))
    rows = ranged.select("*", *key).join(counts, ["part", "gn", "gv"])
    return rows.withColumn("idx", F.col("local") - F.col("first") + F.col("before")).drop("part", "gn", "gv", "local", "first", "before")


def _height(n: int, arity: int, height: int) -> int | None:
    """How often a block is reduced: as often as any if its group has several, else until one node is left."""
    return height if n > arity**height else None


def _reduced(arity: int, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n = batch.column("rows"), batch.column("n").to_pylist()
            cuts, leaves = rows.offsets.to_pylist(), rows.values.field("leaf").to_pylist()
            nodes = [Tree(leaves[a:b], arity, _height(m, arity, height)).root for a, b, m in zip(cuts, cuts[1:], n, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.string())], [*batch.schema.names, "node"])

    return run


def _opened(arity: int, height: int, names: list[str], top):
    """A block's rows with their proofs up to the root; those above the block come from the broadcast or are in the columns rest and subroot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            cuts, values = rows.offsets.to_pylist(), rows.values
            groups, blocks, sizes = (batch.column(c).to_pylist() for c in ("g", "block", "n"))
            rest = [top.value[0].proof(g, b) for g, b in zip(groups, blocks, strict=True)] if top else list(zip(batch.column("rest").to_pylist(), batch.column("subroot").to_pylist(), strict=True))
            leaves = values.field("leaf").to_pylist()
            for g, n, a, b, (above, subroot) in zip(groups, sizes, cuts, cuts[1:], rest, strict=False):
                tree = Tree(leaves[a:b], arity, _height(n, arity, height))
                steps = tree.steps()
                proofs = ["/".join([*tree.proof(i, steps), *([above] if above else [])]) for i in range(b - a)]
                made = {"g": pa.array([g] * (b - a), pa.string()), "proof": pa.array(proofs, pa.string()), "subroot": pa.array([subroot] * (b - a), pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else values.field(c).slice(a, b - a) for c in names], names)

    return run


class _Top:
    """The upper tree: of each group its nodes' tree, and the tree of the subroots."""

    def __init__(self, nodes: dict[str | None, list[str]], arity: int):
        self.place = {g: i for i, g in enumerate(sorted(nodes, key=lambda g: (g is not None, (g or "").encode())))}
        self.trees = {g: Tree(x, arity) for g, x in nodes.items()}
        self.all = Tree([self.trees[g].root for g in self.place], arity)
        self.made: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def proof(self, g: str | None, i: int) -> tuple[str, str]:
        """The proof of a group's node up to the root, and the group's subroot."""
        for name, tree in ((("group", g), self.trees[g]), (("all",), self.all)):
            if name not in self.made:
                self.made[name] = tree.steps()
        own = self.trees[g].proof(i, self.made["group", g]) + self.all.proof(self.place[g], self.made[("all",)])
        return "/".join(own), self.trees[g].root


def _top(nodes: DataFrame, arity: int) -> tuple[_Top | None, str | None]:
    """The top tree of at most most_top nodes, and the root."""
    groups: dict[str | None, list[tuple[int, str]]] = {}
    for r in nodes.select("g", "idx", "leaf").toLocalIterator():
        groups.setdefault(r.g, []).append((r.idx, r.leaf))
    if not groups:
        return None, None
    top = _Top({g: [h for _, h in sorted(x)] for g, x in groups.items()}, arity)
    return top, top.all.root
