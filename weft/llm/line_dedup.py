"""Line dedup by levelled sorted runs of line hashes. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import checked, drop_path, fold_case, new_path, stored, text_of

_KEY, _KEY2, _N = "key", "key2", "n"
#: All ASCII white space.
_BLANKS = " \t\n\x0b\x0c\r"


class LineRuns:
    """How many documents each line key was found in: sorted runs of (key, key2, n) on levels.

    add() puts a batch's counts down as a run of level 0, sorted by key in each of its files. When a level has
    fanout runs, compact() merges them to one run of the next level, so a key is in at most fanout runs of each of
    log(batches) levels, and each row is rewritten once a level. A key that is in at least enough documents has
    no more to learn: the next batch merge-anti-joins the runs and adds only its other keys.

    Keys are 96 bits of hash, so that among 10^11 lines none are taken for another.
    """

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 4):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.levels: list[list[str]] = [[]]

    def _write(self, counts: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"run{level}")
        counts.select(_KEY, _KEY2, _N).sortWithinPartitions(_KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{_KEY} long, {_KEY2} int, {_N} long").parquet(*paths)

    def counts(self, level: int | None = None) -> DataFrame:
        """The number of documents by key, over all runs or those of a level."""
        paths = [p for k, runs in enumerate(self.levels) for p in runs if level in (None, k)]
        if not paths:
            return self.spark.createDataFrame([], f"{_KEY} long, {_KEY2} int, {_N} long")
        return self._read(paths).groupBy(_KEY, _KEY2).agg(F.sum(_N).alias(_N))

    def common(self) -> DataFrame:
        """The keys that enough documents hold."""
        return self.counts().where(F.col(_N) >= self.enough).select(_KEY, _KEY2)

    def add(self, batch: DataFrame) -> None:
        """batch: key, key2, n: the number of the batch's documents that hold the key."""
        if any(self.levels):
            batch = batch.join(self.common(), [_KEY, _KEY2], "left_anti")
        self._write(batch, 0)
        self.compact()

    def compact(self) -> None:
        for level in range(len(self.levels)):
            if len(old := self.levels[level]) >= self.fanout:
                self._write(self.counts(level), level + 1)
                self.levels[level] = []
                for path in old:
                    drop_path(self.spark, path)


def _keys_of(text: str) -> Column:
    """An array of (key, key2) of the text's lines, in order; null for lines without a key."""
    lines = F.split(fold_case(text_of(text)), "\n")

    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(_BLANKS))
        return F.when(key != "", F.struct(F.xxhash64(key).alias(_KEY), F.hash(key).alias(_KEY2)))

    return F.transform(lines, one)


def drop_common_lines(docs: DataFrame, text: str = "text", enough: int = 10, batches: int = 4, fanout: int = 4, copies_once: bool = False, never_empty: bool = False) -> DataFrame:
    """docs with n_lines, n_dropped (long) and text without the lines that enough documents hold.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least one code
    point that are found in enough documents (rows) lose all their lines in every document; other lines stay, joined
    by a line feed. The counts are made batch by batch in LineRuns, with the documents dealt into batches by hash.

    Only hashes are shuffled and counted, once for each document that holds the key and summed before the shuffle; each document's
    common keys are gathered (at most its own lines) and meet the text again in one join. Null text is one empty line and
    stays null if nothing is dropped from it; lines without a key stay. Repeated rows count as documents each; with
    copies_once, documents with the same set of keys count as one, so copies alone make no line common; with never_empty, a document
    of which only blanks would be left stays whole. An empty
    table gives an empty one. Columns named n_lines or n_dropped are replaced.
    """
    checked(docs, text)
    docs = docs.drop("n_lines", "n_dropped")
    same = ["__weft_t", "__weft_t2", "__weft_len"]  # equal texts have equal lines
    marked = docs.withColumns({"__weft_t": F.xxhash64(text_of(text)), "__weft_t2": F.hash(text_of(text)), "__weft_len": F.length(text_of(text))})
    keys, who = F.array_distinct(F.array_compact(_keys_of(text))), "__weft_t"
    if copies_once:
        marked, who = marked.withColumn("__weft_who", F.xxhash64(F.array_sort(keys))), "__weft_who"
    named = list(dict.fromkeys([*same, who]))
    held = marked.select(*named, F.explode(keys).alias("k"))
    held = stored(held.select(*named, f"k.{_KEY}", f"k.{_KEY2}"), "lines")
    runs = LineRuns(docs.sparkSession, enough, fanout)
    for b in range(batches):
        part = held.where(F.pmod(F.col(who), F.lit(batches)) == b)
        if copies_once:
            part = part.select(who, _KEY, _KEY2).distinct()
        runs.add(part.groupBy(_KEY, _KEY2).agg(F.count("*").alias(_N)))
    # as a table of its own, so the join with a line that a third of all documents hold can be split
    common = stored(runs.common(), "common")
    hit = held.join(common, [_KEY, _KEY2], "left_semi").select(*same, _KEY).distinct().groupBy(*same).agg(F.collect_list(_KEY).alias("__weft_common"))
    joined = marked.join(hit, same, "left")
    changed = F.col("__weft_common").isNotNull()
    joined = joined.withColumn("__weft_lines", F.split(text_of(text), "\n"))
    pairs = F.zip_with("__weft_lines", _keys_of(text), lambda line, key: F.struct(line.alias("line"), key[_KEY].alias("key")))
    kept = F.filter(pairs, lambda x: ~F.coalesce(F.array_contains(F.col("__weft_common"), x["key"]), F.lit(False)))
    joined = joined.withColumn("__weft_kept", F.when(changed, F.transform(kept, lambda x: x["line"])))
    if never_empty:
        blank = lambda line: F.btrim(line, F.lit(_BLANKS)) == ""
        joined = joined.withColumn("__weft_kept", F.when(F.exists("__weft_kept", lambda line: ~blank(line)), F.col("__weft_kept")))
        changed = F.col("__weft_kept").isNotNull()
    out = joined.withColumns({
        "n_lines": F.size("__weft_lines").cast("long"),
        "n_dropped": F.when(changed, F.size("__weft_lines") - F.size("__weft_kept")).otherwise(0).cast("long"),
        text: F.when(changed, F.array_join("__weft_kept", "\n")).otherwise(F.col(text)),
    })
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped")
