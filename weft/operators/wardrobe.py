"""Counts, gaps, summaries and profiles of wardrobes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import pairwise_similar

# How many fabrics of a category are expected; colour families (GRAY is the family's own spelling); seasonal advice.
EXPECTED = [("KENTE", 3), ("ANKARA", 3), ("LACE", 2), ("CHIFFON", 2), ("SILK", 1), ("COTTON_PLAIN", 2)]
FAMILIES = [("warm", "GOLD ORANGE RED YELLOW".split()), ("cool", "BLUE GREEN PURPLE".split()), ("neutral", "BLACK WHITE BROWN GRAY".split())]


def color_counts(fabrics: DataFrame) -> DataFrame:
    return fabrics.select(F.explode("colors.colorName").alias("color")).groupBy("color").agg(F.count("*").alias("n"))


def counts_by(fabrics: DataFrame, column: str) -> DataFrame:
    return fabrics.groupBy(column).agg(F.count("*").alias("n"))


def most_used(fabrics: DataFrame, n: int = 5) -> DataFrame:
    """Favourites, the newest first."""
    return fabrics.where("isFavorite").orderBy(F.desc("createdAt"), "id").limit(n)


def least_used(fabrics: DataFrame, n: int = 5) -> DataFrame:
    return fabrics.where("not isFavorite").orderBy("createdAt", "id").limit(n)


def stale(fabrics: DataFrame, now: int, days: int = 30) -> DataFrame:
    return fabrics.where(F.col("createdAt") < now - days * 86_400_000).orderBy("createdAt", "id")


def gaps(fabrics: DataFrame) -> DataFrame:
    """category, have, need, message of the categories with fewer fabrics than expected."""
    want = fabrics.sparkSession.createDataFrame(EXPECTED, "category string, need int")
    both = want.join(counts_by(fabrics, "category"), "category", "left").withColumn("have", F.coalesce("n", F.lit(0)))
    return both.where("have < need").select("category", "have", "need", F.concat("category", F.lit(" (have "), F.col("have").cast("string"), F.lit(", need "), F.col("need").cast("string"), F.lit(")")).alias("message"))


def missing_families(fabrics: DataFrame) -> DataFrame:
    """family: those of which no fabric has a colour."""
    names = F.explode("colors.colorName").alias("c")
    flags = fabrics.select(names).agg(*[F.coalesce(F.bool_or(F.col("c").isin(w)), F.lit(False)).alias(f) for f, w in FAMILIES])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("has")) for f, _ in FAMILIES])).alias("x")
    return flags.select(rows).where("not x.has").select("x.family")


def summary(fabrics: DataFrame) -> DataFrame:
    """One row: totals, distributions as sorted text, first and last date."""

    def spread(counts: DataFrame, name: str) -> DataFrame:
        one = F.concat(F.col(counts.columns[0]), F.lit("="), F.col("n").cast("string"))
        return counts.agg(F.array_join(F.sort_array(F.collect_list(one)), ",").alias(name))

    out = fabrics.agg(F.count("*").alias("total"), F.count_if("isFavorite").alias("favorites"), F.min("createdAt").alias("oldest"), F.max("createdAt").alias("newest"))
    # one row each
    for d in (spread(counts_by(fabrics, "category"), "categories"), spread(counts_by(fabrics, "pattern"), "patterns"), spread(color_counts(fabrics), "colors")):
        out = out.join(F.broadcast(d))
    return out


def top_shares(items: DataFrame, owner: str, column: str, n: int = 5) -> DataFrame:
    """owner, value, n, share, place of each owner's most frequent values; ties by name."""
    counts = items.groupBy(owner, column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(owner))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("n"), column))
    return counts.withColumn("share", F.col("n") / total).withColumn("place", place).where(F.col("place") <= n).withColumnRenamed(column, "value")


def style_profile(items: DataFrame, owner: str = "owner") -> DataFrame:
    """owner, styles, colors, types (the most frequent, in order), score and tips of each wardrobe.

    score: 0.6 * min(styles / 5, 1) + 0.4 * (1 - (first share - last share)), between 0 and 1.
    """

    def lists(column: str, n: int) -> DataFrame:
        top = top_shares(items, owner, column, n)
        return top.groupBy(owner).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value", "share"))), lambda x: x["value"]).alias(f"{column}s"), F.max("share").alias(f"{column}_most"), F.min("share").alias(f"{column}_least"))

    facts = items.groupBy(owner).agg(F.count("*").alias("size"), F.count_distinct("color").alias("hues"), F.bool_or(F.col("type") == "ACCESSORIES").alias("has_accessories"))
    out = facts.join(lists("style", 5), owner).join(lists("color", 5), owner).join(lists("type", 3), owner)
    score = 0.6 * F.least(F.size("styles") / 5, F.lit(1.0)) + 0.4 * (1 - (F.col("style_most") - F.col("style_least")))
    tips = F.array_compact(F.array(
        F.when(F.col("size") < 10, "capsule"), F.when(F.size("styles") == 1, "experiment"), F.when(F.col("hues") < 5, "variety"), F.when(~F.col("has_accessories"), "accessories"),
    ))
    return out.select(owner, "styles", "colors", "types", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), F.slice(tips, 1, 3).alias("tips"))


def similar_users(profiles: DataFrame, owner: int, n: int = 5) -> DataFrame:
    """owner, similarity, common: others by the Jaccard of their styles with those of one owner."""
    own = profiles.where(F.col("owner") == owner).select(F.col("styles").alias("mine"))
    both = profiles.where(F.col("owner") != owner).join(F.broadcast(own.limit(1)))
    return both.select("owner", pairwise_similar(F.col("styles"), F.col("mine")).alias("similarity"), F.array_sort(F.array_intersect("mine", "styles")).alias("common")).orderBy(F.desc("similarity"), "owner").limit(n)


def leaderboard(entries: DataFrame, n: int = 3) -> DataFrame:
    """The n entries with most votes of each challenge with their rank from 1; ties by order of entry."""
    place = F.row_number().over(Window.partitionBy("challengeId").orderBy(F.desc("voteCount"), "orderId", "line", "userId", "submissionDate"))
    return entries.withColumn("rank", place).where(F.col("rank") <= n)


def report_queue(reports: DataFrame, types: list[str], status: str | None = None, sort: str = "NEWEST") -> DataFrame:
    """Reports of one status (or all) by time, or by severity: the order of types, the last first."""
    rows = reports.where(F.col("status") == status) if status else reports
    severity = F.array_position(F.array(*map(F.lit, types)), F.col("reportType"))
    key = {"NEWEST": F.desc("createdAt"), "OLDEST": F.asc("createdAt"), "SEVERITY": severity.desc()}[sort]
    return rows.withColumn("severity", severity.cast("int") - 1).orderBy(key, "id")


def pack_audit(base: DataFrame, pack: DataFrame, specifiers) -> DataFrame:
    """key, problem of a translation (key, text) against its base: missing, extra, empty or other format specifiers."""
    b, p = base.select("key", F.col("text").alias("bt")), pack.select("key", F.col("text").alias("pt"))
    both = b.join(p, "key", "full_outer")
    problem = F.when(F.col("pt").isNull(), "missing").when(F.col("bt").isNull(), "extra").when(F.trim("pt") == "", "empty").when(specifiers(F.col("bt")) != specifiers(F.col("pt")), "specifiers")
    return both.select("key", problem.alias("problem")).where(F.col("problem").isNotNull())


def class_accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, n, accuracy by class."""
    return rows.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("int")).alias("accuracy"))


def accuracy_summary(rows: DataFrame, truth: str, guess: str, classes: list[str]) -> DataFrame:
    """n, correct, overall (share of all rows), macro (mean of the classes' shares) and classes_without_rows: classes that no row has don't count in the mean."""
    by = class_accuracy(rows, truth, guess).where(F.col("label").isin(classes))
    right = rows.agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("correct"))
    return right.join(by.agg(F.avg("accuracy").alias("macro"), (len(set(classes)) - F.count("*")).alias("classes_without_rows"))).select("n", "correct", (F.col("correct") / F.nullif(F.col("n"), F.lit(0))).alias("overall"), "macro", "classes_without_rows")


def mode_of(items: DataFrame, by: str, column: str, order: str) -> DataFrame:
    """by, value: the most frequent value; of equally frequent ones the first seen in order."""
    counts = items.groupBy(by, column).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    place: Column = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counts.withColumn("_p", place).where("_p = 1").select(by, F.col(column).alias("value"))
