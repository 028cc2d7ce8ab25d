"""Trends of tags: counts, growth, personal order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEEK = 7 * 86_400_000


def tag_trends(posts: DataFrame, now: int) -> DataFrame:
    """tag, type, postCount, growth (percent, this week's posts against those of the week before, or 100 if there were none).

    Tags that begin with src are of type STYLE, others HASHTAG.
    """
    one = posts.select("createdAt", F.explode("tags").alias("tag"))
    week = lambda k: F.count_if((F.col("createdAt") <= now - k * WEEK) & (F.col("createdAt") > now - (k + 1) * WEEK))
    out = one.groupBy("tag").agg(F.count("*").alias("postCount"), week(0).alias("this"), week(1).alias("last"))
    growth = F.when(F.col("last") == 0, F.when(F.col("this") > 0, 100.0).otherwise(0.0)).otherwise((F.col("this") - F.col("last")) * 100.0 / F.col("last"))
    return out.select("tag", F.when(F.startswith("tag", F.lit("src")), "STYLE").otherwise("HASHTAG").alias("type"), "postCount", growth.alias("growth"))


def trending(trends: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """The n trends of a type with most posts; rank follows this order."""
    top = trends.where(F.col("type") == kind).orderBy(F.desc("postCount"), "tag").limit(n)
    return top


def personalized(trends: DataFrame, affinities: DataFrame, n: int = 10) -> DataFrame:
    """Trends by 0.6 * affinity (0.5 if unknown) + 0.4 * growth / 100. affinities: tag, affinity of one user."""
    score = 0.6 * F.coalesce("affinity", F.lit(0.5)) + 0.4 * F.col("growth") / 100
    return trends.join(affinities, "tag", "left").withColumn("score", score).orderBy(F.desc("score"), "tag").limit(n)


def search_trends(trends: DataFrame, query: str, n: int = 10) -> DataFrame:
    return trends.where(F.contains(F.lower("tag"), F.lit(query.lower()))).orderBy(F.desc("postCount"), "tag").limit(n)


def whats_hot(trends: DataFrame, n: int = 5) -> DataFrame:
    """n / 2 (whole) of each of the two types by growth, together by growth: of 5 at most 4."""
    parts = [trends.where(F.col("type") == k).orderBy(F.desc("growth"), "tag").limit(n // 2) for k in ("HASHTAG", "STYLE")]
    return parts[0].unionByName(parts[1]).orderBy(F.desc("growth"), "tag").limit(n)


def affinities(likes: DataFrame, posts: DataFrame, user: int) -> DataFrame:
    """tag, affinity of a user: the share of the user's likes that went to posts with the tag."""
    own = likes.where(F.col("userId") == user).select("galleryItemId")
    n = own.agg(F.greatest(F.count("*"), F.lit(1)).alias("all"))
    tags = own.join(posts, own.galleryItemId == posts.id).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("c"))
    return tags.join(F.broadcast(n)).select("tag", (F.col("c") / F.col("all")).alias("affinity"))


def predictions(posts: DataFrame, now: int, weeks: int = 8) -> DataFrame:
    """tag, growth (percent), confidence (0.5 to 1), peak (milliseconds): next week's posts by the line through the last weeks' counts, against their mean.

    A rule of our own in the place of drawn numbers: confidence is 0.5 and half of what the line explains of the counts, and the surer, the nearer the peak, 7 to 30 days from now. Weeks without
    posts count as 0. Tags without posts in these weeks are left out.
    """
    one = posts.select(F.floor((now - F.col("createdAt")) / WEEK).alias("week"), F.explode("tags").alias("tag")).where(F.col("week").between(0, weeks - 1))
    counts = one.groupBy("tag", "week").agg(F.count("*").alias("n"))
    dense = counts.select("tag").distinct().select("tag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(weeks - 1).cast("long"))).alias("week"))
    y, x = F.coalesce("n", F.lit(0)).cast("double"), -F.col("week").cast("double")
    line = dense.join(counts, ["tag", "week"], "left").groupBy("tag").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"), F.regr_r2(y, x).alias("r2"), F.avg(y).alias("mean"))
    sure = F.coalesce(F.col("r2"), F.lit(0.0))
    growth = (F.greatest(F.col("base") + F.col("slope"), F.lit(0.0)) - F.col("mean")) / F.col("mean") * 100
    return line.select("tag", growth.alias("growth"), (0.5 + 0.5 * sure).alias("confidence"), (F.lit(now) + F.floor((7 + 23 * (1 - F.round(sure, 6))) * 86_400_000)).cast("long").alias("peak"))
