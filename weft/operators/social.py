"""Follows, likes, comments, challenges, reports, quotas, stories and groups, as rewrites and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.store import adjusted, delete, update, upsert

DAY = 86_400_000


def follow(users: DataFrame, id) -> DataFrame:
    """Sets the flag; the count grows even if it was set."""
    return update(users, F.col("id") == id, isFollowing=True, followerCount=F.col("followerCount") + 1)


def unfollow(users: DataFrame, id) -> DataFrame:
    return update(users, F.col("id") == id, isFollowing=False, followerCount=adjusted("followerCount", -1))


def delete_post(posts: DataFrame, comments: DataFrame, users: DataFrame, post, owner) -> tuple[DataFrame, DataFrame, DataFrame]:
    """posts, comments and users without the owner's post and its comments; likes stay. Nobody else's post is deleted."""
    own = posts.where((F.col("id") == post) & (F.col("userId") == owner))
    found = own.select(F.col("id").alias("_p"))
    users = users.join(F.broadcast(own.select(F.col("userId").alias("_u")).limit(1)), F.col("id") == F.col("_u"), "left")
    users = users.withColumn("galleryCount", F.when(F.col("_u").isNotNull(), adjusted("galleryCount", -1)).otherwise(F.col("galleryCount"))).drop("_u")
    return posts.join(found, F.col("id") == F.col("_p"), "left_anti"), comments.join(found, F.col("galleryItemId") == F.col("_p"), "left_anti"), users


def like(posts: DataFrame, likes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new: galleryItemId, userId and the other columns of likes. A user likes a post once: repeated likes change nothing."""
    key = ["galleryItemId", "userId"]
    fresh = new.dropDuplicates(key).join(likes, key, "left_anti").select(likes.columns)
    counts = fresh.groupBy(F.col("galleryItemId").alias("_p")).agg(F.count("*").alias("_n"))
    posts = posts.join(counts, F.col("id") == F.col("_p"), "left").withColumn("likeCount", (F.col("likeCount") + F.coalesce("_n", F.lit(0))).cast("int")).withColumn("isLiked", F.col("isLiked") | F.col("_n").isNotNull()).drop("_p", "_n")
    return posts, likes.unionByName(fresh)


def unlike(posts: DataFrame, likes: DataFrame, post, user) -> tuple[DataFrame, DataFrame]:
    return update(posts, F.col("id") == post, likeCount=adjusted("likeCount", -1), isLiked=False), delete(likes, (F.col("galleryItemId") == post) & (F.col("userId") == user))


def add_comment(posts: DataFrame, comments: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    counts = new.groupBy(F.col("galleryItemId").alias("_p")).agg(F.count("*").alias("_n"))
    posts = posts.join(counts, F.col("id") == F.col("_p"), "left").withColumn("commentCount", (F.col("commentCount") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_p", "_n")
    return posts, upsert(comments, new, "id")


def counts_by_post(comments: DataFrame, likes: DataFrame) -> DataFrame:
    """galleryItemId, comments, likes of the posts that have either."""
    c = comments.groupBy("galleryItemId").agg(F.count("*").alias("comments"))
    n = likes.groupBy("galleryItemId").agg(F.count("*").alias("likes"))
    return c.join(n, "galleryItemId", "full_outer").select("galleryItemId", F.coalesce("comments", F.lit(0)).alias("comments"), F.coalesce("likes", F.lit(0)).alias("likes"))


def pending_reports(reports: DataFrame) -> DataFrame:
    return reports.where("status = 'PENDING'").groupBy("contentId", "contentType").agg(F.count("*").alias("pending"))


def set_report_status(reports: DataFrame, condition: Column, status: str, resolution: str | None, now: int) -> DataFrame:
    """resolvedAt is now, or null again for PENDING; the resolution is overwritten."""
    when = None if status == "PENDING" else now
    return update(reports, condition, status=status, resolvedAt=F.lit(when), resolution=F.lit(resolution))


def quota(history: DataFrame, now: int, bonus: DataFrame | None = None, premium: DataFrame | None = None) -> DataFrame:
    """userId, analyses, tryons: what is left of 3 a day and 2 a month; 999 for premium users.

    view events count as analyses, purchase events as try-ons; bonus: userId, kind, n.
    """
    t, today = F.timestamp_millis("timestamp"), F.timestamp_millis(F.lit(now))
    day, month = (F.date_trunc(u, t) == F.date_trunc(u, today) for u in ("day", "month"))
    used = history.groupBy("userId").agg(F.count_if((F.col("kind") == "view") & day).alias("a"), F.count_if((F.col("kind") == "purchase") & month).alias("t"))
    extra = {"view": F.lit(0), "purchase": F.lit(0)}
    if bonus is not None:
        sums = bonus.groupBy("userId").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"b_{k}") for k in extra])
        used, extra = used.join(sums, "userId", "left"), {k: F.coalesce(f"b_{k}", F.lit(0)) for k in extra}
    left = {"analyses": F.greatest(3 - (F.col("a") - extra["view"]), F.lit(0)), "tryons": F.greatest(2 - (F.col("t") - extra["purchase"]), F.lit(0))}
    if premium is None:
        return used.select("userId", *[c.alias(k) for k, c in left.items()])
    used = used.join(premium.select("userId", F.lit(True).alias("_p")).distinct(), "userId", "left")
    return used.select("userId", *[F.when(F.col("_p"), 999).otherwise(c).alias(k) for k, c in left.items()])


def active_stories(stories: DataFrame, now: int, views: DataFrame | None = None, me=None) -> DataFrame:
    """userId, stories, latest (id), hasUnviewed of users with stories that aren't over; a story is over after its last moment."""
    rows = stories.where(F.col("expiresAt") >= now)
    seen = F.lit(False)
    if views is not None:
        mine = views.where(F.col("viewer") == me).select(F.col("storyId").alias("_s")).distinct()
        rows, seen = rows.join(mine, F.col("id") == F.col("_s"), "left"), F.col("_s").isNotNull()
    return rows.groupBy("userId").agg(F.count("*").alias("stories"), F.max(F.struct("createdAt", "id")).getField("id").alias("latest"), F.bool_or(~seen).alias("hasUnviewed"))


def record_views(views: DataFrame, new: DataFrame) -> DataFrame:
    """Each viewer of a story once, the first time: storyId, viewer, viewedAt."""
    return views.unionByName(new).groupBy("storyId", "viewer").agg(F.min("viewedAt").alias("viewedAt"))


def join_group(groups: DataFrame, members: DataFrame, requests: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups, members and requests after joins (groupId, userId): members at once, or a pending request where the group asks
    for approval. Unknown groups and present members are passed over."""
    known = new.distinct().join(groups.select(F.col("id").alias("groupId"), "requiresApproval"), "groupId").join(members.where("status = 'ACTIVE'").select("groupId", "userId"), ["groupId", "userId"], "left_anti")
    direct = known.where("not requiresApproval").select("groupId", "userId", F.lit("MEMBER").alias("role"), F.lit("ACTIVE").alias("status"))
    asked = known.where("requiresApproval").select("groupId", "userId", F.lit("PENDING").alias("status")).join(requests.where("status = 'PENDING'"), ["groupId", "userId"], "left_anti")
    counts = direct.groupBy(F.col("groupId").alias("_g")).agg(F.count("*").alias("_n"))
    groups = groups.join(counts, F.col("id") == F.col("_g"), "left").withColumn("memberCount", (F.col("memberCount") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_g", "_n")
    return groups, members.unionByName(direct), requests.unionByName(asked)


def approve(groups: DataFrame, members: DataFrame, requests: DataFrame, group, user) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A pending request becomes APPROVED and a membership; without one nothing changes."""
    hit = requests.where((F.col("groupId") == group) & (F.col("userId") == user) & (F.col("status") == "PENDING")).limit(1)
    member = hit.select("groupId", "userId", F.lit("MEMBER").alias("role"), F.lit("ACTIVE").alias("status"))
    groups = groups.join(F.broadcast(hit.select(F.col("groupId").alias("_g"))), F.col("id") == F.col("_g"), "left").withColumn("memberCount", F.col("memberCount") + F.col("_g").isNotNull().cast("int")).drop("_g")
    return groups, members.unionByName(member), update(requests, (F.col("groupId") == group) & (F.col("userId") == user) & (F.col("status") == "PENDING"), status="APPROVED")


def leave_group(groups: DataFrame, members: DataFrame, group, user) -> tuple[DataFrame, DataFrame]:
    return update(groups, F.col("id") == group, memberCount=adjusted("memberCount", -1)), delete(members, (F.col("groupId") == group) & (F.col("userId") == user))


def user_groups(groups: DataFrame, members: DataFrame, user) -> DataFrame:
    mine = members.where((F.col("userId") == user) & (F.col("status") == "ACTIVE")).select("groupId").distinct()
    return groups.join(mine, groups.id == mine.groupId, "left_semi")


def search_groups(groups: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return groups.where(F.contains(F.lower("name"), q) | F.contains(F.lower("description"), q) | F.exists("tags", lambda t: F.contains(F.lower(t), q)))


def prune_history(history: DataFrame, now: int, days: int) -> DataFrame:
    """Without rows older than so many days; 0 keeps all."""
    return delete(history, F.col("timestamp") < now - days * DAY) if days > 0 else history


def keep_newest(rows: DataFrame, order: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The newest n rows, in all or of each group."""
    if not by:
        return rows.orderBy(F.desc(order)).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def collections_with_items(collections: DataFrame, items: DataFrame, types: list[str]) -> DataFrame:
    """Each collection with its items, newest first; an unknown item type is DESIGN."""
    kind = F.when(F.col("itemType").isin(types), F.col("itemType")).otherwise("DESIGN")
    lists = items.groupBy(F.col("collectionId").alias("_c")).agg(F.sort_array(F.collect_list(F.struct("addedAt", F.col("id").alias("itemKey"), kind.alias("itemType"), "itemId")), asc=False).alias("items"))
    return collections.join(lists, collections.id == lists._c, "left").drop("_c")


def fill_counts(posts: DataFrame, comments: DataFrame, likes: DataFrame) -> DataFrame:
    """posts with their counters computed from the logs."""
    counts = counts_by_post(comments, likes)
    return posts.join(counts, posts.id == counts.galleryItemId, "left").withColumns({"commentCount": F.coalesce("comments", F.lit(0)).cast("int"), "likeCount": F.coalesce("likes", F.lit(0)).cast("int")}).drop("galleryItemId", "comments", "likes")
