"""Posts, challenges, favourites, try-ons, stories and groups: what is written and read beyond single tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.social import DAY, like
from weft.operators.store import adjusted, delete, update


def grown(rows: DataFrame, key: str, new: DataFrame, by: str, counter: str) -> DataFrame:
    """rows with their counter grown by the number of new rows that name their key."""
    counts = new.groupBy(F.col(by).alias("_k")).agg(F.count("*").alias("_n"))
    out = rows.join(counts, F.col(key) == F.col("_k"), "left")
    return out.withColumn(counter, (F.col(counter) + F.coalesce("_n", F.lit(0))).cast(rows.schema[counter].dataType)).drop("_k", "_n")


def create_posts(posts: DataFrame, users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """posts and users after new posts (the columns of posts without username): each gets its author's name, and the author's galleryCount grows.
    An unknown author is an error."""
    names = users.select(F.col("id").alias("_u"), F.col("username").alias("_name"))
    unknown = F.raise_error(F.concat(F.lit("unknown user: "), F.col("userId").cast("string")))
    named = new.join(names, F.col("userId") == F.col("_u"), "left").withColumn("username", F.when(F.col("_u").isNull(), unknown).otherwise(F.col("_name")))
    return posts.unionByName(named.select(posts.columns)), grown(users, "id", new, "userId", "galleryCount")


def toggle_like(posts: DataFrame, likes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """posts and likes after toggles (the columns of likes): a post that is liked loses the user's like and the count falls, not below 0;
    another gains both."""
    liked = posts.where("isLiked").select(F.col("id").alias("galleryItemId"))
    off, on = new.join(liked, "galleryItemId", "left_semi"), new.join(liked, "galleryItemId", "left_anti")
    posts, added = like(posts, likes, on)
    gone = off.select(F.col("galleryItemId").alias("_p")).distinct().withColumn("_off", F.lit(True))
    posts = posts.join(gone, F.col("id") == F.col("_p"), "left")
    posts = posts.withColumns({"likeCount": F.when(F.col("_off"), adjusted("likeCount", -1)).otherwise(F.col("likeCount")), "isLiked": F.col("isLiked") & F.col("_off").isNull()}).drop("_p", "_off")
    return posts, added.join(off.select("galleryItemId", "userId").distinct(), ["galleryItemId", "userId"], "left_anti")


def join_challenge(challenges: DataFrame, id) -> DataFrame:
    """The count grows with every call."""
    return update(challenges, F.col("id") == id, participantCount=F.col("participantCount") + 1, isParticipating=True)


def submit_entries(challenges: DataFrame, entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """challenges and entries after new entries: the first entry for a challenge that isn't taken part in joins it. An unknown challenge is an error."""
    known = new.join(challenges.select(F.col("id").alias("_c")), F.col("challengeId") == F.col("_c"), "left")
    checked = known.withColumn("challengeId", F.when(F.col("_c").isNull(), F.raise_error(F.lit("unknown challenge"))).otherwise(F.col("challengeId")))
    hit = new.select(F.col("challengeId").alias("_c")).distinct()
    out = challenges.join(hit, F.col("id") == F.col("_c"), "left")
    joins = F.col("_c").isNotNull() & ~F.col("isParticipating")
    out = out.withColumns({"participantCount": F.col("participantCount") + joins.cast("int"), "isParticipating": F.col("isParticipating") | joins}).drop("_c")
    return out, entries.unionByName(checked.select(entries.columns))


def already_reported(content: DataFrame, reports: DataFrame, user) -> DataFrame:
    """content (contentId, contentType) with reported: whether the user has reported it, in any state."""
    mine = reports.where(F.col("reporterId") == user).select("contentId", "contentType").distinct().withColumn("_r", F.lit(True))
    return content.join(mine, ["contentId", "contentType"], "left").withColumn("reported", F.col("_r").isNotNull()).drop("_r")


def favorite_totals(fabrics: DataFrame, favorites: DataFrame, looks: DataFrame) -> DataFrame:
    """One row: fabrics, designs, looks that are favourites, and their total."""
    parts = fabrics.where("isFavorite").select(F.lit("fabrics").alias("kind")).unionByName(favorites.select(F.lit("designs").alias("kind"))).unionByName(looks.where("isFavorite").select(F.lit("looks").alias("kind")))
    return parts.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("fabrics", "designs", "looks")], F.count("*").alias("total"))


def profile_counters(fabrics: DataFrame, styles: DataFrame, looks: DataFrame, favorites: DataFrame) -> DataFrame:
    """One row: how many fabrics, designs and looks there are, and favourites of the three kinds."""
    kinds = [(fabrics, "fabricCount"), (styles, "designCount"), (looks, "lookCount")]
    parts = [rows.select(F.lit(name).alias("kind")) for rows, name in kinds]
    parts += [rows.select(F.lit("favoriteCount").alias("kind")) for rows in (fabrics.where("isFavorite"), favorites, looks.where("isFavorite"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("fabricCount", "designCount", "lookCount", "favoriteCount")])


def period_key(kind: Column, time: Column) -> Column:
    """The counter that a use belongs to: analyses by day, try-ons by month."""
    t = F.timestamp_millis(time)
    return F.when(kind == "analysis", F.concat(F.lit("analysis_"), F.date_format(t, "yyyy-MM-dd"))).when(kind == "tryon", F.concat(F.lit("tryon_"), F.date_format(t, "yyyy-MM")))


def save_analyses(fabrics: DataFrame, history: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """fabrics and history (kind, label, timestamp) after analyses: a fabric and an event each."""
    event = new.select(F.lit("ANALYSIS").alias("kind"), F.col("name").alias("label"), F.lit(now).cast("long").alias("timestamp"))
    return fabrics.unionByName(new.select(fabrics.columns)), history.unionByName(event)


def record_tryons(looks: DataFrame, new: DataFrame, fabrics: DataFrame, styles: DataFrame) -> DataFrame:
    """looks after try-ons (the columns of looks); a fabric or a style that isn't there is an error."""
    f, s = fabrics.select(F.col("id").alias("_f")).distinct(), styles.select(F.col("id").alias("_s")).distinct()
    both = new.join(f, F.col("fabricId") == F.col("_f"), "left").join(s, F.col("dressStyleId") == F.col("_s"), "left")
    missing = F.when(F.col("_f").isNull(), F.raise_error(F.lit("unknown fabric"))).when(F.col("_s").isNull(), F.raise_error(F.lit("unknown style")))
    return looks.unionByName(both.withColumn("fabricId", F.coalesce(missing.cast("long"), F.col("fabricId"))).select(looks.columns))


def replay(actions: DataFrame, most_tries: int = 3) -> DataFrame:
    """target, kind, at: the state that a log of offline actions (seq, target, kind, at, tries) leaves: for each target the last action that
    wasn't given up after its tries."""
    kept = actions.where(F.col("tries") <= most_tries)
    return kept.groupBy("target").agg(F.max(F.struct("seq", "kind", "at")).alias("m")).select("target", "m.kind", "m.at")


def retry_delay(tries: Column, first: int = 30) -> Column:
    """Seconds before the next try: doubled each time."""
    return F.lit(first) * F.pow(F.lit(2), tries).cast("long")


# stories: id, userId, createdAt, expiresAt; views: storyId, viewer, viewedAt


def is_over(now) -> Column:
    return F.col("expiresAt") < now


def stories_of(stories: DataFrame, user, now) -> DataFrame:
    """One user's stories that aren't over, in order."""
    return stories.where((F.col("userId") == user) & ~is_over(now)).orderBy("createdAt", "id")


def story(stories: DataFrame, id, now) -> DataFrame:
    return stories.where((F.col("id") == id) & ~is_over(now))


def create_stories(stories: DataFrame, new: DataFrame) -> DataFrame:
    """stories and new ones (id, userId, createdAt), which end a day after they began."""
    return stories.unionByName(new.withColumn("expiresAt", F.col("createdAt") + DAY).select(stories.columns))


def viewers(stories: DataFrame, views: DataFrame) -> DataFrame:
    """storyId, viewCount, viewers (sorted) of every story; 0 without views."""
    seen = views.groupBy("storyId").agg(F.count_distinct("viewer").alias("n"), F.array_sort(F.collect_set("viewer")).alias("who"))
    both = stories.select(F.col("id").alias("storyId")).join(seen, "storyId", "left")
    return both.select("storyId", F.coalesce("n", F.lit(0)).alias("viewCount"), F.coalesce("who", F.array().cast(seen.schema["who"].dataType)).alias("viewers"))


def without_expired(stories: DataFrame, now) -> DataFrame:
    return delete(stories, is_over(now))


def delete_story(stories: DataFrame, id, user) -> DataFrame:
    """Only the owner's."""
    return delete(stories, (F.col("id") == id) & (F.col("userId") == user))


def have_active(stories: DataFrame, now) -> DataFrame:
    """userId, active of all users that ever had a story."""
    return stories.groupBy("userId").agg(F.bool_or(~is_over(now)).alias("active"))


# groups: id, name, category, memberCount, postCount; members: groupId, userId, role, status, joinedAt


def groups_by_category(groups: DataFrame, category: str | None = None) -> DataFrame:
    return groups if category is None else groups.where(F.col("category") == category)


def group_posts(posts: DataFrame, group) -> DataFrame:
    """The newest first."""
    return posts.where(F.col("groupId") == group).orderBy(F.desc("createdAt"), F.desc("id"))


def create_groups(groups: DataFrame, members: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """groups and members after new groups (the columns of groups but the counts, and createdBy): one member, the owner."""
    made = new.withColumns({"memberCount": F.lit(1), "postCount": F.lit(0)}).select(groups.columns)
    owners = new.select(F.col("id").alias("groupId"), F.col("createdBy").alias("userId"), F.lit("OWNER").alias("role"), F.lit("ACTIVE").alias("status"), F.lit(now).cast("long").alias("joinedAt"))
    return groups.unionByName(made), members.unionByName(owners.select(members.columns))


def create_group_posts(groups: DataFrame, posts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    return grown(groups, "id", new, "groupId", "postCount"), posts.unionByName(new.select(posts.columns))


def roles(members: DataFrame) -> DataFrame:
    """groupId, userId, role of the first membership, whatever its status."""
    return members.groupBy("groupId", "userId").agg(F.min(F.struct("joinedAt", "role")).getField("role").alias("role"))


def pending_requests(requests: DataFrame, group=None) -> DataFrame:
    rows = requests.where("status = 'PENDING'")
    return rows if group is None else rows.where(F.col("groupId") == group)


# lists of the screens


def home_rails(fabrics: DataFrame, styles: DataFrame, looks: DataFrame, gender: str | None = None) -> DataFrame:
    """rail, place, id: the three newest fabrics, four styles for a gender (or UNISEX; all styles if there is none), the newest look."""

    def first(rows: DataFrame, rail: str, n: int, *order: Column) -> DataFrame:
        top = rows.orderBy(*order).limit(n)  # so few rows that one task numbers them
        return top.select(F.lit(rail).alias("rail"), F.row_number().over(Window.orderBy(*order)).alias("place"), F.col("id").cast("string").alias("id"))

    fits = F.lit(True) if gender is None else F.col("gender").isin(gender, "UNISEX")
    some = styles.agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("_some"))  # one row
    shown = styles.join(F.broadcast(some)).where(fits | ~F.col("_some"))
    return first(fabrics, "recent", 3, F.desc("createdAt"), F.col("id")).unionByName(first(shown, "recommended", 4, F.col("ordinal"))).unionByName(first(looks, "latest", 1, F.desc("createdAt"), F.col("id")))


def variations(looks: DataFrame) -> DataFrame:
    """id, others: for each look of a group the other looks of it, sorted. A look without a group has none.

    Each group's list is made once; a look's own id is taken out of it.
    """
    lists = looks.where(F.col("variationGroup").isNotNull()).groupBy("variationGroup").agg(F.array_sort(F.collect_list("id")).alias("_all"))
    both = looks.join(lists, "variationGroup", "left")
    return both.select("id", F.coalesce(F.array_except("_all", F.array("id")), F.array().cast("array<bigint>")).alias("others"))


def variation_texts(looks: DataFrame, shares: int = 32) -> DataFrame:
    """id, others: variations() as text, the ids separated by commas.

    A group's sorted ids are cut into so many shares, each dealt to a task with the text before it and the text after it, so that few large groups don't mean
    few tasks; a look is cut out of its own share's text only. Each task has its longest texts first, and looks without a group have tasks of their own: a
    Parquet writer goes by the rows so far when it sets after how many more it looks at the size of a page again, and gathers up to 10,000 long texts in
    memory behind short ones. The result has the square of a group's size all the same.
    """
    grouped = F.col("variationGroup").isNotNull() & F.col("id").isNotNull()
    groups = looks.where(grouped).groupBy("variationGroup").agg(F.sort_array(F.collect_list("id")).alias("_all")).withColumn("_ids", F.array_distinct("_all"))
    groups = groups.withColumn("_k", F.ceil(F.size("_ids") / shares).cast("int"))
    groups = groups.withColumn("_texts", F.transform(F.sequence(F.lit(1), F.size("_ids"), F.col("_k")), lambda at: F.array_join(F.slice("_ids", at, F.col("_k")).cast("array<string>"), ",")))
    # no list is empty; _outer, for explode would make the lists once more to look for empty ones
    cut = groups.select("*", F.posexplode_outer("_texts").alias("_share", "_part")).withColumn("_own", F.slice("_ids", F.col("_share") * F.col("_k") + 1, F.col("_k")))
    # a repeated id stands once in the texts, but each of its rows is a row of the result
    rows = F.when(F.size("_all") == F.size("_ids"), F.col("_own")).otherwise(F.filter("_all", lambda x: x.between(F.element_at("_own", 1), F.element_at("_own", -1))))
    texts = {"_before": F.array_join(F.slice("_texts", 1, F.col("_share")), ","), "_part": F.concat(F.lit(","), "_part", F.lit(",")), "_after": F.array_join(F.slice("_texts", F.col("_share") + 2, F.size("_texts")), ",")}
    cut = cut.select("variationGroup", "_share", rows.alias("_rows"), *[F.nullif(text, F.lit("")).alias(name) for name, text in texts.items()])
    cut = cut.repartition(4 * looks.sparkSession.sparkContext.defaultParallelism, "variationGroup", "_share")
    cut = cut.sortWithinPartitions(F.desc(sum(F.coalesce(F.octet_length(name), F.lit(0)) for name in texts)))
    own, size = F.col("id").cast("string"), F.octet_length("_part") - 3
    rest = F.substring(F.replace(F.col("_part"), F.concat(F.lit(","), own, F.lit(",")), F.lit(",")), F.lit(2), size - F.octet_length(own))
    rest = F.when(size >= F.octet_length(own), rest)  # null, if a share has no other id
    out = cut.select(F.explode_outer("_rows").alias("id"), *texts).select("id", F.concat_ws(",", "_before", rest, "_after").alias("others"))
    return out.unionByName(looks.where(~grouped).select("id", F.lit("").alias("others")))
