"""The registered queries over the catalogue, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import schema as S
from weft.functions import color, text
from weft.operators import curate, match, neardup, raster, search, social, store, tables, trends, wardrobe
from weft.sources.views import BASE, view, with_views

NOW = 1_706_500_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(*views: str, sql: str | None = None):
    """Registers a function of the views named: its name is the query's."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:  # further common tables begin with a comma
            SQL[f.__name__] = with_views(sql, *views).replace(") ,", "),").replace(") \n,", "),")
        return f

    return add


def table_query(*names: str, sql: str | None = None):
    """The same for tables of the driver."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names])
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tags_as_text(posts: DataFrame) -> DataFrame:
    return posts.withColumn("tags", F.col("tagsCsv")).drop("tagsCsv", "description")


_POST = "id, userId, title, tagsCsv AS tags, likeCount, commentCount, isLiked, createdAt, fabricId"


# reads


@query("posts", sql=f"SELECT {_POST} FROM posts")
def posts_newest(posts):
    return tables.read("gallery_items.observeAll", _tags_as_text(posts))


@query("posts", sql=f"SELECT {_POST} FROM posts WHERE userId = 42")
def posts_by_user(posts):
    return tables.read("gallery_items.observeByUser", _tags_as_text(posts), 42)


@query("posts", sql=f"SELECT {_POST} FROM posts WHERE isLiked")
def posts_liked(posts):
    return tables.read("gallery_items.observeLiked", _tags_as_text(posts))


@query("posts", sql=f"SELECT {_POST} FROM posts WHERE tagsCsv LIKE '%src1%'")
def posts_by_tag(posts):
    return tables.read("gallery_items.observeByTag", _tags_as_text(posts), "SRC1")


@query("posts", sql=f"SELECT {_POST} FROM posts WHERE id = 17")
def post_by_id(posts):
    return tables.read("gallery_items.getById", _tags_as_text(posts), 17)


@query("users", sql="SELECT * FROM users WHERE isFollowing")
def users_following(users):
    return tables.read("community_users.observeFollowing", users)


@query("users", sql="SELECT * FROM users WHERE username = 'customer_000000042'")
def user_by_name(users):
    return tables.read("community_users.getByUsername", users, "customer_000000042")


@query("comments", sql="SELECT count(*) AS count FROM comments WHERE galleryItemId = 3")
def comment_count(comments):
    return tables.read("comments.countByGalleryItem", comments, 3)


@query("comments", sql="SELECT * FROM comments WHERE galleryItemId = 3")
def comments_of_post(comments):
    return tables.read("comments.observeByGalleryItem", comments, 3)


@query("challenges", sql="SELECT * FROM challenges WHERE isActive")
def challenges_active(challenges):
    return tables.read("style_challenges.observeActive", challenges)


@query("history", sql="SELECT * FROM history ORDER BY timestamp DESC NULLS LAST, id NULLS FIRST LIMIT 200")
def history_top200(history):
    return tables.read("history.observeAll", history)


@query("history", sql="SELECT kind || '_' || userId AS query, max(timestamp) AS timestamp FROM history GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 NULLS FIRST LIMIT 10")
def recent_searches_top10(history):
    latest = history.groupBy(F.concat_ws("_", "kind", F.col("userId").cast("string")).alias("query")).agg(F.max("timestamp").alias("timestamp"))
    return tables.read("recent_searches.observeRecent", latest)


@query("reports", sql="SELECT count(*) AS count FROM reports WHERE contentId = 4 AND contentType = 'POST' AND status = 'PENDING'")
def pending_for_content(reports):
    return tables.read("reports.countPendingForContent", reports, 4, "POST")


@query("fabrics", sql="SELECT id, name, category FROM fabrics WHERE isFavorite")
def fabrics_favorite(fabrics):
    return tables.read("fabrics.observeFavorites", fabrics).select("id", "name", "category")


@query("styles", "favorites", sql="SELECT s.id, s.title, f.addedAt FROM styles s JOIN favorites f ON s.id = f.styleId")
def favorite_styles_join(styles, favorites):
    return styles.join(favorites, styles.id == favorites.styleId).orderBy(F.desc("addedAt"), "id").select("id", "title", "addedAt")


@query("users", "history", sql="SELECT u.id, u.username, EXISTS (SELECT 1 FROM history h WHERE h.kind = 'error' AND h.userId = u.id) AS blocked FROM users u")
def is_blocked_bulk(users, history):
    blocked = history.where("kind = 'error'").select(F.col("userId").alias("_b")).distinct()
    return users.join(blocked, users.id == F.col("_b"), "left").select("id", "username", F.col("_b").isNotNull().alias("blocked"))


# writes


@query("users", sql="SELECT id, username, followerCount FROM users WHERE id % 10 <> 0 UNION ALL SELECT id, 'new_' || username, followerCount + 1 FROM users WHERE id % 10 = 0 UNION ALL SELECT id + 10000000, username, followerCount FROM users WHERE id % 50 = 0")
def upsert_users(users):
    rows = users.select("id", "username", "followerCount")
    changed = rows.where("id % 10 = 0").select("id", F.concat(F.lit("new_"), "username").alias("username"), (F.col("followerCount") + 1).alias("followerCount"))
    added = rows.where("id % 50 = 0").withColumn("id", F.col("id") + 10_000_000)
    return tables.write("community_users.insertAll", rows, changed.unionByName(added))


@query("users", sql="SELECT id, username, followerCount FROM users WHERE id % 10 <> 0 UNION ALL SELECT id, username, followerCount + 5 FROM users WHERE id % 10 = 0")
def update_users(users):
    rows = users.select("id", "username", "followerCount")
    changed = rows.where("id % 10 = 0").withColumn("followerCount", F.col("followerCount") + 5)
    return tables.write("community_users.update", rows, changed.unionByName(changed.withColumn("id", F.col("id") + 10_000_000)))


@query("posts", sql="SELECT id, title FROM posts WHERE NOT (id = 12)")
def delete_post(posts):
    return tables.write("gallery_items.delete", posts.select("id", "title"), 12)


@query("history", sql=f"SELECT * FROM history WHERE NOT (timestamp < {NOW} - 7 * 86400000)")
def history_prune(history):
    return social.prune_history(history, NOW, 7)


@query("posts", sql=f"SELECT id, createdAt AS cachedAt FROM posts WHERE NOT (createdAt < {BASE} + 1000000000)")
def cache_expire(posts):
    cached = posts.select("id", F.col("createdAt").alias("cachedAt"))
    return tables.write("cached_posts.deleteOlderThan", cached, BASE + 1_000_000_000)


@query("fabrics", sql="SELECT id, CASE WHEN id = 8 THEN 'renamed' ELSE name END AS name FROM fabrics")
def fabric_rename(fabrics):
    return tables.write("fabrics.rename", fabrics.select("id", "name"), "renamed", 8)


@query("users", sql="SELECT id, CASE WHEN id = 7 THEN true ELSE isFollowing END AS isFollowing, CASE WHEN id = 7 THEN followerCount + 1 ELSE followerCount END AS followerCount FROM users")
def follow_user(users):
    return social.follow(users, 7).select("id", "isFollowing", "followerCount")


@query("posts", "likes", sql="""
, fresh AS (SELECT DISTINCT id AS galleryItemId, 5 AS userId FROM posts p WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM likes l WHERE l.galleryItemId = p.id AND l.userId = 5))
SELECT p.id, p.likeCount + CASE WHEN f.userId IS NULL THEN 0 ELSE 1 END AS likeCount, p.isLiked OR f.userId IS NOT NULL AS isLiked FROM posts p LEFT JOIN fresh f ON p.id = f.galleryItemId""")
def like_posts(posts, likes):
    new = posts.where("id % 3 = 0").select(F.lit(None).cast("long").alias("id"), F.col("id").alias("galleryItemId"), F.lit(5).cast("long").alias("userId"), F.lit(NOW).alias("createdAt"))
    return social.like(posts.select("id", "likeCount", "isLiked"), likes, new)[0]


# search


@query("posts", sql="SELECT id, title, likeCount FROM posts WHERE (contains(lower(title), 'the') OR contains(lower(description), 'the') OR contains(lower(tagsCsv), 'the')) AND list_has_any(tags, ['en', 'fr']) AND likeCount >= 100 AND commentCount >= 5")
def search_posts(posts):
    return search.search_posts(posts, "The", tags=["en", "fr"], min_likes=100, min_comments=5).select("id", "title", "likeCount")


@query("users", sql="SELECT id, username FROM users WHERE contains(lower(username), '0001') OR contains(lower(displayName), '0001')")
def search_users(users):
    return search.search_users(users, "0001").select("id", "username")


@query("posts", sql="SELECT tag, count(DISTINCT id) AS posts FROM (SELECT id, unnest(tags) AS tag FROM posts) WHERE contains(lower(tag), 'src1') GROUP BY tag")
def search_tags(posts):
    return search.search_tags(posts, "src1")


_UNIFIED = f"""
, r AS (
  SELECT 'POST' AS kind, CAST(id AS VARCHAR) AS id, title, createdAt AS timestamp, likeCount, commentCount, 0 AS branch FROM posts
  WHERE (contains(lower(title), '{{q}}') OR contains(lower(description), '{{q}}') OR len(list_filter(tags, lambda t: contains(lower(t), '{{q}}'))) > 0){{filters}}
  UNION ALL SELECT 'USER', CAST(id AS VARCHAR), displayName, createdAt, 0, 0, 1 FROM users WHERE contains(lower(username), '{{q}}') OR contains(lower(displayName), '{{q}}')
  UNION ALL SELECT DISTINCT 'TAG', tag, '#' || tag, {NOW}, 0, 0, 2 FROM (SELECT unnest(tags) AS tag FROM posts) WHERE contains(lower(tag), '{{q}}')
  UNION ALL SELECT 'CHALLENGE', CAST(id AS VARCHAR), title, startDate, 0, 0, 3 FROM challenges WHERE contains(lower(title), '{{q}}') OR contains(lower(description), '{{q}}'))
{{select}}"""
_FIRST = {"MOST_RELEVANT": "CASE WHEN lower(title) = '{q}' THEN 2 WHEN starts_with(lower(title), '{q}') THEN 1 ELSE 0 END DESC", "NEWEST": "timestamp DESC", "OLDEST": "timestamp", "MOST_LIKED": "likeCount DESC", "MOST_COMMENTED": "commentCount DESC"}


def _unified(q: str, sort: str, filters: str = "", select: str | None = None) -> str:
    """SQL of a whole unified search with the rank of each result."""
    select = select or f"SELECT *, CAST(row_number() OVER (ORDER BY {_FIRST[sort].format(q=q)}, branch, id) AS INTEGER) AS rank FROM r"
    return _UNIFIED.format(q=q, filters=filters, select=select)


def _ranked(results: DataFrame) -> DataFrame:
    """Ordered results with their rank from 1, so that the order itself is compared: the places in a sorted result."""
    return store.numbered(results)


@query("posts", "users", "challenges", sql=_unified("en", "MOST_RELEVANT"))
def search_all_relevant(posts, users, challenges):
    return _ranked(search.unified(posts, users, challenges, "EN", NOW))


@query("posts", "users", "challenges", sql=_unified("1", "NEWEST"))
def search_all_newest(posts, users, challenges):
    return _ranked(search.unified(posts, users, challenges, "1", NOW, "NEWEST"))


@query("posts", "users", "challenges", sql=_unified("1", "OLDEST"))
def search_all_oldest(posts, users, challenges):
    return _ranked(search.unified(posts, users, challenges, "1", NOW, "OLDEST"))


@query("posts", "users", "challenges", sql=_unified("es", "MOST_LIKED"))
def search_all_liked(posts, users, challenges):
    return _ranked(search.unified(posts, users, challenges, "es", NOW, "MOST_LIKED"))


@query("posts", "users", "challenges", sql=_unified("e", "MOST_COMMENTED", f" AND createdAt >= {BASE + 360_000_000} AND list_has_any(tags, ['en', 'de']) AND fabricId IN (1, 2, 3, 4, 5, 6, 7) AND likeCount >= 50 AND commentCount >= 3"))
def search_all_filtered(posts, users, challenges):
    return _ranked(search.unified(posts, users, challenges, "E", NOW, "MOST_COMMENTED", since=BASE + 360_000_000, tags=["en", "de"], fabrics=list(range(1, 8)), min_likes=50, min_comments=3))


@query("posts", "users", "challenges", sql=_unified("e", "NEWEST", select="SELECT kind, count(*) AS results FROM r GROUP BY kind"))
def search_by_kind(posts, users, challenges):
    return search.by_kind(search.unified(posts, users, challenges, "E", NOW))


@query("posts", "users", "challenges", sql="SELECT 'POST' AS kind, '' AS id, '' AS title, CAST(0 AS BIGINT) AS timestamp, 0 AS likeCount, 0 AS commentCount, 0 AS branch FROM posts WHERE false")
def search_all_blank(posts, users, challenges):
    return search.unified(posts, users, challenges, "  ", NOW)


@query("users", sql="SELECT id, username FROM users WHERE starts_with(lower(username), 'customer_00000001') OR contains(lower(displayName), 'customer_00000001') ORDER BY username LIMIT 5")
def mention_candidates(users):
    return search.mention_candidates(users, "Customer_00000001").select("id", "username")


@query("posts", sql="SELECT DISTINCT unnest(tags) AS tag FROM posts")
def all_tags(posts):
    return search.all_tags(posts)


@query("posts", "users", sql="(SELECT 'TAG' AS kind, '#' || tag AS text FROM (SELECT DISTINCT unnest(tags) AS tag FROM posts) WHERE contains(tag, '1') ORDER BY tag LIMIT 3) UNION ALL (SELECT 'USER', '@' || username FROM users WHERE contains(username, '1') ORDER BY username LIMIT 3)")
def suggestions(posts, users):
    return search.suggestions(posts, posts, users, "1")


@query("comments")
def intent_parse(comments):
    return search.parse_intent(comments).select("id", F.to_json("intent").alias("intent"))


@query("styles", "challenges")
def smart_styles(styles, challenges):
    phrases = challenges.select("id", F.concat_ws(" ", F.get(F.array(*map(F.lit, ["wedding for men", "casual linen", "kaba", "party women bold", "kente ceremony"])), (F.col("id") % 5).cast("int"))).alias("text"))
    return search.smart_styles(styles, phrases)


@query("posts", sql=f"SELECT date_trunc('week', to_timestamp(createdAt / 1000.0)::TIMESTAMP)::DATE::VARCHAR AS week, count(*) AS posts FROM posts WHERE createdAt >= {BASE} GROUP BY 1")
def posts_by_week(posts):
    return posts.where(F.col("createdAt") >= BASE).groupBy(F.date_trunc("week", F.timestamp_millis("createdAt")).cast("date").cast("string").alias("week")).agg(F.count("*").alias("posts"))


# wardrobe


@query("fabrics", sql="SELECT c.c.colorName AS color, count(*) AS n FROM (SELECT unnest(colors) AS c FROM fabrics) c GROUP BY 1")
def color_dist(fabrics):
    return wardrobe.color_counts(fabrics)


@query("fabrics", sql="SELECT category, count(*) AS n FROM fabrics GROUP BY 1")
def category_dist(fabrics):
    return wardrobe.counts_by(fabrics, "category")


@query("fabrics", sql="SELECT pattern, count(*) AS n FROM fabrics GROUP BY 1")
def pattern_dist(fabrics):
    return wardrobe.counts_by(fabrics, "pattern")


@query("fabrics", sql="SELECT id, category FROM fabrics WHERE isFavorite ORDER BY createdAt DESC, id LIMIT 5")
def most_used(fabrics):
    return wardrobe.most_used(fabrics).select("id", "category")


@query("fabrics", sql="SELECT id, category FROM fabrics WHERE NOT isFavorite ORDER BY createdAt, id LIMIT 5")
def least_used(fabrics):
    return wardrobe.least_used(fabrics).select("id", "category")


@query("fabrics", sql=f"SELECT id, createdAt FROM fabrics WHERE createdAt < {BASE + 10_000_000_000} - 30 * CAST(86400000 AS BIGINT)")
def stale_fabrics(fabrics):
    return wardrobe.stale(fabrics, BASE + 10_000_000_000).select("id", "createdAt")


_EXPECTED = ", ".join(f"('{c}', {n})" for c, n in wardrobe.EXPECTED)


@query("fabrics", sql=f"SELECT e.category, CAST(count(f.id) AS BIGINT) AS have, e.need, e.category || ' (have ' || count(f.id) || ', need ' || e.need || ')' AS message FROM (VALUES {_EXPECTED}) e(category, need) LEFT JOIN fabrics f ON f.category = e.category AND f.pattern = 'SOLID' AND f.isFavorite GROUP BY e.category, e.need HAVING count(f.id) < e.need")
def wardrobe_gaps(fabrics):
    return wardrobe.gaps(fabrics.where("pattern = 'SOLID' AND isFavorite"))


@query("fabrics", sql="SELECT family FROM (VALUES ('warm', ['GOLD','ORANGE','RED','YELLOW']), ('cool', ['BLUE','GREEN','PURPLE']), ('neutral', ['BLACK','WHITE','BROWN','GRAY'])) v(family, names) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(colors).colorName AS c FROM fabrics) x WHERE list_contains(v.names, CASE WHEN x.c IN ('BLUE', 'GREEN', 'PURPLE') THEN 'TEAL' ELSE x.c END))")
def missing_families(fabrics):
    """Over all fabrics, whose cool colours are called TEAL, which is in no family, so that one is missing."""
    teal = F.transform("colors", lambda c: F.struct(c["argb"].alias("argb"), F.when(c["colorName"].isin("BLUE", "GREEN", "PURPLE"), "TEAL").otherwise(c["colorName"]).alias("colorName")))
    return wardrobe.missing_families(fabrics.withColumn("colors", teal))


@query("fabrics", sql="""
, c AS (SELECT category || '=' || count(*) AS x FROM fabrics GROUP BY category), p AS (SELECT pattern || '=' || count(*) AS x FROM fabrics GROUP BY pattern),
k AS (SELECT c || '=' || count(*) AS x FROM (SELECT unnest(colors).colorName AS c FROM fabrics) GROUP BY c)
SELECT count(*) AS total, count(*) FILTER (WHERE isFavorite) AS favorites, min(createdAt) AS oldest, max(createdAt) AS newest, (SELECT string_agg(x, ',' ORDER BY x) FROM c) AS categories, (SELECT string_agg(x, ',' ORDER BY x) FROM p) AS patterns, (SELECT string_agg(x, ',' ORDER BY x) FROM k) AS colors FROM fabrics""")
def wardrobe_summary(fabrics):
    return wardrobe.summary(fabrics)


_SHARES = """
, s AS (SELECT owner, {c} AS value, count(*) AS n FROM wardrobe GROUP BY owner, {c}), t AS (SELECT *, n / sum(n) OVER (PARTITION BY owner) AS share, row_number() OVER (PARTITION BY owner ORDER BY n DESC, value) AS place FROM s)
SELECT owner, value, n, round(share, 6) AS share, CAST(place AS INTEGER) AS place FROM t WHERE place <= 5"""


@query("wardrobe", sql=_SHARES.format(c="style"))
def style_shares(items):
    return wardrobe.top_shares(items, "owner", "style").withColumn("share", F.round("share", 6))


@query("wardrobe", sql="""
, s AS (SELECT owner, style, count(*) AS n FROM wardrobe GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY owner) AS share, row_number() OVER (PARTITION BY owner ORDER BY n DESC, style) AS place FROM s),
u AS (SELECT owner, string_agg(style, ',' ORDER BY place) AS styles, count(*) AS k, max(share) - min(share) AS gap FROM t WHERE place <= 5 GROUP BY owner),
f AS (SELECT owner, count(*) AS size, count(DISTINCT color) AS hues, bool_or(type = 'ACCESSORIES') AS acc FROM wardrobe GROUP BY owner)
SELECT u.owner, styles, round(greatest(0.0, least(1.0, 0.6 * least(k / 5, 1.0) + 0.4 * (1 - gap))), 6) AS score,
  array_to_string(list_slice(list_filter([CASE WHEN size < 10 THEN 'capsule' END, CASE WHEN k = 1 THEN 'experiment' END, CASE WHEN hues < 5 THEN 'variety' END, CASE WHEN NOT acc THEN 'accessories' END], lambda x: x IS NOT NULL), 1, 3), ',') AS tips
FROM u JOIN f ON u.owner = f.owner""")
def style_profile(items):
    return wardrobe.style_profile(items).select("owner", F.array_join("styles", ",").alias("styles"), F.round("score", 6).alias("score"), F.array_join("tips", ",").alias("tips"))


@query("wardrobe", sql="""
, s AS (SELECT owner, style, count(*) AS n FROM wardrobe GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, style) AS place FROM s), u AS (SELECT owner, list(style) AS l FROM t WHERE place <= 5 GROUP BY owner),
m AS (SELECT l AS mine FROM u WHERE owner = 8)
SELECT owner, round(len(list_intersect(l, mine)) / len(list_distinct(list_concat(l, mine))), 6) AS similarity, array_to_string(list_sort(list_intersect(l, mine)), ',') AS common FROM u, m WHERE owner <> 8 ORDER BY similarity DESC, owner LIMIT 5""")
def similar_users(items):
    return wardrobe.similar_users(wardrobe.style_profile(items), 8).select("owner", F.round("similarity", 6).alias("similarity"), F.array_join("common", ",").alias("common"))


@query("entries", sql="SELECT * FROM (SELECT challengeId, orderId, line, userId, voteCount, CAST(row_number() OVER (PARTITION BY challengeId ORDER BY voteCount DESC, orderId, line, userId, submissionDate) AS INTEGER) AS rank FROM entries) WHERE rank <= 3")
def leaderboard(entries):
    return wardrobe.leaderboard(entries).select("challengeId", "orderId", "line", "userId", "voteCount", "rank")


_TYPES = str(S.REPORT_TYPES)


@query("reports", sql=f"SELECT id, reportType, status, list_position({_TYPES}, reportType) - 1 AS severity FROM reports WHERE status = 'PENDING'")
def report_queue(reports):
    return wardrobe.report_queue(reports, S.REPORT_TYPES, "PENDING", "SEVERITY").select("id", "reportType", "status", "severity")


@query("reports", sql="SELECT contentId, contentType, count(*) AS pending FROM reports WHERE status = 'PENDING' GROUP BY ALL")
def pending_reports(reports):
    return social.pending_reports(reports)


@query("comments", "likes", sql="SELECT coalesce(c.g, l.g) AS galleryItemId, coalesce(c.n, 0) AS comments, coalesce(l.n, 0) AS likes FROM (SELECT galleryItemId AS g, count(*) AS n FROM comments GROUP BY 1) c FULL JOIN (SELECT galleryItemId AS g, count(*) AS n FROM likes GROUP BY 1) l ON c.g = l.g")
def counts_by_post(comments, likes):
    return social.counts_by_post(comments, likes)


# trends

_TRENDS = f"""
, o AS (SELECT createdAt, unnest(tags) AS tag FROM posts), w AS (SELECT tag, count(*) AS postCount, count(*) FILTER (WHERE createdAt <= {{now}} AND createdAt > {{now}} - {trends.WEEK}) AS a, count(*) FILTER (WHERE createdAt <= {{now}} - {trends.WEEK} AND createdAt > {{now}} - {2 * trends.WEEK}) AS b FROM o GROUP BY tag),
t AS (SELECT tag, CASE WHEN starts_with(tag, 'src') THEN 'STYLE' ELSE 'HASHTAG' END AS type, postCount, CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 100.0 ELSE 0.0 END ELSE (a - b) * 100.0 / b END AS growth FROM w) """.replace("{now}", str(BASE + 2_000_000_000))
_AT = BASE + 2_000_000_000


@query("posts", sql=_TRENDS + "SELECT tag, type, postCount, round(growth, 6) AS growth FROM t WHERE type = 'STYLE' ORDER BY postCount DESC, tag LIMIT 10")
def trending(posts):
    return trends.trending(trends.tag_trends(posts, _AT), "STYLE").withColumn("growth", F.round("growth", 6))


@query("posts", sql=_TRENDS + "SELECT * FROM ((SELECT tag, type, round(growth, 6) AS growth FROM t WHERE type = 'HASHTAG' ORDER BY t.growth DESC, tag LIMIT 2) UNION ALL (SELECT tag, type, round(growth, 6) FROM t WHERE type = 'STYLE' ORDER BY t.growth DESC, tag LIMIT 2))")
def whats_hot(posts):
    return trends.whats_hot(trends.tag_trends(posts, _AT)).select("tag", "type", F.round("growth", 6).alias("growth"))


@query("posts", "likes", sql=_TRENDS + ", u AS (SELECT galleryItemId FROM likes WHERE userId = 3), a AS (SELECT tag, count(*) / greatest((SELECT count(*) FROM u), 1) AS affinity FROM (SELECT unnest(p.tags) AS tag FROM u JOIN posts p ON u.galleryItemId = p.id) GROUP BY tag) SELECT t.tag, round(0.6 * coalesce(affinity, 0.5) + 0.4 * growth / 100, 6) AS score FROM t LEFT JOIN a ON t.tag = a.tag ORDER BY 0.6 * coalesce(affinity, 0.5) + 0.4 * growth / 100 DESC, t.tag LIMIT 10")
def personalized(posts, likes):
    return trends.personalized(trends.tag_trends(posts, _AT), trends.affinities(likes, posts, 3)).select("tag", F.round("score", 6).alias("score"))


# matching

_IN = lambda c, names: f"{c} IN ({', '.join(repr(n) for n in names)})"
_STIFF = "CASE f.texture " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in S.STRUCTURE.items()) + " END"
_SCORE = f"""greatest(5, least(98, CAST(trunc(round(30.0::DOUBLE + CASE WHEN list_contains(s.affinity, f.category) THEN 18 ELSE 0 END + 10.0::DOUBLE * (1.0::DOUBLE - abs({_STIFF} - s.structure)) + CASE WHEN {_IN('f.pattern', S.STRUCTURED)} THEN 6 ELSE 4 END
 + CASE WHEN f.motifScale > 0.55 AND {_IN('s.silhouette', S.LARGE_PANEL)} THEN 8 WHEN f.motifScale < 0.35 AND {_IN('s.silhouette', S.FITTED)} THEN 8 ELSE 0 END + 12.0::DOUBLE * len(list_intersect(f.suggestedUses, s.occasions)) / greatest(len(s.occasions), 1)
 + CASE WHEN f.saturation > 0.5 OR f.saturation < 0.3 THEN 6 ELSE 0 END + CASE WHEN {_IN('f.category', S.TRADITIONAL_CLOTHS)} AND s.category = 'TRADITIONAL' THEN 8 ELSE 0 END{{more}}, 4)) AS INTEGER)))"""


@query("fabrics", "styles", sql="SELECT f.id AS fabricId, s.id AS styleId, s.ordinal, " + _SCORE.format(more="") + " AS score FROM fabrics f, styles s")
def fitmatch(fabrics, styles):
    return match.rank_styles(fabrics, styles)


_WEARER = f" + CASE WHEN {_IN('s.silhouette', S.PANEL_ALIGNED)} THEN 5.0::DOUBLE * 0.65 ELSE 0 END + CASE WHEN {_IN('s.silhouette', S.WAIST_DEFINED)} THEN 4.5 ELSE 0 END + CASE WHEN {_IN('s.silhouette', S.TALL)} THEN 3.5 ELSE 0 END + CASE WHEN s.id = 'kaba_gala' THEN 5 WHEN s.category = 'TRADITIONAL' THEN 2.5 ELSE 0 END + CASE WHEN s.gender IN ('WOMEN', 'UNISEX') THEN 3 ELSE 0 END"


@query("fabrics", "styles", sql="SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fabricId ORDER BY score DESC, ordinal) AS INTEGER) AS place FROM (SELECT f.id AS fabricId, s.id AS styleId, s.ordinal, " + _SCORE.format(more=_WEARER) + " AS score FROM fabrics f, styles s WHERE s.id <> 'beach_cover')) WHERE place <= 3")
def fitmatch_top3(fabrics, styles):
    dismissed = styles.where("id = 'beach_cover'").select(F.col("id").alias("styleId"))
    return match.top_styles(fabrics, styles, 3, dismissed, measurements=(178, 68, 98), anisotropy=0.65, favorites=["kaba_gala"], gender="WOMEN")


@query("fabrics", "styles")
def fitmatch_skin(fabrics, styles):
    return match.rank_styles(fabrics, styles, skin=0xFF8D5524)


@query("fabrics", "styles", sql=f"SELECT f.id AS fabricId, s.id AS styleId, round(greatest(0.05::DOUBLE, least(0.98::DOUBLE, 0.30::DOUBLE + 0.18::DOUBLE * CASE WHEN list_contains(s.affinity, f.category) THEN 1 ELSE 0 END + 0.10::DOUBLE * (1.0::DOUBLE - abs({_STIFF} - s.structure)) + 0.08::DOUBLE * CASE WHEN (f.motifScale > 0.55 AND {_IN('s.silhouette', S.LARGE_PANEL)}) OR (f.motifScale < 0.35 AND {_IN('s.silhouette', S.FITTED)}) THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END + 0.12::DOUBLE * (len(list_intersect(f.suggestedUses, s.occasions)) / greatest(len(s.occasions), 1)) + 0.06::DOUBLE * abs(f.saturation - 0.4::DOUBLE) + 0.08::DOUBLE * CASE WHEN {_IN('f.category', S.TRADITIONAL_CLOTHS)} AND s.category = 'TRADITIONAL' THEN 1 ELSE 0 END)), 4) AS target FROM fabrics f, styles s")
def fitmatch_features(fabrics, styles):
    return match.features(fabrics, styles)


def _pairs_sql(a: str, b: str, table: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {a} = '{k}' THEN {_IN(b, [k, *v.split()])}" for k, v in table.items()) + " ELSE true END"


_TYPE_SQL = "CASE " + " ".join(f"WHEN a.type = '{k}' THEN {_IN('b.type', v.split())}" for k, v in match.TYPE_PAIRS.items()) + " ELSE a.type <> b.type END"


@query("wardrobe", sql=f"SELECT * FROM (SELECT a.id, b.id AS suggested, CAST(row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS INTEGER) AS place FROM wardrobe a JOIN wardrobe b ON a.owner = b.owner AND a.id <> b.id AND {_TYPE_SQL} AND {_pairs_sql('a.style', 'b.style', match.STYLE_PAIRS)} AND {_pairs_sql('a.color', 'b.color', match.COLOR_PAIRS)}) WHERE place <= 3")
def complete_look(items):
    return match.complete_the_look(items)


@query("wardrobe", sql="""
, p AS (SELECT owner, type, arg_min(id, md5(CAST(id AS VARCHAR) || 'seed')) AS id FROM wardrobe GROUP BY owner, type), o AS (SELECT owner, bool_or(type = 'DRESS') AS d, count(*) FILTER (WHERE type IN ('SHIRT', 'PANTS')) = 2 AS pair FROM p GROUP BY owner)
SELECT p.owner, type, id FROM p JOIN o ON p.owner = o.owner WHERE CASE WHEN d THEN type = 'DRESS' ELSE pair AND type IN ('SHIRT', 'PANTS') END OR (type IN ('SHOES', 'BAG', 'ACCESSORIES') AND (d OR pair))""")
def outfit_pick(items):
    return match.surprise_outfit(items, "seed")


# colour

_CH = "((c >> 16) & 255) AS r, ((c >> 8) & 255) AS g, (c & 255) AS b"


@query("fabrics", sql=f"""
, k AS (SELECT id, colors[1].argb AS c FROM fabrics), x AS (SELECT id, c, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM (SELECT id, c, {_CH} FROM k)), y AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM x)
SELECT id, round(CASE WHEN mx = mn THEN 0 WHEN mx = r THEN ((g - b) / (mx - mn) + CASE WHEN g < b THEN 6 ELSE 0 END) * 60 WHEN mx = g THEN ((b - r) / (mx - mn) + 2) * 60 ELSE ((r - g) / (mx - mn) + 4) * 60 END, 4) AS h, round(CASE WHEN mx = mn THEN 0 ELSE (mx - mn) / greatest(1 - abs(mx + mn - 1), 0.0001) END, 4) AS s, round((mx + mn) / 2, 4) AS l FROM y""")
def hsl(fabrics):
    x = fabrics.select("id", color.to_hsl(F.col("colors")[0]["argb"]).alias("x"))
    return x.select("id", *[F.round(f"x.{k}", 4).alias(k) for k in "hsl"])


@query("fabrics")
def color_companions(fabrics):
    return fabrics.select("id", F.array_join(F.transform(color.companions(F.col("colors")[0]["argb"]), F.hex), ",").alias("companions"))


@query("fabrics", sql=f", k AS (SELECT id, colors[1].argb AS c FROM fabrics), x AS (SELECT id, {_CH} FROM k) SELECT id, CASE WHEN (r - b) - (r - g) * 0.5 > 22 THEN 'WARM_GOLDEN' WHEN (r - b) - (r - g) * 0.5 < 8 THEN 'COOL_DEEP' ELSE 'NEUTRAL_RICH' END AS undertone FROM x")
def undertone(fabrics):
    return fabrics.select("id", color.undertone(F.col("colors")[0]["argb"]).alias("undertone"))


@query("fabrics")
def skin_harmony(fabrics):
    return fabrics.select("id", F.round(color.skin_harmony(F.col("colors.argb"), F.lit(0xFF8D5524)), 6).alias("harmony"))


# pictures and near-duplicates

# Pictures of 9 by 8: a vector's numbers and its first eight again, and of each a near copy, in which up to three of the first numbers have the other sign.
_GRIDS = "SELECT vec_id AS id, label AS class, list_concat(embedding, list_slice(embedding, 1, 8)) AS grey FROM embeddings UNION ALL SELECT vec_id + 1000000, CASE WHEN vec_id % 5 = 0 THEN label + 1 ELSE label END, list_transform(list_concat(embedding, list_slice(embedding, 1, 8)), lambda x, i: CASE WHEN i <= vec_id % 4 THEN -x ELSE x END) FROM embeddings"
_BITS = "list_sum(list_transform(range(0, 64), lambda i: CASE WHEN grey[(i // 8) * 9 + i % 8 + 1] > grey[(i // 8) * 9 + i % 8 + 2] THEN 1::UBIGINT << (63 - i) ELSE 0::UBIGINT END))"
_PICTURES = f"g AS ({_GRIDS}), h AS (SELECT id, class, CAST({_BITS} AS UBIGINT) AS u FROM g)"


def _pictures(embeddings: DataFrame) -> DataFrame:
    """id, class, hash of the pictures made of the vectors."""
    grey = F.concat("embedding", F.slice("embedding", 1, 8))
    own = embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("class"), grey.alias("grey"))
    turned = F.transform(grey, lambda x, i: F.when(i < F.col("vec_id") % 4, -x).otherwise(x))
    near = embeddings.select((F.col("vec_id") + 1_000_000).alias("id"), F.when(F.col("vec_id") % 5 == 0, F.col("label") + 1).otherwise(F.col("label")).alias("class"), turned.alias("grey"))
    return own.unionByName(near).select("id", "class", neardup.difference_hash(F.col("grey")).alias("hash"))


@table_query("embeddings", sql=f"WITH {_PICTURES} SELECT id, CASE WHEN u >= 9223372036854775808::UBIGINT THEN CAST(u - 9223372036854775808::UBIGINT AS BIGINT) - 9223372036854775807 - 1 ELSE CAST(u AS BIGINT) END AS hash FROM h")
def difference_hashes(embeddings):
    return _pictures(embeddings).select("id", "hash")


_REPS = f"{_PICTURES}, r AS (SELECT u, min(id) AS rep FROM h GROUP BY u)"


@table_query("embeddings", sql=f"WITH {_REPS} SELECT x.rep AS a, y.rep AS b, CAST(bit_count(xor(x.u, y.u)) AS INTEGER) AS distance FROM r x JOIN r y ON x.rep < y.rep AND bit_count(xor(x.u, y.u)) <= {neardup.SAME_GROUP}")
def neardup_pairs(embeddings):
    return neardup.near_pairs(_pictures(embeddings), neardup.SAME_GROUP)[0]


@table_query("embeddings", sql=f"WITH {_REPS} SELECT h.id, r.rep FROM h JOIN r ON h.u = r.u")
def neardup_members(embeddings):
    return neardup.near_pairs(_pictures(embeddings), neardup.SAME_GROUP)[1]


# every third picture has a source, which it shares with pictures nearby
_KEYED = "k AS (SELECT id, class, u, CASE WHEN id % 3 = 0 THEN 'source' || CAST(id // 30 AS VARCHAR) END AS key FROM h)"
_GROUPED = f"WITH RECURSIVE {_PICTURES}, {_KEYED}, e AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.class = y.class AND x.id <> y.id AND ((x.key IS NULL AND y.key IS NULL AND bit_count(xor(x.u, y.u)) <= {neardup.SAME_GROUP}) OR x.key = y.key)), r(id, g) AS (SELECT id, id FROM k UNION SELECT e.b, r.g FROM r JOIN e ON r.id = e.a), c AS (SELECT id, min(g) AS grp FROM r GROUP BY id)"


def _keyed(embeddings: DataFrame) -> DataFrame:
    return _pictures(embeddings).withColumn("key", F.when(F.col("id") % 3 == 0, F.concat(F.lit("source"), F.expr("id div 30").cast("string"))))


@table_query("embeddings", sql=f"{_GROUPED} SELECT id, grp FROM c")
def neardup_components(embeddings):
    return neardup.groups(_keyed(embeddings))


_ORDERED = f"""WITH RECURSIVE {_PICTURES}, p AS (SELECT y.id AS low, x.id AS id FROM h x JOIN h y ON y.id < x.id AND bit_count(xor(x.u, y.u)) <= {neardup.NEAR}),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM h), l AS (SELECT o.n, list(q.n) FILTER (WHERE q.n IS NOT NULL) AS lows FROM o LEFT JOIN p ON p.id = o.id LEFT JOIN o q ON q.id = p.low GROUP BY o.n),
w(n, ok) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.n + 1, CASE WHEN list_has_any(w.ok, coalesce(l.lows, [])) THEN w.ok ELSE list_append(w.ok, l.n) END FROM w JOIN l ON l.n = w.n + 1),
f AS (SELECT id FROM o WHERE list_contains((SELECT ok FROM w ORDER BY n DESC LIMIT 1), n)), first AS (SELECT p.id, min(p.low) AS low FROM p JOIN f ON f.id = p.low GROUP BY p.id)
SELECT h.id, CASE WHEN f.id IS NOT NULL THEN 'ok' WHEN h.class = m.class THEN 'duplicate' ELSE 'conflict' END AS status, CASE WHEN f.id IS NULL THEN first.low ELSE -1 END AS of
FROM h LEFT JOIN f ON f.id = h.id LEFT JOIN first ON first.id = h.id LEFT JOIN h m ON m.id = first.low"""


@table_query("embeddings", sql=_ORDERED)
def dedup_in_order(embeddings):
    return neardup.dedup(_pictures(embeddings)).withColumn("of", F.coalesce("of", F.lit(-1)))


@table_query("embeddings", sql=f"WITH {_PICTURES} SELECT id FROM h WHERE id >= 1000000 AND EXISTS (SELECT 1 FROM h p WHERE p.id < 1000000 AND bit_count(xor(p.u, h.u)) <= {neardup.NEAR})")
def near_known_pictures(embeddings):
    """The made copies that are near any vector's own picture."""
    rows = _pictures(embeddings)
    return neardup.near_known(rows.where("id >= 1000000"), rows.where("id < 1000000"))


@table_query("embeddings")
def group_split(embeddings):
    rows = _keyed(embeddings)
    found = neardup.groups(rows).join(rows.select("id", F.col("class").alias("label")), "id").groupBy("label", "grp").agg(F.count("*").alias("n"))
    return neardup.group_split(found)


_PATH = "regexp_extract({}, '//[^/?#]*/([^?#]*)', 1)"


@table_query("pages", sql=f"""
WITH p AS (SELECT page_id AS id, {_PATH.format('url')} AS path, url, html FROM pages), f AS (SELECT *, min(id) OVER (PARTITION BY path) < id AS near, regexp_extract(path, '^[^/]*') AS category FROM p)
SELECT id, CASE WHEN category NOT IN ('en', 'fr', 'de') THEN 'unknown category' WHEN NOT contains(html, '<article') THEN 'missing' WHEN NOT starts_with(url, 'https:') THEN 'undecodable' WHEN near THEN 'duplicate' ELSE 'accepted' END AS status FROM f""")
def ingest_statuses(pages):
    """Pages as contributed files: the address has the category, an encrypted one stands for what can be decoded; near is a page whose path an earlier one has."""
    rows = pages.select(F.col("page_id").alias("id"), F.expr(_PATH.format("url")).alias("path"), F.contains("html", F.lit("<article")).alias("present"), F.startswith("url", F.lit("https:")).alias("decoded"))
    rows = rows.withColumn("category", F.regexp_extract("path", "^[^/]*", 0))
    near = rows.join(rows.groupBy("path").agg(F.min("id").alias("first")), "path").where("id > first").select("id")
    return curate.ingest(rows, ["en", "fr", "de"], near)


@table_query("pages", sql=f"SELECT page_id, nullif(trim(string_split(url, '#')[1]), '') AS key, 'lace_' || regexp_replace(replace({_PATH.format('url')}, '/', '_'), '^[^_]*_', '') AS name FROM pages")
def provenance_and_names(pages):
    name = curate.new_file_name(F.replace(F.expr(_PATH.format("url")), F.lit("/"), F.lit("_")), F.lit("LACE"))
    return pages.select("page_id", curate.provenance(F.col("url")).alias("key"), name.alias("name"))


@table_query("embeddings", sql="""
WITH s AS (SELECT vec_id AS id, list_slice(list_reverse_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 1, 10) AS t FROM embeddings), r AS (SELECT id, list_transform(t, lambda x: exp((x - t[1]) / 0.65::DOUBLE)) AS e FROM s), p AS (SELECT id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM r), q AS (SELECT id, p, list_sum(list_transform(p, lambda x: -x * ln(x))) / ln(10) AS h FROM p)
SELECT id, round(p[1], 6) AS top, round(h, 6) AS entropy, round(p[1] - p[2], 6) AS margin, round(p[1] * (1 - 0.35 * h), 6) AS calibrated FROM q""")
def uncertainty(embeddings):
    x = embeddings.select(F.col("vec_id").alias("id"), raster.uncertainty(F.transform("embedding", lambda v: v.cast("double"))).alias("u"))
    return x.select("id", *[F.round(f"u.{k}", 6).alias(k) for k in ("top", "entropy", "margin", "calibrated")])


@table_query("embeddings")
def texture_profiles(embeddings):
    return raster.profiles(raster.grey_grids(embeddings))


@query("fabrics")
def dominant_buckets(fabrics):
    return raster.hue_buckets(fabrics.select(F.col("id").alias("img"), F.explode("colors.argb").alias("argb"))).select("img", "bucket", "place", F.round("share", 6).alias("share"), "argb")


# curation

_STRIP = "trim(regexp_replace(regexp_replace(coalesce({}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@table_query("pages", sql=f"SELECT page_id, md5({_STRIP.format('html')}) AS text_md5 FROM pages")
def strip_html(pages):
    return pages.select("page_id", F.md5(text.strip_html(F.col("html"))).alias("text_md5"))


_BY = r"'cc[\s-]by([\s-]?sa)?([\s-]?(\d+(?:\.\d+)?))?'"


def _wide(pattern: str) -> str:
    """The pattern with word boundaries that know all letters, as Spark's do; they come in pairs."""
    first, *rest = pattern.split(r"\b")
    return first + "".join((r"(?:^|[^\p{L}\p{N}_])" if k % 2 == 0 else r"(?:$|[^\p{L}\p{N}_])") + part for k, part in enumerate(rest))


@table_query("documents", sql=f"""
WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents), x AS (SELECT line, lower({_STRIP.format('line')}) AS low FROM l)
SELECT line, CASE WHEN low = '' OR regexp_matches(low, '{_wide(text.LICENSE_REFUSED)}') THEN NULL WHEN regexp_matches(low, '{_wide(chr(92) + 'bcc0' + chr(92) + 'b')}') THEN 'CC0 1.0' WHEN regexp_matches(low, 'public\\s*domain|(?:^|[^\\p{{L}}\\p{{N}}_])pdm(?:$|[^\\p{{L}}\\p{{N}}_])|^\\s*pd(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 'Public domain'
 WHEN regexp_matches(low, {_BY}) THEN trim(CASE WHEN regexp_extract(low, {_BY}, 1) <> '' THEN 'CC BY-SA' ELSE 'CC BY' END || ' ' || regexp_extract(low, {_BY}, 3))
 {' '.join(f"WHEN regexp_matches(low, '{_wide(p)}') THEN '{n}'" for n, p in text.LICENSE_NAMES[3:])} END AS licence FROM x""".replace("\\\\", "\\"))
def license_norm(documents):
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select("line", text.license_name(F.col("line")).alias("licence"))


_HOSTS = ["https://www.alamy.com/x", "http://media.istockphoto.com/a?b", "https://www.amazon.co.uk/p", "nonsense", "", "https://user@i.pinimg.com:80/q", "HTTPS://WWW.EBAY.DE/"]
_SOME_URL = f"CASE WHEN page_id % 3 = 0 THEN ({_HOSTS})[CAST(page_id // 3 % {len(_HOSTS)} AS INTEGER) + 1] ELSE url END"
_HOST = "lower(regexp_extract({}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1))".replace("\\\\", "\\")


def _some_url() -> Column:
    """The page's address; for every third one of a few that are blocked or have no host."""
    return F.when(F.col("page_id") % 3 == 0, F.get(F.array(*map(F.lit, _HOSTS)), F.expr(f"CAST(page_id div 3 % {len(_HOSTS)} AS INT)"))).otherwise(F.col("url"))


@table_query("pages", sql=f"WITH h AS (SELECT page_id, {_HOST.format(_SOME_URL)} AS host FROM pages) SELECT page_id, host, host = '' OR list_bool_or(list_transform({list(text.BLOCKED_HOST_PARTS)}, lambda p: contains(host, p))) AS blocked FROM h")
def host_block(pages):
    return pages.select("page_id", text.host(_some_url()).alias("host"), text.host_blocked(_some_url()).alias("blocked"))


@table_query("documents", sql=r"SELECT doc_id, array_to_string(regexp_extract_all(text, '@([0-9A-Za-z_]+)', 1), ',') AS mentions FROM documents WHERE regexp_matches(text, '@[0-9A-Za-z_]')")
def mentions(documents):
    return documents.where(F.col("text").rlike("@[0-9A-Za-z_]")).select("doc_id", F.array_join(text.mentions(F.col("text")), ",").alias("mentions"))


@table_query("documents", sql="SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(documents):
    return documents.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@table_query("documents", "labels", sql="SELECT key, problem FROM (SELECT coalesce(b.key, p.key) AS key, CASE WHEN p.t IS NULL THEN 'missing' WHEN b.t IS NULL THEN 'extra' WHEN trim(p.t) = '' THEN 'empty' WHEN list_sort(regexp_extract_all(b.t, '%(?:[0-9]+[$])?[sdf%]')) <> list_sort(regexp_extract_all(p.t, '%(?:[0-9]+[$])?[sdf%]')) THEN 'specifiers' END AS problem FROM (SELECT doc_id AS key, lang || ' %s of %' || CAST(doc_id % 3 AS VARCHAR) || '$d' AS t FROM documents) b FULL JOIN (SELECT doc_id + CASE WHEN toxic = 1 THEN 1000000 ELSE 0 END AS key, CASE WHEN quality = 0 THEN ' ' ELSE '%1$d in %s' END AS t FROM labels) p ON b.key = p.key) WHERE problem IS NOT NULL")
def pack_audit(documents, labels):
    """All documents as a base, all labels as its translation: some are missing, some extra, empty or of other specifiers."""
    base = documents.select(F.col("doc_id").alias("key"), F.concat("lang", F.lit(" %s of %"), (F.col("doc_id") % 3).cast("string"), F.lit("$d")).alias("text"))
    pack = labels.select((F.col("doc_id") + F.when(F.col("toxic") == 1, 1_000_000).otherwise(0)).alias("key"), F.when(F.col("quality") == 0, " ").otherwise("%1$d in %s").alias("text"))
    return wardrobe.pack_audit(base, pack, text.format_specifiers)


_LICENCES = ["CC BY 4.0", "cc-by-sa 3.0", "CC BY-NC 4.0", "All rights reserved", "CC0", "Public Domain", "", "MIT License", "unclear", "<b>CC BY 2.0</b>", "CC BY-ND 4.0"]
_ACCEPTED = ["CC BY 4.0", "cc-by-sa 3.0", "CC0", "Public Domain", "MIT License", "<b>CC BY 2.0</b>"]
_LABELS = ["KENTE", "WAX", " ", "PAPER", "LACE", "kente", "SILK"]


@table_query("pages", sql=f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'file:///tmp/x' ELSE {_SOME_URL} END AS url, ({_LICENCES})[CAST(page_id % {len(_LICENCES)} AS INTEGER) + 1] AS licence, ({_LABELS})[CAST(page_id % {len(_LABELS)} AS INTEGER) + 1] AS label, CAST(page_id * 37 % 200 AS INTEGER) AS side FROM pages)
SELECT page_id, CASE WHEN trim(label) = '' THEN 'blank' WHEN label NOT IN {tuple(S.CATEGORIES)} THEN 'unknown label' WHEN licence NOT IN {tuple(_ACCEPTED)} THEN 'licence' WHEN starts_with(lower(url), 'file://') THEN 'local file'
  WHEN {_HOST.format('url')} = '' OR list_bool_or(list_transform({list(text.BLOCKED_HOST_PARTS)}, lambda p: contains({_HOST.format('url')}, p))) THEN 'blocked host' WHEN side < 96 THEN 'too small' END AS reason FROM r""")
def curation_outcomes(pages):
    of = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("page_id") % len(names)).cast("int"))
    url = F.when(F.col("page_id") % 13 == 0, "file:///tmp/x").otherwise(_some_url())
    return pages.select("page_id", curate.outcome(url, of(_LICENCES), of(_LABELS), S.CATEGORIES, (F.col("page_id") * 37 % 200).cast("int")).alias("reason"))


# stories, quotas, groups


@query("stories", sql=f"SELECT userId, count(*) AS stories, arg_max(id, (createdAt, id)) AS latest FROM stories WHERE expiresAt >= {NOW} - 86400000 * 2 GROUP BY userId")
def stories_active(stories):
    return social.active_stories(stories, NOW - 2 * 86_400_000).select("userId", "stories", "latest")


@query("history", sql="SELECT target AS storyId, userId AS viewer, min(timestamp) AS viewedAt FROM history WHERE kind = 'view' GROUP BY ALL")
def story_views_unique(history):
    views = history.where("kind = 'view'").select(F.col("target").alias("storyId"), F.col("userId").alias("viewer"), F.col("timestamp").alias("viewedAt"))
    return social.record_views(views.where(F.lit(False)), views)


@query("history", sql=f"SELECT userId, greatest(3 - count(*) FILTER (WHERE kind = 'view' AND date_trunc('day', make_timestamp(timestamp * 1000)) = date_trunc('day', make_timestamp({NOW} * 1000))), 0) AS analyses, greatest(2 - count(*) FILTER (WHERE kind = 'purchase' AND date_trunc('month', make_timestamp(timestamp * 1000)) = date_trunc('month', make_timestamp({NOW} * 1000))), 0) AS tryons FROM history GROUP BY userId")
def quota_remaining(history):
    return social.quota(history, NOW)


def _groups(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("Weavers of "), "n_name").alias("description"), F.array(F.lower("n_name")).alias("tags"))


@table_query("nation", "customer", sql="SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 = 3 AND c_custkey % 4 <> 0)")
def user_groups(nation, customer):
    members = customer.select(F.col("c_nationkey").alias("groupId"), (F.col("c_custkey") % 10).alias("userId"), F.when(F.col("c_custkey") % 4 == 0, "LEFT").otherwise("ACTIVE").alias("status"))
    return social.user_groups(_groups(nation), members, 3).select("id", "name")


@table_query("nation", sql="SELECT n_nationkey AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'an')")
def group_search(nation):
    return social.search_groups(_groups(nation), "AN").where(F.contains(F.lower("name"), F.lit("an"))).select("id", "name")


@query("posts", sql="SELECT id, title FROM posts ORDER BY createdAt DESC, id LIMIT 20 OFFSET 40")
def page_of_posts(posts):
    return posts.select("id", "title", "createdAt").orderBy(F.desc("createdAt"), "id").offset(40).limit(20).select("id", "title")
