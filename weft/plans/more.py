"""Further registered queries: community, stories, groups, advice, colours, texts and curation, each with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import schema as S
from weft.functions import codec, color, text
from weft.operators import advice, community, curate, match, neardup, raster, social, trends, wardrobe
from weft.plans.catalogue import _AT, _IN, _STIFF, _TRENDS, NOW, query, table_query
from weft.sources.views import BASE

# Values that two engines round alike.
_R = lambda c, n=6: F.round(c, n)


def _in_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _case(c: str, table, otherwise: str = "NULL") -> str:
    """SQL of the name whose members hold c."""
    return "CASE " + " ".join(f"WHEN {c} IN {_in_list(members)} THEN '{name}'" for name, members in table) + f" ELSE {otherwise} END"


def _pick(names, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), index.cast("int"))


# community


@query("users", sql="SELECT id, CASE WHEN id = 9 THEN false ELSE isFollowing END AS isFollowing, CASE WHEN id = 9 THEN greatest(followerCount - 1, 0) ELSE followerCount END AS followerCount FROM users")
def unfollow_user(users):
    return social.unfollow(users, 9).select("id", "isFollowing", "followerCount")


_NEW_POSTS = "SELECT id + 10000000 AS id, userId + 1 AS userId, title, 0 AS likeCount FROM posts WHERE id % 20 = 0"


@query("posts", "users", sql=f"SELECT p.id, p.userId, p.title, p.likeCount, coalesce(u.username, '') AS username FROM posts p LEFT JOIN users u ON p.userId = u.id UNION ALL SELECT n.id, n.userId, n.title, n.likeCount, u.username FROM ({_NEW_POSTS}) n JOIN users u ON n.userId = u.id")
def create_posts(posts, users):
    named = posts.join(users.select(F.col("id").alias("userId"), "username"), "userId", "left").select("id", "userId", "title", "likeCount", F.coalesce("username", F.lit("")).alias("username"))
    new = posts.where("id % 20 = 0").select((F.col("id") + 10_000_000).alias("id"), (F.col("userId") + 1).alias("userId"), "title", F.lit(0).alias("likeCount"))
    return community.create_posts(named, users.withColumn("galleryCount", F.lit(0)), new)[0]


@query("posts", "users", sql=f"SELECT u.id, CAST(count(n.id) AS INTEGER) AS galleryCount FROM users u LEFT JOIN ({_NEW_POSTS}) n ON n.userId = u.id GROUP BY u.id")
def gallery_counts_after_posts(posts, users):
    named = posts.select("id", "userId", "title", "likeCount", F.lit("").alias("username"))
    new = posts.where("id % 20 = 0").select((F.col("id") + 10_000_000).alias("id"), (F.col("userId") + 1).alias("userId"), "title", F.lit(0).alias("likeCount"))
    return community.create_posts(named, users.withColumn("galleryCount", F.lit(0)), new)[1].select("id", "galleryCount")


@query("posts", "comments", "users", sql="SELECT c.id, c.galleryItemId FROM comments c WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.id = 12 AND p.userId = 12 AND p.id = c.galleryItemId)")
def comments_after_delete(posts, comments, users):
    return social.delete_post(posts, comments, users.withColumn("galleryCount", F.lit(1)), 12, 12)[1].select("id", "galleryItemId")


@query("posts", "likes", sql="SELECT galleryItemId, userId, createdAt FROM likes WHERE NOT (galleryItemId = 7 AND userId = 9)")
def unlike_post(posts, likes):
    return social.unlike(posts, likes, 7, 9)[1].select("galleryItemId", "userId", "createdAt")


_TOGGLES = "SELECT DISTINCT id AS g, 5 AS u FROM posts WHERE id % 2 = 0"


@query("posts", "likes", sql=f"""
, t AS ({_TOGGLES}), had AS (SELECT DISTINCT galleryItemId AS g FROM likes WHERE userId = 5)
SELECT p.id, CASE WHEN t.g IS NULL THEN likeCount WHEN isLiked THEN greatest(likeCount - 1, 0) WHEN had.g IS NULL THEN likeCount + 1 ELSE likeCount END AS likeCount,
  CASE WHEN t.g IS NULL THEN isLiked WHEN isLiked THEN false ELSE had.g IS NULL END AS isLiked FROM posts p LEFT JOIN t ON p.id = t.g LEFT JOIN had ON p.id = had.g""")
def toggle_likes(posts, likes):
    new = posts.where("id % 2 = 0").select(F.lit(None).cast("long").alias("id"), F.col("id").alias("galleryItemId"), F.lit(5).cast("long").alias("userId"), F.lit(NOW).alias("createdAt"))
    return community.toggle_like(posts.select("id", "likeCount", "isLiked"), likes, new)[0]


@query("posts", "comments", sql="SELECT p.id, p.commentCount + CAST(count(c.id) AS INTEGER) AS commentCount FROM posts p LEFT JOIN comments c ON c.galleryItemId = p.id AND c.id % 3 = 0 GROUP BY p.id, p.commentCount")
def add_comments(posts, comments):
    new = comments.where("id % 3 = 0").withColumn("id", F.col("id") + 10_000_000)
    return social.add_comment(posts, comments, new)[0].select("id", "commentCount")


@query("challenges", sql="SELECT id, CASE WHEN id = 8 THEN participantCount + 1 ELSE participantCount END AS participantCount, id = 8 OR isActive AS isParticipating FROM challenges")
def join_challenge(challenges):
    return community.join_challenge(challenges.withColumn("isParticipating", F.col("isActive")), 8).select("id", "participantCount", "isParticipating")


@query("challenges", "entries", sql="SELECT c.id, CASE WHEN n.id IS NOT NULL AND NOT isActive THEN participantCount + 1 ELSE participantCount END AS participantCount, isActive OR n.id IS NOT NULL AS isParticipating FROM challenges c LEFT JOIN (SELECT DISTINCT challengeId AS id FROM entries WHERE orderId % 50 = 0) n ON c.id = n.id")
def submit_entries(challenges, entries):
    own = entries.select("challengeId", "userId", "voteCount")
    return community.submit_entries(challenges.withColumn("isParticipating", F.col("isActive")), own, entries.where("orderId % 50 = 0").select("challengeId", "userId", "voteCount"))[0].select("id", "participantCount", "isParticipating")


@query("reports", sql="SELECT DISTINCT contentId, contentType, contentId IN (SELECT r.contentId FROM reports r WHERE r.reporterId = 7 AND r.contentType = o.contentType) AS reported FROM reports o")
def already_reported(reports):
    return community.already_reported(reports.select("contentId", "contentType").distinct(), reports, 7)


@query("reports", sql=f"SELECT id, CASE WHEN status = 'PENDING' THEN 'RESOLVED' ELSE status END AS status, CASE WHEN status = 'PENDING' THEN {NOW} ELSE 0 END AS resolvedAt, CASE WHEN status = 'PENDING' THEN 'removed' END AS resolution FROM reports")
def resolve_reports(reports):
    rows = reports.withColumns({"resolvedAt": F.lit(None).cast("long"), "resolution": F.lit(None).cast("string")})
    return social.set_report_status(rows, F.col("status") == "PENDING", "RESOLVED", "removed", NOW).select("id", "status", F.coalesce("resolvedAt", F.lit(0)).alias("resolvedAt"), "resolution")


@query("reports", sql="SELECT id, CASE WHEN reporterId IN (3, 4, 5) THEN 'PENDING' ELSE status END AS status, CASE WHEN reporterId IN (3, 4, 5) THEN 0 ELSE createdAt END AS resolvedAt FROM reports")
def reopen_selected_reports(reports):
    rows = reports.withColumns({"resolvedAt": F.col("createdAt"), "resolution": F.lit("x")})
    return social.set_report_status(rows, F.col("reporterId").isin(3, 4, 5), "PENDING", None, NOW).select("id", "status", F.coalesce("resolvedAt", F.lit(0)).alias("resolvedAt"))


@query("fabrics", "favorites", "looks", sql="SELECT (SELECT count(*) FROM fabrics WHERE isFavorite) AS fabrics, (SELECT count(*) FROM favorites) AS designs, (SELECT count(*) FROM looks WHERE isFavorite) AS looks, (SELECT count(*) FROM fabrics WHERE isFavorite) + (SELECT count(*) FROM favorites) + (SELECT count(*) FROM looks WHERE isFavorite) AS total")
def favorite_totals(fabrics, favorites, looks):
    return community.favorite_totals(fabrics, favorites, looks)


@query("fabrics", "styles", "looks", "favorites", sql="SELECT (SELECT count(*) FROM fabrics) AS fabricCount, (SELECT count(*) FROM styles) AS designCount, (SELECT count(*) FROM looks) AS lookCount, (SELECT count(*) FROM fabrics WHERE isFavorite) + (SELECT count(*) FROM favorites) + (SELECT count(*) FROM looks WHERE isFavorite) AS favoriteCount")
def profile_counters(fabrics, styles, looks, favorites):
    return community.profile_counters(fabrics, styles, looks, favorites)


@query("history", sql="SELECT id, CASE WHEN kind = 'view' THEN 'analysis_' || strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') WHEN kind = 'purchase' THEN 'tryon_' || strftime(make_timestamp(timestamp * 1000), '%Y-%m') END AS key FROM history")
def period_keys(history):
    kind = F.when(F.col("kind") == "view", "analysis").when(F.col("kind") == "purchase", "tryon")
    return history.select("id", community.period_key(kind, F.col("timestamp")).alias("key"))


@query("fabrics", "history", sql=f"SELECT kind, CAST(id AS VARCHAR) AS label, timestamp FROM history UNION ALL SELECT 'ANALYSIS', name, {NOW} FROM fabrics WHERE isFavorite")
def save_analyses(fabrics, history):
    log = history.select("kind", F.col("id").cast("string").alias("label"), "timestamp")
    return community.save_analyses(fabrics, log, fabrics.where("isFavorite"), NOW)[1]


@query("looks", "fabrics", "styles", sql="SELECT id, fabricId, dressStyleId FROM looks UNION ALL SELECT f.id + 10000000, f.id, s.id FROM fabrics f JOIN styles s ON f.id % 20 = s.ordinal")
def record_tryons(looks, fabrics, styles):
    new = fabrics.join(styles.select(F.col("id").alias("dressStyleId"), "ordinal"), F.col("id") % 20 == F.col("ordinal")).select((F.col("id") + 10_000_000).alias("id"), F.col("id").alias("fabricId"), "dressStyleId")
    return community.record_tryons(looks.select("id", "fabricId", "dressStyleId"), new, fabrics, styles)


@query("history", sql="SELECT target, arg_max(kind, id) AS kind, arg_max(timestamp, id) AS at FROM history WHERE id % 5 <= 3 GROUP BY target")
def offline_replay(history):
    return community.replay(history.select(F.col("id").alias("seq"), "target", "kind", F.col("timestamp").alias("at"), (F.col("id") % 5).alias("tries")))


@query("collections", "collection_items", sql="""
, i AS (SELECT collectionId, CASE WHEN itemType IN ('DESIGN', 'FABRIC', 'LOOK') THEN itemType ELSE 'DESIGN' END AS t, itemId, addedAt, id FROM collection_items)
SELECT c.id, c.name, coalesce(string_agg(t || ':' || itemId, ',' ORDER BY addedAt DESC, i.id DESC), '') AS items FROM collections c LEFT JOIN i ON i.collectionId = c.id GROUP BY c.id, c.name""")
def collections_nested(collections, items):
    nested = social.collections_with_items(collections, items, ["DESIGN", "FABRIC", "LOOK"])
    listed = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["itemType"], x["itemId"])), ",")
    return nested.select("id", "name", F.coalesce(listed, F.lit("")).alias("items"))


@query("collections", "collection_items", sql="SELECT c.id, count(i.id) AS looks FROM collections c LEFT JOIN collection_items i ON i.collectionId = c.id AND i.itemType = 'LOOK' GROUP BY c.id")
def collection_tab(collections, items):
    tab = items.where(F.col("itemType") == "LOOK").groupBy(F.col("collectionId").alias("_c")).agg(F.count("*").alias("n"))
    return collections.join(tab, F.col("id") == F.col("_c"), "left").select("id", F.coalesce("n", F.lit(0)).alias("looks"))


@query("outfits", sql="SELECT id, list_transform(list_filter(string_split(itemIdsCsv, ','), lambda x: try_cast(x AS BIGINT) IS NOT NULL), lambda x: CAST(x AS BIGINT))::VARCHAR AS ids FROM outfits")
def outfit_ids(outfits):
    return outfits.select("id", F.concat(F.lit("["), F.array_join(codec.csv_longs(F.col("itemIdsCsv")).cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query("outfits", "closet", sql="SELECT o.id AS set, c.id, c.name, c.category FROM (SELECT DISTINCT id, try_cast(unnest(string_split(itemIdsCsv, ',')) AS BIGINT) AS m FROM outfits) o JOIN closet c ON o.m = c.id")
def outfit_members(outfits, closet):
    return advice.members(outfits.withColumn("ids", codec.csv_longs(F.col("itemIdsCsv"))).select(F.col("id").alias("set_id"), "ids"), "ids", closet, "set_id").select("set", "id", "name", "category")


@query("posts", "fabrics", "styles", sql="SELECT p.id AS post, f.id AS fabric, f.category, s.title AS style FROM posts p JOIN fabrics f ON p.fabricId = f.id LEFT JOIN styles s ON s.ordinal = p.id % 25")
def post_materials(posts, fabrics, styles):
    of = advice.members(posts.select(F.col("id").alias("post"), F.array("fabricId").alias("ids")), "ids", fabrics.select("id", "category"), "post")
    return of.join(styles.select("ordinal", F.col("title").alias("style")), F.col("set") % 25 == F.col("ordinal"), "left").select(F.col("set").alias("post"), F.col("id").alias("fabric"), "category", "style")


@query("feedback", sql="SELECT DISTINCT styleId FROM feedback WHERE dismissed")
def dismissed_styles(feedback):
    return feedback.where("dismissed").select("styleId").distinct()


# stories


_STORY_NOW = NOW - 2 * 86_400_000


@query("stories", sql=f"SELECT id, createdAt FROM stories WHERE userId = 9 AND NOT expiresAt < {_STORY_NOW - 20 * 86_400_000}")
def stories_of_user(stories):
    return community.stories_of(stories, 9, _STORY_NOW - 20 * 86_400_000).select("id", "createdAt")


@query("stories", sql=f"SELECT id, userId FROM stories WHERE id = (SELECT max(id) FROM stories) AND NOT expiresAt < {BASE}")
def story_by_id(stories):
    last = stories.agg(F.max("id")).first()[0]
    return community.story(stories, last, BASE).select("id", "userId")


@query("stories", "users", sql=f"SELECT id, userId, expiresAt FROM stories UNION ALL SELECT id + 10000000, id, {NOW} + 86400000 FROM users WHERE isFollowing")
def create_stories(stories, users):
    new = users.where("isFollowing").select((F.col("id") + 10_000_000).alias("id"), F.col("id").alias("userId"), F.lit(NOW).cast("long").alias("createdAt"))
    return community.create_stories(stories, new).select("id", "userId", "expiresAt")


@query("stories", "history", sql="SELECT s.id AS storyId, count(DISTINCT h.userId) AS viewCount, coalesce(array_to_string(list_sort(list(DISTINCT h.userId) FILTER (WHERE h.userId IS NOT NULL)), ','), '') AS viewers FROM stories s LEFT JOIN history h ON h.kind = 'click' AND h.target = s.id GROUP BY s.id")
def story_viewers(stories, history):
    views = history.where("kind = 'click'").select(F.col("target").alias("storyId"), F.col("userId").alias("viewer"), F.col("timestamp").alias("viewedAt"))
    return community.viewers(stories, views).select("storyId", "viewCount", F.array_join(F.col("viewers").cast("array<string>"), ",").alias("viewers"))


@query("stories", sql=f"SELECT id FROM stories WHERE NOT (expiresAt < {_STORY_NOW - 10 * 86_400_000})")
def stories_cleaned(stories):
    return community.without_expired(stories, _STORY_NOW - 10 * 86_400_000).select("id")


@query("stories", sql="SELECT id, userId FROM stories WHERE NOT (userId = 9 AND id = (SELECT min(id) FROM stories WHERE userId = 9))")
def story_deleted(stories):
    first = stories.where("userId = 9").agg(F.min("id")).first()[0]
    return community.delete_story(stories, first, 9).select("id", "userId")


@query("stories", sql=f"SELECT userId, bool_or(NOT expiresAt < {_STORY_NOW}) AS active FROM stories GROUP BY userId")
def users_with_stories(stories):
    return community.have_active(stories, _STORY_NOW)


@query("stories", "history", sql=f"SELECT s.userId, count(*) AS stories, arg_max(s.id, (createdAt, s.id)) AS latest, bool_or(v.target IS NULL) AS hasUnviewed FROM stories s LEFT JOIN (SELECT DISTINCT target FROM history WHERE kind = 'click' AND userId = 3) v ON s.id = v.target WHERE expiresAt >= {_STORY_NOW - 25 * 86_400_000} GROUP BY s.userId")
def stories_unviewed(stories, history):
    views = history.where("kind = 'click'").select(F.col("target").alias("storyId"), F.col("userId").alias("viewer"))
    return social.active_stories(stories, _STORY_NOW - 25 * 86_400_000, views, 3)


# groups: nations, with customers as members

_GROUP_SQL = "WITH g AS (SELECT n_nationkey AS id, n_name AS name, CASE n_regionkey % 3 WHEN 0 THEN 'STYLE' WHEN 1 THEN 'FABRIC' ELSE 'LOCAL' END AS category, n_nationkey % 4 = 0 AS requiresApproval, 10 AS memberCount, 2 AS postCount FROM nation), m AS (SELECT c_nationkey AS groupId, c_custkey % 10 AS userId, CASE WHEN c_custkey % 7 = 0 THEN 'OWNER' ELSE 'MEMBER' END AS role, CASE WHEN c_custkey % 4 = 0 THEN 'LEFT' ELSE 'ACTIVE' END AS status, c_custkey AS joinedAt FROM customer) "


def _groups(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), _pick(["STYLE", "FABRIC", "LOCAL"], F.col("n_regionkey") % 3).alias("category"), (F.col("n_nationkey") % 4 == 0).alias("requiresApproval"), F.lit(10).alias("memberCount"), F.lit(2).alias("postCount"))


def _members(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_nationkey").alias("groupId"), (F.col("c_custkey") % 10).alias("userId"), F.when(F.col("c_custkey") % 7 == 0, "OWNER").otherwise("MEMBER").alias("role"), F.when(F.col("c_custkey") % 4 == 0, "LEFT").otherwise("ACTIVE").alias("status"), F.col("c_custkey").alias("joinedAt"))


@table_query("nation", sql=_GROUP_SQL + "SELECT id, name FROM g WHERE category = 'FABRIC'")
def groups_by_category(nation):
    return community.groups_by_category(_groups(nation), "FABRIC").select("id", "name")


@table_query("nation", "orders", sql="SELECT o_orderkey AS id, o_orderkey * 17 % 1000 AS createdAt FROM orders WHERE o_custkey % 25 = 4")
def group_posts(nation, orders):
    posts = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("groupId"), (F.col("o_orderkey") * 17 % 1000).alias("createdAt"))
    return community.group_posts(posts, 4).select("id", "createdAt")


@table_query("nation", "customer", sql=_GROUP_SQL + ", n AS (SELECT DISTINCT r_nation AS groupId, u AS userId FROM (SELECT n_nationkey AS r_nation, unnest([1, 3, 77]) AS u FROM nation)), f AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.groupId = n.groupId AND m.userId = n.userId AND m.status = 'ACTIVE')) SELECT g.id, CAST(memberCount + count(f.userId) FILTER (WHERE NOT requiresApproval) AS INTEGER) AS memberCount FROM g LEFT JOIN f ON f.groupId = g.id GROUP BY g.id, memberCount")
def join_groups(nation, customer):
    requests = nation.select(F.col("n_nationkey").alias("groupId"), F.lit(0).cast("long").alias("userId"), F.lit("PENDING").alias("status")).where(F.lit(False))
    new = nation.select(F.col("n_nationkey").alias("groupId"), F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 3, 77)])).alias("userId"))
    return social.join_group(_groups(nation), _members(customer).drop("joinedAt"), requests, new)[0].select("id", "memberCount")


@table_query("nation", "customer", sql=_GROUP_SQL + ", n AS (SELECT n_nationkey AS groupId, unnest([1, 3, 77]) AS userId FROM nation) SELECT n.groupId, CAST(n.userId AS BIGINT) AS userId, 'PENDING' AS status FROM n JOIN g ON g.id = n.groupId AND g.requiresApproval WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.groupId = n.groupId AND m.userId = n.userId AND m.status = 'ACTIVE')")
def join_requests(nation, customer):
    requests = nation.select(F.col("n_nationkey").alias("groupId"), F.lit(0).cast("long").alias("userId"), F.lit("PENDING").alias("status")).where(F.lit(False))
    new = nation.select(F.col("n_nationkey").alias("groupId"), F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 3, 77)])).alias("userId"))
    return community.pending_requests(social.join_group(_groups(nation), _members(customer).drop("joinedAt"), requests, new)[2])


@table_query("nation", "customer", sql=_GROUP_SQL + "SELECT groupId, userId, role, status FROM m WHERE NOT (groupId = 3 AND userId = 7)")
def leave_group(nation, customer):
    return social.leave_group(_groups(nation), _members(customer), 3, 7)[1].select("groupId", "userId", "role", "status")


@table_query("nation", sql=_GROUP_SQL + "SELECT id, memberCount + CASE WHEN id = 8 THEN 1 ELSE 0 END AS memberCount FROM g")
def approve_request(nation):
    requests = nation.select(F.col("n_nationkey").alias("groupId"), F.lit(77).cast("long").alias("userId"), F.lit("PENDING").alias("status"))
    nobody = requests.select("groupId", "userId", F.lit("MEMBER").alias("role"), F.lit("ACTIVE").alias("status")).where(F.lit(False))
    return social.approve(_groups(nation), nobody, requests, 8, 77)[0].select("id", "memberCount")


@table_query("nation", "region", "customer", sql=_GROUP_SQL + f"SELECT groupId, userId, role, status, joinedAt FROM m UNION ALL SELECT r_regionkey + 1000, r_regionkey + 5, 'OWNER', 'ACTIVE', {NOW} FROM region")
def create_groups(nation, region, customer):
    new = region.select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name"), F.lit("STYLE").alias("category"), F.lit(False).alias("requiresApproval"), (F.col("r_regionkey") + 5).cast("long").alias("createdBy"))
    return community.create_groups(_groups(nation), _members(customer), new, NOW)[1]


@table_query("nation", "orders", sql=_GROUP_SQL + "SELECT g.id, CAST(postCount + count(o_orderkey) AS INTEGER) AS postCount FROM g LEFT JOIN orders ON o_custkey % 25 = g.id AND o_orderkey % 9 = 0 GROUP BY g.id, postCount")
def create_group_posts(nation, orders):
    posts = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("groupId"))
    return community.create_group_posts(_groups(nation), posts, posts.where("id % 9 = 0"))[0].select("id", "postCount")


@table_query("customer", sql=_GROUP_SQL + "SELECT groupId, userId, arg_min(role, joinedAt) AS role FROM m GROUP BY groupId, userId")
def group_roles(customer):
    return community.roles(_members(customer))


# lists and looks


@query("fabrics", "styles", "looks", sql="SELECT 'recent' AS rail, CAST(row_number() OVER (ORDER BY createdAt DESC, id) AS INTEGER) AS place, CAST(id AS VARCHAR) AS id FROM fabrics QUALIFY place <= 3 UNION ALL SELECT * FROM (SELECT 'recommended', CAST(row_number() OVER (ORDER BY ordinal) AS INTEGER) AS place, id FROM styles WHERE gender IN ('MEN', 'UNISEX')) WHERE place <= 4 UNION ALL SELECT * FROM (SELECT 'latest', CAST(row_number() OVER (ORDER BY createdAt DESC, id) AS INTEGER) AS place, CAST(id AS VARCHAR) FROM looks) WHERE place <= 1")
def home_rails(fabrics, styles, looks):
    return community.home_rails(fabrics, styles, looks, "MEN")


@query("looks", sql="SELECT a.id, coalesce(string_agg(b.id, ',' ORDER BY b.id), '') AS others FROM looks a LEFT JOIN looks b ON a.variationGroup = b.variationGroup AND a.id <> b.id GROUP BY a.id")
def look_variations(looks):
    return community.variation_texts(looks)


@query("styles", sql="SELECT 'OCCASION' AS chip, id FROM styles WHERE category = 'TRADITIONAL' UNION ALL SELECT 'CASUAL', id FROM styles WHERE category = 'CASUAL' UNION ALL SELECT 'FORMAL', id FROM styles WHERE category = 'FORMAL' UNION ALL SELECT 'FABRICS', id FROM styles")
def category_chips(styles):
    out = [advice.by_chip(styles, chip).select(F.lit(chip).alias("chip"), "id") for chip in ("OCCASION", "CASUAL", "FORMAL", "FABRICS")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("styles", sql="SELECT id, CAST(row_number() OVER (ORDER BY CASE id WHEN 'coords_city' THEN 1 WHEN 'kaba_day' THEN 2 ELSE 3 END, ordinal) AS INTEGER) AS place FROM styles")
def featured_first(styles):
    from weft.plans.catalogue import _ranked

    return _ranked(advice.featured_first(styles, ("coords_city", "kaba_day"))).select("id", F.col("rank").alias("place"))


@query("fabrics", sql="SELECT id, name FROM fabrics WHERE contains(lower(name), 'red')")
def fabrics_by_name(fabrics):
    return advice.with_name_like(fabrics, "name", "RED").select("id", "name")


@query("styles", sql="SELECT id, title FROM styles WHERE contains(lower(title), 'ka') OR contains(lower(silhouette), 'ka') OR contains(lower(category), 'ka')")
def preview_list(styles):
    return advice.preview_list(styles, "KA", "title").select("id", "title")


@query("fabrics", "styles", sql=f"""
SELECT f.id AS fabricId, s.id AS styleId, list_transform([{_STIFF}, s.structure, least(1.0, f.motifScale), CASE WHEN {_IN('s.silhouette', S.LARGE_PANEL)} THEN 1.0 ELSE 0.0 END, CASE WHEN {_IN('s.silhouette', S.FITTED)} THEN 1.0 ELSE 0.0 END,
  CASE WHEN list_contains(s.affinity, f.category) THEN 1.0 ELSE 0.0 END, len(list_intersect(f.suggestedUses, s.occasions)) / len(s.occasions), f.saturation, CASE WHEN {_IN('f.category', S.TRADITIONAL_CLOTHS)} AND s.category = 'TRADITIONAL' THEN 1.0 ELSE 0.0 END, 0.5, 0.65,
  CASE WHEN {_IN('s.silhouette', S.PANEL_ALIGNED)} THEN 1.0 ELSE 0.0 END, CASE WHEN {_IN('s.silhouette', S.WAIST_DEFINED)} THEN 1.0 ELSE 0.3 END, CASE WHEN {_IN('s.silhouette', S.TALL)} THEN 1.0 ELSE 0.25 END,
  CASE WHEN s.id = 'kaba_gala' THEN 1.0 WHEN s.category = 'TRADITIONAL' THEN 0.5 ELSE 0.0 END, CASE WHEN s.gender IN ('WOMEN', 'UNISEX') THEN 1.0 ELSE 0.0 END], lambda x: CAST(round(x * 10000) AS BIGINT))::VARCHAR AS features FROM fabrics f, styles s""")
def feature_vectors(fabrics, styles):
    x = advice.feature_vector(fabrics, styles, measurements=(178, 68, 98), anisotropy=0.65, favorites=["kaba_gala"], loved=["TRADITIONAL"], gender="WOMEN")
    whole = F.transform("features", lambda v: F.round(v * 10000).cast("long").cast("string"))
    return x.select("fabricId", "styleId", F.concat(F.lit("["), F.array_join(whole, ", "), F.lit("]")).alias("features"))


_SERVER = f"CAST(greatest(48, least(98, round_even(round(38.0::DOUBLE + CASE WHEN list_contains(s.affinity, f.category) THEN 20 ELSE 5 END + 10.0::DOUBLE * (1.0::DOUBLE - abs(0.75::DOUBLE - s.structure)) + 8.0::DOUBLE * CASE WHEN {_IN('s.silhouette', advice.SERVER_WAIST)} THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END + 6.0::DOUBLE * CASE WHEN {_IN('s.silhouette', advice.SERVER_LARGE)} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 6.0::DOUBLE * 0.52::DOUBLE * CASE WHEN {_IN('s.silhouette', S.PANEL_ALIGNED)} THEN 1 ELSE 0 END + 8.0::DOUBLE * 0.92::DOUBLE, 6), 0))) AS INTEGER)"


@query("fabrics", "styles", sql=f"SELECT f.id AS fabricId, s.id AS styleId, array_to_string(list_transform(string_split(s.id, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title, {_SERVER} AS score FROM fabrics f, styles s WHERE s.gender IN ('WOMEN', 'UNISEX')")
def server_rank(fabrics, styles):
    return advice.server_rank(fabrics, styles, 0.52, "WARM_GOLDEN", 70, 98, 175, "WOMEN")


@query("fabrics", "styles", sql="SELECT f.id AS fabricId, s.id AS styleId FROM fabrics f, styles s WHERE s.gender IN ('MEN', 'UNISEX') AND list_has_any(s.occasions, ['OFFICE', 'PARTY'])")
def ranked_for_wearer(fabrics, styles):
    return advice.ranked_for(match.rank_styles(fabrics, styles), styles, "MEN", ["OFFICE", "PARTY"]).select("fabricId", "styleId")


@query("styles", sql="SELECT 'cloth' AS asked, id FROM styles WHERE list_contains(affinity, 'KENTE') AND gender = 'WOMEN' UNION ALL SELECT 'any', id FROM styles WHERE gender = 'UNISEX' UNION ALL SELECT 'all', id FROM styles")
def inspiration(styles):
    looks = styles.withColumn("fabrics", F.col("affinity"))
    ask = lambda name, category, gender: advice.inspiration(looks, category, gender).select(F.lit(name).alias("asked"), "id")
    return ask("cloth", "KENTE", "WOMEN").unionByName(ask("any", "UNKNOWN", "UNISEX")).unionByName(ask("all", None, None))


_GO = lambda a, b, table: "CASE " + " ".join(f"WHEN {a} = '{k}' THEN {_IN(b, [k, *v.split()])}" for k, v in table.items()) + " ELSE true END"
_SHARE = lambda c, table: f"CASE WHEN len({c}) < 2 THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(1, len({c})), lambda i: CASE WHEN {_GO(f'{c}[i]', f'{c}[i + 1]', table)} THEN 1 ELSE 0 END)) / (len({c}) - 1) END"


@query("wardrobe", sql=f"""
, n AS (SELECT w.*, k.number, CASE WHEN type IN ('SHIRT', 'JACKET') THEN 0 WHEN type IN ('PANTS', 'SKIRT') THEN 1 WHEN type = 'SHOES' THEN 2 WHEN type IN ('BAG', 'ACCESSORIES') THEN 3 END AS part FROM wardrobe w, (SELECT unnest(range(0, 3)) AS number) k),
p AS (SELECT owner, number, part, arg_min(struct_pack(id := id, style := style, color := color), (md5(CAST(id AS VARCHAR) || 'seed' || CAST(number AS VARCHAR)), id)) AS x FROM n WHERE part IS NOT NULL GROUP BY owner, number, part),
l AS (SELECT owner, number, list(x.id ORDER BY part) AS ids, list(x.style ORDER BY part) AS st, list(x.color ORDER BY part) AS co FROM p GROUP BY owner, number HAVING count(*) FILTER (WHERE part IN (0, 1)) = 2),
v AS (SELECT *, list_transform(st, lambda s: len(list_filter(st, lambda t: t = s))) AS votes FROM l WHERE owner IN (SELECT owner FROM wardrobe GROUP BY owner HAVING count(*) >= 3)),
o AS (SELECT *, st[list_position(votes, list_max(votes))] AS style FROM v)
SELECT owner, CAST(number AS INTEGER) AS number, array_to_string(ids, ',') AS items, style, {_case('style', advice.WORN_FOR, "'Casual Outing'")} AS occasion, round(0.5::DOUBLE * {_SHARE('co', match.COLOR_PAIRS)} + 0.5::DOUBLE * {_SHARE('st', match.STYLE_PAIRS)}, 6) AS confidence FROM o""")
def wardrobe_outfits(items):
    x = advice.outfits(items, "seed", 3)
    return x.select("owner", "number", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "style", "occasion", _R("confidence").alias("confidence"))


@query("wardrobe", sql=f"SELECT id, CASE WHEN {_GO('style', chr(39) + 'Casual' + chr(39), match.STYLE_PAIRS)} AND {_GO('style', chr(39) + 'Vintage' + chr(39), match.STYLE_PAIRS)} AND {_GO('color', chr(39) + 'White' + chr(39), match.COLOR_PAIRS)} AND {_GO('color', chr(39) + 'Navy' + chr(39), match.COLOR_PAIRS)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fits, {_case('style', advice.WORN_FOR, chr(39) + 'Casual Outing' + chr(39))} AS occasion FROM wardrobe")
def style_match(items):
    some = lambda *x: F.array(*map(F.lit, x))
    return items.select("id", advice.style_match(F.col("style"), F.col("color"), some("Casual", "Vintage"), some("White", "Navy")).alias("fits"), advice.occasion_of(F.col("style")).alias("occasion"))


@query("measured", "styles", sql=f"SELECT m.id, s.id AS styleId, CASE WHEN waistCm / hipCm < 0.78::DOUBLE AND {_IN('s.silhouette', S.WAIST_DEFINED)} THEN 1.0::DOUBLE WHEN waistCm / hipCm >= 0.85::DOUBLE AND {_IN('s.silhouette', S.LARGE_PANEL)} THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS fit FROM measured m, styles s")
def waist_fit(measured, styles):
    """How a style's waist fits each wearer, by the wearer's own numbers; the styles are a catalogue."""
    s = F.col("silhouette")
    ratio = F.col("waistCm") / F.col("hipCm")
    fit = F.when((ratio < 0.78) & s.isin(S.WAIST_DEFINED), 1.0).when((ratio >= 0.85) & s.isin(S.LARGE_PANEL), 0.8).otherwise(0.3)
    return measured.join(styles.select(F.col("id").alias("styleId"), "silhouette")).select("id", "styleId", fit.alias("fit"))


@query("styles", sql="SELECT id, round(CASE WHEN " + _IN("silhouette", S.WAIST_DEFINED) + " THEN 4.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN " + _IN("silhouette", S.TALL) + " THEN 3.5::DOUBLE ELSE 0::DOUBLE END, 2) AS slim_tall, round(CASE WHEN " + _IN("silhouette", S.LARGE_PANEL) + " THEN 3.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN " + _IN("silhouette", S.ELONGATING) + " THEN 3.5::DOUBLE ELSE 0::DOUBLE END, 2) AS wide_short, gender IN ('MEN', 'UNISEX') AS for_men FROM styles")
def measurement_bonus(styles):
    s = F.col("silhouette")
    return styles.select("id", _R(match.measurement_bonus(s, 180, 70, 100), 2).alias("slim_tall"), _R(match.measurement_bonus(s, 150, 90, 100), 2).alias("wide_short"), match.suits_gender(F.col("gender"), "MEN").alias("for_men"))


_LABEL = lambda c: f"CASE WHEN upper(trim({c})) IN {_in_list([x for x in S.CATEGORIES if x != 'UNKNOWN'])} THEN upper(trim({c})) " + " ".join("WHEN " + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in advice.LABEL_WORDS) + " END"
_SOME_LABELS = ["velvet", "Cardigan", "blue jean", "doily", "kente_print", "stole", "WAX", " Silk ", "towel", "racer", "Kente", "tiger cat", "adire cloth", "hoopskirt", "gown", "unknown", ""]


@query("fabrics", sql=f"SELECT id, {_LABEL(f'({_list(_SOME_LABELS)})[CAST(id % {len(_SOME_LABELS)} AS INTEGER) + 1]')} AS category FROM fabrics")
def label_categories(fabrics):
    return fabrics.select("id", advice.label_category(_pick(_SOME_LABELS, F.col("id") % len(_SOME_LABELS))).alias("category"))


_VEC_LABELS = [f"{a} {b}" for a in ("kente", "velvet", "car", "wool", "silk", "dog", "lace", "linen") for b in ("one", "two", "three", "four", "five", "six", "seven", "eight")]


@table_query("embeddings", sql=f"""
WITH h AS (SELECT vec_id AS id, list_slice(list_sort(list_transform(embedding, lambda x, i: struct_pack(k := -x, i := i))), 1, 3) AS l FROM embeddings), n AS (SELECT id, list_transform(l, lambda p: struct_pack(score := greatest(0.0, least(1.0, CAST(-p.k AS DOUBLE))), label := ({_list(_VEC_LABELS)})[p.i])) AS h FROM h)
SELECT id, array_to_string(list_transform(h, lambda x: x.label), ',') AS hints, CASE WHEN h[1].score >= 0.2 THEN {_LABEL('h[1].label')} END AS boost FROM n""")
def classifier_hints(embeddings):
    hints = embeddings.select(F.col("vec_id").alias("id"), advice.top_hints(F.col("embedding"), _VEC_LABELS).alias("h"))
    return hints.select("id", F.array_join(F.transform("h", lambda x: x["label"]), ",").alias("hints"), advice.category_boost(F.col("h")).getField("category").alias("boost"))


@query("fabrics", sql="SELECT id, CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN 'NON_TEXTILE_DOMINANT' WHEN id % 100 / 100.0 < 0.22 THEN 'LOW_TOP1_CONFIDENCE' WHEN id % 37 / 37.0 > 0.88 THEN 'HIGH_ENTROPY' WHEN id % 11 / 100.0 < 0.06 THEN 'SMALL_TOP1_TOP2_MARGIN' ELSE 'CONFIDENT_TEXTILE' END AS reason FROM fabrics")
def verdict_reasons(fabrics):
    i = F.col("id")
    return fabrics.select("id", advice.verdict_reason(i % 100 / 100.0, i % 37 / 37.0, i % 11 / 100.0, F.when(i % 3 != 0, "KENTE"), F.when((i % 3 != 0) | (i % 5 != 0), "WAX")).alias("reason"))


_VERDICTS = "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE category END AS ownCategory, id % 100 / 100.0::DOUBLE AS ownScore, CASE WHEN id % 3 = 0 THEN NULL ELSE 'LACE' END AS gateCategory, id % 77 / 77.0::DOUBLE AS gateConfidence, CASE id % 5 WHEN 0 THEN 'NON_TEXTILE_DOMINANT' WHEN 1 THEN 'CONFIDENT_TEXTILE' WHEN 2 THEN NULL ELSE 'HIGH_ENTROPY' END AS gateReason, CASE WHEN id % 7 = 0 THEN NULL ELSE CASE id % 3 WHEN 0 THEN 'FUGU' WHEN 1 THEN 'SILK' ELSE 'KENTE' END END AS signCategory, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 91 / 91.0::DOUBLE END AS signConfidence, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 60 / 100.0::DOUBLE END AS anisotropy FROM fabrics"


def _verdicts(fabrics: DataFrame) -> DataFrame:
    i = F.col("id")
    known = i % 7 != 0
    return fabrics.select(
        "id", F.when(i % 4 != 0, F.col("category")).alias("ownCategory"), (i % 100 / 100.0).alias("ownScore"), F.when(i % 3 != 0, "LACE").alias("gateCategory"), (i % 77 / 77.0).alias("gateConfidence"),
        F.when(i % 5 == 0, "NON_TEXTILE_DOMINANT").when(i % 5 == 1, "CONFIDENT_TEXTILE").when(i % 5 > 2, "HIGH_ENTROPY").alias("gateReason"),
        F.when(known, F.when(i % 3 == 0, "FUGU").when(i % 3 == 1, "SILK").otherwise("KENTE")).alias("signCategory"), F.when(known, i % 91 / 91.0).alias("signConfidence"), F.when(known, i % 60 / 100.0).alias("anisotropy"),
    )


@query("fabrics", sql=f"""
, v AS ({_VERDICTS}), w AS (SELECT *, coalesce(gateReason = 'NON_TEXTILE_DOMINANT', false) AND coalesce(anisotropy < 0.22, true) AS none_, coalesce(gateReason = 'CONFIDENT_TEXTILE', false) AS sure, ownCategory IS NOT NULL AND ownScore >= 0.38::DOUBLE AS own FROM v)
SELECT id, CASE WHEN none_ THEN coalesce(signCategory, 'UNKNOWN') WHEN sure AND gateCategory IS NOT NULL THEN gateCategory WHEN own THEN CASE WHEN anisotropy > 0.45 AND signCategory IN ('KENTE', 'FUGU', 'GONJA') THEN signCategory ELSE ownCategory END ELSE signCategory END AS category,
  round(CASE WHEN none_ THEN least(coalesce(signConfidence, 0.35::DOUBLE), 0.42::DOUBLE) WHEN own THEN greatest(0.35::DOUBLE, least(0.8::DOUBLE, ownScore * 0.5::DOUBLE + coalesce(signConfidence, 0.55::DOUBLE) * 0.5::DOUBLE)) WHEN sure THEN greatest(0.35::DOUBLE, least(0.8::DOUBLE, gateConfidence * 0.55::DOUBLE + coalesce(signConfidence, 0.55::DOUBLE) * 0.45::DOUBLE)) ELSE greatest(0.3::DOUBLE, least(0.72::DOUBLE, coalesce(signConfidence, 0.35::DOUBLE))) END, 6) AS confidence FROM w""")
def fused_verdicts(fabrics):
    return advice.fused(_verdicts(fabrics)).select("id", "category", _R("confidence").alias("confidence"))


@query("fabrics", sql="SELECT id, CASE WHEN id % 3 = 0 THEN 'WAX' WHEN id % 2 = 0 THEN 'SILK' ELSE category END AS category, round(CASE WHEN id % 3 = 0 THEN 0.99::DOUBLE ELSE greatest(0.3::DOUBLE, least(0.8::DOUBLE, id % 100 / 100.0::DOUBLE)) END, 6) AS confidence, CASE WHEN id % 3 = 0 AND id % 6 = 0 THEN 'DOTTED' ELSE pattern END AS pattern, texture, CASE WHEN id % 3 = 0 THEN 'CLOUD' ELSE 'LOCAL' END AS engine FROM fabrics")
def final_verdicts(fabrics):
    i = F.col("id")
    local = fabrics.select("id", "category", F.lit(0.5).alias("confidence"), "pattern", "texture", F.when(i % 2 == 0, "SILK").alias("mlCategory"), (i % 100 / 100.0).alias("mlConfidence"))
    remote = fabrics.where("id % 3 = 0").select("id", F.lit("WAX").alias("category"), F.lit(0.99).alias("confidence"), F.when(i % 6 == 0, "DOTTED").alias("pattern"), F.lit(None).cast("string").alias("texture"))
    return advice.final_verdict(local, remote).withColumn("confidence", _R("confidence"))


_PALETTE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{','.join(map(str, v))}'" for k, v in advice.PALETTES.items()) + " END"


@query("fabrics", sql=f"SELECT id, {_PALETTE} AS palette, {_case('category', advice.PATTERN_OF.items(), chr(39) + 'GEOMETRIC' + chr(39))} AS pattern FROM fabrics")
def category_palettes(fabrics):
    c = F.col("category")
    return fabrics.select("id", F.array_join(advice.palette_of(c).cast("array<string>"), ",").alias("palette"), advice.pattern_of(c).alias("pattern"))


@query("styles", sql="SELECT id, CASE " + " ".join(f"WHEN silhouette IN {_in_list(n)} THEN '{','.join(c)}'" for n, c in advice.CONTROLS) + " END AS controls FROM styles")
def garment_controls(styles):
    return styles.select("id", F.array_join(advice.controls_of(F.col("silhouette")), ",").alias("controls"))


_PATHS = ["assets/Kente.webp", "a/b/lace.jpg", "x/unknown_thing.png", "plain", "dir.d/WAX.tar.gz"]


@query("fabrics", sql=f"SELECT id, stem, coalesce(p.category, CASE WHEN upper(stem) IN {_in_list(S.CATEGORIES)} THEN upper(stem) ELSE 'KENTE' END) AS category, coalesce(p.confidence, 0.96::DOUBLE) AS confidence FROM (SELECT id, ['kente', 'lace', 'unknown_thing', 'plain', 'wax.tar'][CAST(id % 5 AS INTEGER) + 1] AS stem FROM fabrics) f LEFT JOIN (VALUES ('lace', 'LACE', 0.99::DOUBLE), ('plain', 'LINEN', 0.5::DOUBLE)) p(s, category, confidence) ON stem = s")
def swatch_profiles(fabrics):
    profiles = fabrics.sparkSession.createDataFrame([("lace", "LACE", 0.99), ("plain", "LINEN", 0.5)], "stem string, category string, confidence double")
    paths = fabrics.select("id", _pick(_PATHS, F.col("id") % 5).alias("path"))
    found = advice.swatch_profiles(paths.select("path").distinct(), profiles, S.CATEGORIES)
    return paths.join(found, "path").select("id", "stem", "category", "confidence")


@query("fabrics", sql="SELECT id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 10), ' ') AS hashtags FROM (SELECT id, ['#fashion', '#style', '#ootd', '#outfit', '#dress', '#' || lower(category), '#' || lower(pattern), '#shoes', '#style'] || list_transform(list_slice(colors, 1, 2), lambda c: '#' || lower(c.colorName) || 'tone') AS l FROM fabrics)")
def picture_hashtags(fabrics):
    attr = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("value"))
    dress = F.struct(F.lit("DRESS").alias("type"), F.array(attr("COLOR", F.col("category")), attr("SIZE", F.lit("xl")), attr("PATTERN", F.col("pattern"))).alias("attributes"))
    shoes = F.struct(F.lit("SHOES").alias("type"), F.array(attr("STYLE", F.lit("Style"))).alias("attributes"))
    rows = fabrics.select("id", F.array(dress, shoes).alias("items"), F.transform("colors", lambda c: F.concat(c["colorName"], F.lit(" Tone"))).alias("colors"))
    return advice.hashtags(rows).select("id", F.array_join("hashtags", " ").alias("hashtags"))


@query("wardrobe", sql="SELECT w.owner AS id, round(avg(w.id % 100 / 100.0::DOUBLE), 6) AS confidence, s.style FROM wardrobe w JOIN (SELECT owner, style FROM (SELECT owner, style, row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, min(id)) AS r FROM wardrobe GROUP BY owner, style) WHERE r = 1) s ON s.owner = w.owner GROUP BY w.owner, s.style")
def picture_summaries(items):
    rows = items.select(F.col("owner").alias("id"), F.col("id").alias("ordinal"), (F.col("id") % 100 / 100.0).alias("confidence"), F.array("style").alias("styles"))
    return advice.picture_summary(rows).withColumn("confidence", _R("confidence"))


@query("wardrobe", sql="SELECT owner, style AS value FROM (SELECT owner, style, row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, min(id)) AS r FROM wardrobe GROUP BY owner, style) WHERE r = 1")
def dominant_style(items):
    return wardrobe.mode_of(items, "owner", "style", "id")


_TIP = "CASE m " + " ".join(" ".join(f"WHEN {m} THEN '{'; '.join(advice.TIPS[k])}'" for m in months) for k, months in (("COOL", (12, 1, 2)), ("HOT", (3, 4, 5)), ("RAINY", (6, 7, 8)), ("WEDDING", (9, 10, 11)))) + " END"


@table_query("orders", sql=f"SELECT o_orderkey AS id, {_TIP} AS tips FROM (SELECT o_orderkey, month(o_orderdate) AS m FROM orders)")
def season_tips(orders):
    return orders.select(F.col("o_orderkey").alias("id"), F.array_join(advice.season_tips(F.month("o_orderdate")), "; ").alias("tips"))


# trends


@query("posts", sql=_TRENDS + "SELECT tag, type, postCount FROM t WHERE contains(lower(tag), 'e') ORDER BY postCount DESC, tag LIMIT 10")
def search_trends(posts):
    return trends.search_trends(trends.tag_trends(posts, _AT), "E").select("tag", "type", "postCount")


@query("posts", "likes", sql=", u AS (SELECT galleryItemId FROM likes WHERE userId = 3) SELECT tag, round(count(*) / greatest((SELECT count(*) FROM u), 1), 6) AS affinity FROM (SELECT unnest(p.tags) AS tag FROM u JOIN posts p ON u.galleryItemId = p.id) GROUP BY tag")
def tag_affinities(posts, likes):
    return trends.affinities(likes, posts, 3).select("tag", _R("affinity").alias("affinity"))


# colours

_RGB = "((c >> 16) & 255) AS r, ((c >> 8) & 255) AS g, (c & 255) AS b"


@query("fabrics", sql="SELECT id, colors[1].argb | 4278190080 AS argb FROM fabrics")
def hsl_round_trip(fabrics):
    """Each colour to hue, saturation and lightness and back."""
    x = color.to_hsl(F.col("colors")[0]["argb"])
    return fabrics.select("id", color.from_hsl(x["h"], x["s"], x["l"]).alias("argb"))


@query("fabrics", sql=f", x AS (SELECT id, {_RGB} FROM (SELECT id, colors[1].argb AS c FROM fabrics)) SELECT id, 4278190080 + CAST(floor(r * 0.55::DOUBLE + 0.5) AS BIGINT) * 65536 + CAST(floor(g * 0.55::DOUBLE + 0.5) AS BIGINT) * 256 + CAST(floor(b * 0.55::DOUBLE + 0.5) AS BIGINT) AS dark, CASE WHEN (greatest(r, g, b) / 255.0::DOUBLE + least(r, g, b) / 255.0::DOUBLE) / 2 < 0.3 THEN 0.45 WHEN (greatest(r, g, b) / 255.0::DOUBLE + least(r, g, b) / 255.0::DOUBLE) / 2 > 0.75 THEN 0.6 ELSE round((greatest(r, g, b) / 255.0::DOUBLE + least(r, g, b) / 255.0::DOUBLE) / 2, 6) END AS light FROM x")
def darkened(fabrics):
    c = F.col("colors")[0]["argb"]
    return fabrics.select("id", color.darken(c).alias("dark"), _R(color.balanced(color.to_hsl(c)["l"])).alias("light"))


@query("fabrics", sql=f", x AS (SELECT id, {_RGB} FROM (SELECT id, colors[1].argb AS c FROM fabrics)), y AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM x) SELECT id, y > 40 AND (b - y) * 0.564::DOUBLE + 128 BETWEEN 77 AND 127 AND (r - y) * 0.713::DOUBLE + 128 BETWEEN 133 AND 173 AS skin FROM y")
def skin_pixels(fabrics):
    return fabrics.select("id", color.is_skin(F.col("colors")[0]["argb"]).alias("skin"))


_STEP = lambda e: f"greatest(0, least(255, CAST(trunc({e}) AS INTEGER)))"
_BRIGHT = lambda c: _STEP(f"{c} + 0.2::DOUBLE * 255")
_CONTRAST = lambda c: _STEP(f"round((({c} / 255.0::DOUBLE - 0.5::DOUBLE) * 1.3::DOUBLE + 0.5::DOUBLE) * 255, 6)")
_SATURATED = lambda c: _STEP(f"round(gray + 0.6::DOUBLE * ({c} - gray), 6)")


@query("fabrics", sql=f"""
, x AS (SELECT id, {_RGB} FROM (SELECT id, colors[1].argb AS c FROM fabrics)), b1 AS (SELECT id, {_BRIGHT('r')} AS r, {_BRIGHT('g')} AS g, {_BRIGHT('b')} AS b FROM x), c1 AS (SELECT id, {_CONTRAST('r')} AS r, {_CONTRAST('g')} AS g, {_CONTRAST('b')} AS b FROM b1),
g1 AS (SELECT *, CAST(trunc(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6)) AS INTEGER) AS gray FROM c1)
SELECT id, 4278190080 + CAST({_SATURATED('r')} AS BIGINT) * 65536 + CAST({_SATURATED('g')} AS BIGINT) * 256 + CAST({_SATURATED('b')} AS BIGINT) AS argb FROM g1""")
def filtered_pixels(fabrics):
    return fabrics.select("id", color.filtered(F.col("colors")[0]["argb"], 20, 30, -40).alias("argb"))


_BUCKET_NAMES = ["RED", "ORANGE", "YELLOW", "GOLD", "GREEN", "TEAL", "TEAL", "BLUE", "INDIGO", "PURPLE", "PINK", "PINK", "BLACK", "CREAM", "GREY"]


@query("fabrics", sql=f"""
, x AS (SELECT id, {_RGB} FROM (SELECT id, colors[1].argb AS c FROM fabrics)) SELECT id, ({_list(_BUCKET_NAMES)})[CAST(id % 15 AS INTEGER) + 1] AS name, r = greatest(r, g, b) AND b = least(r, g, b) AND greatest(r, g, b) - least(r, g, b) >= 40 AND greatest(r, g, b) <= 210 AS earth FROM x""")
def bucket_names(fabrics):
    return fabrics.select("id", raster.bucket_name((F.col("id") % 15).cast("int")).alias("name"), raster.earth_tone(F.col("colors")[0]["argb"]).alias("earth"))


@query("fabrics", sql=f"SELECT id, CASE {' '.join(f'WHEN category IN {_in_list(n)} THEN {chr(39)}{chr(44).join(o)}{chr(39)}' for n, o in raster.USES)} ELSE 'EVERYDAY' END AS uses FROM fabrics")
def category_uses(fabrics):
    return fabrics.select("id", F.array_join(raster.uses_of(F.col("category")), ",").alias("uses"))


@query("fabrics", sql="""
, x AS (SELECT id, pattern, saturation AS contrast, motifScale, 1 + id % 6 AS n, id % 10 / 10.0 AS strips FROM fabrics)
SELECT id, array_to_string(list_filter([CASE WHEN contrast > 0.45 THEN 'HIGH_CONTRAST' ELSE 'LOW_CONTRAST' END, CASE WHEN motifScale > 0.6 THEN 'LARGE_SCALE' WHEN motifScale < 0.35 THEN 'SMALL_REPEAT' END, CASE WHEN n >= 4 THEN 'MULTICOLOUR' WHEN n <= 2 THEN 'TWO_TONE' END, CASE WHEN pattern IN ('STRIPED', 'CHECKED', 'GRADIENT') THEN 'DIRECTIONAL' ELSE 'ALL_OVER' END, CASE WHEN strips > 0.5 THEN 'WOVEN_STRIPS' END], lambda t: t IS NOT NULL), ',') AS traits FROM x""")
def print_traits(fabrics):
    i = F.col("id")
    return fabrics.select("id", F.array_join(raster.print_traits(F.col("pattern"), F.col("saturation"), F.col("motifScale"), 1 + i % 6, i % 10 / 10.0), ",").alias("traits"))


@query("fabrics", sql="""
, x AS (SELECT id, id % 40 AS std, id % 7 / 2.0 AS sep, id % 23 / 100.0 AS edge, 1 + id % 5 AS n, id % 97 / 97.0 AS contrast, id % 89 / 89.0 AS lum, id % 50 / 100.0 AS dark, id % 11 AS pr, id % 13 AS pc, CASE WHEN id % 9 = 0 THEN 6 + id % 5 ELSE 0 END AS hp, CASE WHEN id % 6 = 0 THEN 6 + id % 4 ELSE 0 END AS vp, id % 61 / 61.0 AS spread FROM fabrics),
s AS (SELECT *, greatest(0.05, least(1.0, CASE WHEN hp > 0 AND vp > 0 THEN least(hp, vp) * 2 / 64.0 WHEN hp > 0 THEN hp * 2 / 64.0 WHEN vp > 0 THEN vp * 2 / 64.0 WHEN pr > 0 THEN pr / 64.0 WHEN pc > 0 THEN pc / 64.0 ELSE 0.5 END)) AS scale FROM x)
SELECT id, CASE WHEN std < 9 THEN 'SOLID' WHEN hp > 0 AND vp > 0 AND abs(hp - vp) <= 0.35 * greatest(hp, vp) THEN 'CHECKED' WHEN hp > 0 OR vp > 0 OR sep > 2.6 THEN 'STRIPED' WHEN edge < 0.02 AND std > 14 THEN 'GRADIENT' WHEN pr > 0 AND pc > 0 AND scale < 0.3 THEN 'DOTTED'
  WHEN contrast > 0.45 AND n <= 3 AND dark BETWEEN 0.08 AND 0.45 AND lum > 0.4 THEN 'SYMBOLIC' WHEN n >= 3 AND edge > 0.08 THEN 'GEOMETRIC' WHEN n >= 4 AND spread > 0.4 THEN 'FLORAL' WHEN edge > 0.04 THEN 'ORGANIC' ELSE 'ABSTRACT' END AS pattern FROM s""")
def pattern_rules(fabrics):
    i = F.col("id")
    facts = {"lum_std": (i % 40).cast("double"), "separation": i % 7 / 2.0, "edges": i % 23 / 100.0, "colors": 1 + i % 5, "contrast": i % 97 / 97.0, "brightness": i % 89 / 89.0, "dark": i % 50 / 100.0, "row_period": i % 11, "column_period": i % 13, "h_period": F.when(i % 9 == 0, 6 + i % 5).otherwise(0), "v_period": F.when(i % 6 == 0, 6 + i % 4).otherwise(0), "hue_spread": i % 61 / 61.0, "side": F.lit(64)}
    return fabrics.select("id", *[c.alias(k) for k, c in facts.items()]).select("id", raster.pattern_rule().getField("pattern").alias("pattern"))


@query("fabrics", sql="""
, x AS (SELECT id, id % 19 / 2.0 AS noise, id % 31 AS glcm, id % 29 / 100.0 AS edges, id % 97 / 97.0 AS brightness, saturation FROM fabrics)
SELECT id, CASE WHEN noise > 7 THEN 'SLUB' WHEN glcm > 14 OR noise > 4 THEN 'WOVEN' WHEN edges > 0.12 THEN 'EMBROIDERED' WHEN brightness < 0.25 AND saturation > 0.35 THEN 'PILE' WHEN brightness > 0.75 AND saturation < 0.2 THEN 'SHEER' ELSE 'SMOOTH' END AS texture FROM x""")
def texture_rules(fabrics):
    i = F.col("id")
    return fabrics.select("id", raster.texture_rule(i % 19 / 2.0, (i % 31).cast("double"), i % 29 / 100.0, i % 97 / 97.0, F.col("saturation")).alias("texture"))


@query("fabrics", sql="""
, x AS (SELECT id, pattern, texture, 1 + id % 6 AS n, saturation AS sat, id % 97 / 97.0 AS contrast, id % 89 / 89.0 AS bright, id % 4 = 0 AS earth, id % 3 = 0 AS indigo, id % 10 / 10.0 AS strips, id % 5 AS bands FROM fabrics)
SELECT id, CASE WHEN pattern = 'STRIPED' AND n BETWEEN 2 AND 3 AND sat < 0.45 THEN CASE WHEN earth AND contrast > 0.45 THEN 'GONJA' ELSE 'FUGU' END WHEN pattern = 'STRIPED' AND n >= 4 AND sat > 0.38 THEN 'KENTE' WHEN pattern = 'STRIPED' AND n >= 3 THEN CASE WHEN strips > 0.5 AND bands >= 3 THEN 'KENTE' ELSE 'KENTE_PRINT' END
  WHEN pattern = 'SYMBOLIC' THEN 'ADINKRA' WHEN pattern = 'GRADIENT' OR (pattern = 'ORGANIC' AND contrast < 0.35) THEN CASE WHEN sat > 0.4 THEN 'TIEDYE' ELSE 'BATIK' END WHEN pattern IN ('FLORAL', 'ORGANIC', 'GEOMETRIC') AND sat > 0.5 THEN CASE WHEN n >= 5 THEN 'ANKARA' ELSE 'WAX' END
  WHEN indigo AND texture IN ('SLUB', 'WOVEN') AND sat < 0.5 THEN 'DENIM' WHEN pattern = 'SOLID' THEN CASE WHEN sat < 0.18 THEN 'COTTON_PLAIN' WHEN texture = 'SLUB' THEN 'LINEN' WHEN bright < 0.3 AND sat > 0.35 THEN 'VELVET' WHEN sat > 0.4 THEN 'SILK' ELSE 'COTTON_PLAIN' END ELSE 'UNKNOWN' END AS category FROM x""")
def category_rules(fabrics):
    i = F.col("id")
    rule = raster.category_rule(F.col("pattern"), F.col("texture"), 1 + i % 6, F.col("saturation"), i % 97 / 97.0, i % 89 / 89.0, i % 4 == 0, i % 3 == 0, i % 10 / 10.0, i % 5)
    return fabrics.select("id", rule.getField("category").alias("category"))


_TILES = "SELECT o_orderkey AS id, o_orderkey % 700 AS w, o_custkey % 500 AS h FROM orders"


@table_query("orders", sql=f"WITH t AS ({_TILES}) SELECT id, count(x.x) AS tiles, coalesce(sum(x.x * 1000 + y.y), 0) AS corners FROM t LEFT JOIN (SELECT unnest(range(0, 700, 96)) AS x) x ON x.x + 96 <= w LEFT JOIN (SELECT unnest(range(0, 500, 96)) AS y) y ON y.y + 96 <= h AND x.x IS NOT NULL WHERE w >= 96 AND h >= 96 GROUP BY id")
def picture_tiles(orders):
    sizes = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 700).cast("int").alias("w"), (F.col("o_custkey") % 500).cast("int").alias("h")).where("w >= 96 and h >= 96")
    one = sizes.select("id", F.explode(raster.tiles(F.col("w"), F.col("h"), 96)).alias("t"))
    return one.groupBy("id").agg(F.count("*").alias("tiles"), F.sum(F.col("t.x").cast("long") * 1000 + F.col("t.y")).alias("corners"))


@query("fabrics", sql="SELECT id, placement, CASE placement WHEN 'FULL' THEN true WHEN 'TOP_ONLY' THEN y < 0.5 WHEN 'SKIRT_ONLY' THEN y >= 0.5 WHEN 'PANELS' THEN shape % 2 = 0 ELSE false END AS fabric FROM (SELECT id, CASE WHEN id % 7 > 0 AND wanted = 'FULL' THEN CASE id % 7 % 3 WHEN 1 THEN 'PANELS' WHEN 2 THEN 'ACCENTS' ELSE 'TOP_ONLY' END ELSE wanted END AS placement, id % 4 AS shape, id % 10 / 10.0 AS y FROM (SELECT id, ['FULL', 'TOP_ONLY', 'SKIRT_ONLY', 'PANELS', 'ACCENTS'][CAST(id % 5 AS INTEGER) + 1] AS wanted FROM fabrics))")
def fabric_placement(fabrics):
    i = F.col("id")
    placement = raster.placement_of(_pick(["FULL", "TOP_ONLY", "SKIRT_ONLY", "PANELS", "ACCENTS"], i % 5), i % 7)
    return fabrics.select("id", placement.alias("placement"), raster.has_fabric(placement, i % 4, i % 10 / 10.0).alias("fabric"))


# texts


@table_query("documents", sql=r"SELECT doc_id, left(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), 80) AS name FROM documents")
def file_names(documents):
    return documents.select("doc_id", text.file_name(F.col("text"), 80).alias("name"))


@table_query("documents", sql="SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', chr(92) || ''''), '\"', chr(92) || '\"') AS escaped FROM documents")
def xml_escaped(documents):
    return documents.select("doc_id", text.xml_escape(F.col("text")).alias("escaped"))


@query("posts", sql=f"SELECT id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS ago, CASE WHEN n >= 1000000 THEN (n // 1000000) || 'M' WHEN n >= 1000 THEN (n // 1000) || 'K' ELSE CAST(n AS VARCHAR) END AS short FROM (SELECT id, ({BASE + 4_000_000_000} - createdAt) // 1000 AS s, id * 7919 AS n FROM posts)")
def times_and_numbers(posts):
    return posts.select("id", text.time_ago(F.col("createdAt"), F.lit(BASE + 4_000_000_000)).alias("ago"), text.short_number(F.col("id") * 7919).alias("short"))


@query("posts", sql="SELECT id, list_filter(list_transform(string_split(c, ','), lambda x: trim(x)), lambda x: x <> '')::VARCHAR AS trimmed, len(list_filter(string_split(c, ','), lambda x: trim(x) <> '')) AS parts, CASE WHEN trim(c) = '' THEN 0 ELSE len(string_split(c, ',')) END AS every FROM (SELECT id, CASE id % 4 WHEN 0 THEN ' a , ,b' WHEN 1 THEN ' ' WHEN 2 THEN tagsCsv ELSE 'x,,y ' END AS c FROM posts)")
def csv_lists(posts):
    c = F.when(F.col("id") % 4 == 0, " a , ,b").when(F.col("id") % 4 == 1, " ").when(F.col("id") % 4 == 2, F.col("tagsCsv")).otherwise("x,,y ")
    rows = posts.select("id", c.alias("c"))
    return rows.select("id", F.concat(F.lit("["), F.array_join(codec.csv_trimmed(F.col("c")), ", "), F.lit("]")).alias("trimmed"), F.size(codec.csv_parts(F.col("c"))).cast("long").alias("parts"), F.size(codec.csv_all(F.col("c"))).cast("long").alias("every"))


@query("fabrics", sql=f"SELECT id, CASE WHEN name IN {_in_list(S.CATEGORIES)} THEN name ELSE 'UNKNOWN' END AS category FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'PAPER' ELSE category END AS name FROM fabrics)")
def enum_defaults(fabrics):
    return fabrics.select("id", codec.enum_or(F.when(F.col("id") % 3 == 0, "PAPER").otherwise(F.col("category")), S.CATEGORIES, "UNKNOWN").alias("category"))


@query("fabrics", sql=f"SELECT id, array_to_string(list_transform(colors, lambda c: c.argb || '|' || (list_position({_list(S.COLORS)}, c.colorName) - 1) || '|0.250'), ';') AS stored FROM fabrics")
def stored_colors(fabrics):
    """Colours as stored text, read and written again."""
    rows = fabrics.select("id", codec.format_colors(F.transform("colors", lambda c: F.struct(c["argb"].alias("argb"), c["colorName"].alias("colorName"), F.lit(0.25).alias("fraction")))).alias("c"))
    return rows.select("id", codec.format_colors(codec.parse_colors(F.col("c"))).alias("stored"))


@table_query("documents", sql=r"SELECT doc_id, CASE WHEN regexp_matches(t, '@[0-9A-Za-z_]*$') THEN regexp_extract(t, '@([0-9A-Za-z_]*)$', 1) END AS typed, regexp_replace(t, '@[0-9A-Za-z_]*$', '') || '@ama ' || substr(w, 21) AS completed FROM (SELECT doc_id, left(lang || ' @' || source || ' ' || lang, 20) AS t, lang || ' @' || source || ' ' || lang AS w FROM documents)")
def typed_mentions(documents):
    whole = F.concat_ws("", "lang", F.lit(" @"), "source", F.lit(" "), "lang")
    rows = documents.select("doc_id", whole.alias("w"))
    return rows.select("doc_id", text.mention_at(F.col("w"), F.lit(20)).alias("typed"), text.insert_mention(F.col("w"), F.lit(20), F.lit("ama")).alias("completed"))


@table_query("documents", sql="SELECT doc_id, coalesce(array_to_string(regexp_extract_all(lang || ' #ootd ' || source || '#' || lang, '#([0-9A-Za-z_]+)', 1), ','), '') AS tags, array_to_string(list_sort(regexp_extract_all('%s ' || lang || '%d%2$s %%', '(%(?:[0-9]+[$])?[sdf%])', 1)), ' ') AS specifiers FROM documents")
def hashtags_and_specifiers(documents):
    return documents.select(
        "doc_id", F.array_join(text.hashtags(F.concat("lang", F.lit(" #ootd "), "source", F.lit("#"), "lang")), ",").alias("tags"),
        F.array_join(text.format_specifiers(F.concat(F.lit("%s "), "lang", F.lit("%d%2$s %%"))), " ").alias("specifiers"),
    )


@query("styles", sql="SELECT id, upper(replace(id, '_', ' ')[1]) || replace(id, '_', ' ')[2:] AS title FROM styles")
def titles_of_ids(styles):
    return styles.select("id", text.title_of(F.col("id")).alias("title"))


@table_query("events", sql="SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_numbers(events):
    return events.select(F.col("event_id").alias("id"), F.from_json("props", "k bigint").getField("k").alias("k"))


_RANGE_AT = 1_706_000_000_000


@query("history", sql=" UNION ALL ".join(f"SELECT '{u}' AS unit, count(*) AS n FROM history WHERE timestamp >= epoch_ms(date_trunc('{u}', make_timestamp({_RANGE_AT} * 1000)))" for u in ("day", "week", "month", "year")))
def date_ranges(history):
    units = ("day", "week", "month", "year")
    counted = history.agg(*[F.count_if(F.col("timestamp") >= text.start_of(u, _RANGE_AT)).alias(u) for u in units])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("n")) for u in units])).alias("x")).select("x.unit", "x.n")


@table_query("pages", sql="SELECT page_id, CASE WHEN starts_with(name, 'tmp') THEN NULL WHEN starts_with(name, 'en') THEN 'LINEN' WHEN starts_with(name, 'fr') THEN 'LACE' ELSE 'KENTE' END AS label FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'tmp' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'de' END || '_' || page_id AS name FROM pages)")
def file_labels(pages):
    path = F.concat(F.lit("a/B/"), F.upper(_pick(["tmp", "en", "fr", "de"], F.col("page_id") % 4)), F.lit("_"), F.col("page_id").cast("string"))
    return pages.select("page_id", curate.file_label(path, ["TMP"], {"EN": "LINEN", "fr": "LACE"}, "KENTE").alias("label"))


# curation


@table_query("documents", "labels", sql="SELECT d.doc_id, d.source, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def credits_joined(documents, labels):
    credits = labels.select("doc_id", F.col("quality").cast("string").alias("quality"))
    return curate.with_credits(documents.select("doc_id", "source"), credits, ["doc_id"], {"quality": "none"})


@table_query("documents", sql="SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 7")
def capped_classes(documents):
    return curate.capped(documents.select("doc_id", "source"), ["source"], "doc_id", 7)


@table_query("documents", sql="SELECT doc_id, source, doc_id = max(doc_id) OVER (PARTITION BY source) AS held_out FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def held_out_last(documents):
    return neardup.hold_out_last(documents, "source", "doc_id", "text").select("doc_id", "source", "held_out")


@table_query("documents", sql="SELECT doc_id, lang, CASE WHEN r = 1 THEN 'pic.jpg' ELSE 'pic_' || r || '.jpg' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)")
def unique_names(documents):
    return curate.unique_names(documents.select("doc_id", "lang", F.lit("pic.jpg").alias("name")), "lang", "name", "doc_id")


@table_query("documents", "labels", sql="SELECT d.source AS label, count(*) AS found, count(*) FILTER (WHERE quality = 1) AS kept, count(*) FILTER (WHERE quality = 0) AS duplicates, count(DISTINCT CASE WHEN quality = 1 THEN d.doc_id % 20 END) AS groups, CASE WHEN count(*) FILTER (WHERE quality = 1) >= 1000 THEN 'ready' WHEN count(*) FILTER (WHERE quality = 1) >= 300 THEN 'usable' ELSE 'too few' END AS readiness FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def class_table(documents, labels):
    rows = documents.join(labels, "doc_id").select(F.col("source").alias("label"), F.when(F.col("quality") == 1, "kept").otherwise("duplicate").alias("status"), (F.col("doc_id") % 20).alias("grp"))
    return curate.class_table(rows)


@table_query("documents", "labels", sql="""
WITH t AS (SELECT d.lang AS label, count(*) FILTER (WHERE quality = 1) AS kept, count(DISTINCT CASE WHEN quality = 1 THEN d.doc_id % 5 END) AS g FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang UNION ALL SELECT 'xx', 0, 0)
SELECT label, 'empty' AS warning FROM t WHERE kept = 0 UNION ALL SELECT label, 'few groups' FROM t WHERE g BETWEEN 1 AND 2 UNION ALL SELECT label, 'little diversity' FROM t WHERE g > 0 AND kept > 10 * g AND g < 30""")
def dataset_warnings(documents, labels):
    rows = documents.join(labels, "doc_id").select(F.col("lang").alias("label"), F.when(F.col("quality") == 1, "kept").otherwise("duplicate").alias("status"), (F.col("doc_id") % 5).alias("grp"))
    return curate.warnings(curate.class_table(rows), ["en", "de", "es", "fr", "xx"])


@table_query("labels", sql="SELECT quality AS label, count(*) AS n, round(avg(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END), 6) AS accuracy FROM labels GROUP BY quality")
def class_accuracy(labels):
    return wardrobe.class_accuracy(labels.withColumn("guess", 1 - F.col("toxic")), "quality", "guess").withColumn("accuracy", _R("accuracy"))


@table_query("conversations", sql="""
WITH RECURSIVE l AS (SELECT conv_id, turn, text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), r(conv_id, k, chunk, size) AS (
  SELECT conv_id, k, 0, length(line) FROM l WHERE k = 1
  UNION ALL SELECT l.conv_id, l.k, CASE WHEN r.size + 1 + length(line) <= 1400 THEN chunk ELSE chunk + 1 END, CASE WHEN r.size + 1 + length(line) <= 1400 THEN r.size + 1 + length(line) ELSE length(line) END FROM r JOIN l ON l.conv_id = r.conv_id AND l.k = r.k + 1)
SELECT r.conv_id, CAST(chunk AS INTEGER) AS chunk, string_agg(line, chr(10) ORDER BY r.k) AS text FROM r JOIN l ON l.conv_id = r.conv_id AND l.k = r.k GROUP BY r.conv_id, chunk""")
def log_chunks(conversations):
    return curate.chunks(conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text", 1400)


@table_query("documents", sql="SELECT doc_id, replace(replace(text, 'the', 'THE'), 'THEr', 'x') AS text, (length(text) - length(replace(text, 'the', ''))) // 3 AS first, (length(replace(text, 'the', 'THE')) - length(replace(replace(text, 'the', 'THE'), 'THEr', ''))) // 4 AS second FROM documents")
def rename_rules(documents):
    out = curate.renamed(documents.select("doc_id", "text"), "text", [("the", "THE"), ("THEr", "x")])
    return out.select("doc_id", "text", F.col("counts")[0].alias("first"), F.col("counts")[1].alias("second"))


_HOST, _PATH = "regexp_extract(url, '//([^/?#]*)', 1)", "regexp_extract(url, '//[^/?#]*/([^?#]*)', 1)"


@table_query("pages", sql=f"""
WITH p AS (SELECT page_id, url, {_HOST} AS repo, {_PATH} AS path FROM pages)
SELECT page_id, 'github:' || repo || '@' || CASE WHEN url LIKE 'https:%' THEN regexp_replace(path, '/[^/]*$', '') WHEN url LIKE '%/en/%' THEN regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') ELSE path END AS key FROM p""")
def repo_group_keys(pages):
    by = F.when(F.startswith("url", F.lit("https:")), "parent").when(F.contains("url", F.lit("/en/")), "grandparent").otherwise("file")
    return pages.select("page_id", curate.repo_key(F.expr(_HOST), F.expr(_PATH), by).alias("key"))


@table_query("documents", sql="""
SELECT doc_id, e AS expected, CASE e WHEN 'MIT' THEN contains(low, 'permission is hereby granted') OR contains(low, 'mit license') WHEN 'BSD-3-Clause' THEN contains(low, 'redistribution and use') OR contains(low, 'bsd')
 WHEN 'Apache-2.0' THEN contains(low, 'apache license') WHEN 'Unlicense' THEN contains(low, 'unencumbered') OR contains(low, 'unlicense') ELSE contains(low, 'cc') END AS ok
FROM (SELECT doc_id, lower(text) AS low FROM documents), (SELECT unnest(['MIT', 'BSD-3-Clause', 'Apache-2.0', 'Unlicense', 'CC-BY-4.0']) AS e)""")
def licence_files(documents):
    """For every document and each of five licences, whether the text looks like that licence's."""
    expected = F.explode(F.array(*map(F.lit, ["MIT", "BSD-3-Clause", "Apache-2.0", "Unlicense", "CC-BY-4.0"])))
    rows = documents.select("doc_id", "text", expected.alias("expected"))
    return rows.select("doc_id", "expected", curate.licence_file_ok(F.col("text"), F.col("expected")).alias("ok"))


# live and time-bound


@query("history", sql="SELECT id, userId, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY userId ORDER BY id) AS before FROM history) WHERE before IS DISTINCT FROM kind")
def changes_of_kind(history):
    from weft.streaming import live

    return live.changes(history, "userId", "id", "kind").select("id", "userId", "kind")


@query("fabrics", sql=f"SELECT kind FROM (SELECT count(*) FILTER (WHERE createdAt < {BASE + 10_000_000_000} - 30 * CAST(86400000 AS BIGINT)) >= 3 AS stale, bool_or(isFavorite) AND dayofweek(make_timestamp({BASE + 10_000_000_000} * 1000)) IN (5, 6) AS favorite FROM fabrics) f, LATERAL (SELECT unnest([CASE WHEN stale THEN 'stale' END, CASE WHEN favorite THEN 'favorite' END, 'season_HOT']) AS kind) WHERE kind IS NOT NULL")
def notification_kinds(fabrics):
    from weft.streaming import live

    return live.notifications(fabrics, BASE + 10_000_000_000)


@query("history", sql="SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY timestamp DESC, id DESC) AS r FROM history) WHERE r <= 20")
def newest_of_each_kind(history):
    rows = history.withColumn("at", F.struct("timestamp", "id"))
    return social.keep_newest(rows, "at", 20, ["kind"]).select("kind", "id")


@table_query("events", sql="SELECT user_id, event_type, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_counters(events):
    from weft.streaming import live

    return live.quota_counts(events).select("user_id", "event_type", F.col("window.start").cast("date").cast("string").alias("day"), "n")
