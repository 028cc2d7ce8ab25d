"""One registered query for each read and write of the stored tables, with SQL written from the statement's meaning.

The relations are views over the driver's tables; a write is applied to a whole relation and returns the table after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import tables
from weft.plans.catalogue import QUERIES, SQL
from weft.sources.views import BASE, DUCK, view, with_views

#: Stored table -> view, and the columns of it that stand for the stored ones (the key first).
RELATIONS = {
    "fabrics": ("fabrics", "id name category pattern texture isFavorite createdAt"),
    "dress_styles": ("styles", "id title gender category silhouette structure ordinal"),
    "favorite_styles": ("favorites", "styleId addedAt"),
    "generated_looks": ("looks", "id fabricId dressStyleId engine isFavorite createdAt variationGroup"),
    "history": ("history", "id kind userId target value timestamp"),
    "usage": ("usages", "key count"),
    "collections": ("collections", "id name createdAt"),
    "collection_items": ("collection_items", "id collectionId itemType itemId addedAt"),
    "wardrobe_items": ("closet", "id name category createdAt"),
    "outfits": ("outfits", "id name itemIdsCsv createdAt"),
    "measurements": ("measured", "id heightCm waistCm hipCm updatedAt"),
    "style_feedback": ("feedback", "styleId dismissed updatedAt"),
    "community_users": ("users", "id username displayName followerCount followingCount isFollowing createdAt"),
    "gallery_items": ("posts", "id userId title tagsCsv likeCount commentCount isLiked createdAt fabricId"),
    "comments": ("comments", "id galleryItemId userId text createdAt"),
    "likes": ("likes", "id galleryItemId userId createdAt"),
    "style_challenges": ("challenges", "id title description startDate endDate participantCount isActive"),
    "challenge_entries": ("entry_rows", "id challengeId userId voteCount submissionDate"),
    "recent_searches": ("searches", "query timestamp"),
    "reports": ("reports", "id reporterId contentId contentType reportType status createdAt"),
    "blocked_users": ("blocked", "userId username reason blockedAt"),
    "cached_posts": ("cached", "id userId title likeCount createdAt cachedAt"),
}

#: Read -> its arguments, and the SQL behind "FROM rows" (or the whole of it, where it begins with SELECT).
READS: dict[str, tuple[tuple, str]] = {
    "fabrics.byId": ((9,), "WHERE id = 9"),
    "fabrics.observeAll": ((), ""),
    "fabrics.observeFavorites": ((), "WHERE isFavorite"),
    "fabrics.count": ((), "SELECT count(*) AS count FROM rows"),
    "dress_styles.observeAll": ((), ""),
    "dress_styles.all": ((), ""),
    "dress_styles.byId": (("coords_city",), "WHERE id = 'coords_city'"),
    "dress_styles.count": ((), "SELECT count(*) AS count FROM rows"),
    "favorite_styles.isFavorite": (("kaba_day",), "SELECT count(*) AS count FROM rows WHERE styleId = 'kaba_day'"),
    "favorite_styles.favoriteCount": ((), "SELECT count(*) AS count FROM rows"),
    "generated_looks.observeAll": ((), ""),
    "generated_looks.observeFavorites": ((), "WHERE isFavorite"),
    "generated_looks.byId": ((33,), "WHERE id = 33"),
    "generated_looks.count": ((), "SELECT count(*) AS count FROM rows"),
    "history.observeAll": ((), "ORDER BY timestamp DESC NULLS LAST, id NULLS FIRST LIMIT 200"),
    "usage.byKey": (("view_7",), "WHERE key = 'view_7'"),
    "collections.observeAll": ((), ""),
    "collections.byId": ((4,), "WHERE id = 4"),
    "collection_items.observeItems": ((4,), "WHERE collectionId = 4"),
    "collection_items.itemCount": (("FABRIC", "12"), "SELECT count(*) AS count FROM rows WHERE itemType = 'FABRIC' AND itemId = '12'"),
    "wardrobe_items.observeAll": ((), ""),
    "wardrobe_items.byId": ((77,), "WHERE id = 77"),
    "outfits.observeOutfits": ((), ""),
    "measurements.get": ((), "WHERE id = 1"),
    "style_feedback.observeDismissed": ((), "SELECT styleId FROM rows WHERE dismissed"),
    "style_feedback.byId": (("kaba_day",), "WHERE styleId = 'kaba_day'"),
    "community_users.observeAll": ((), ""),
    "community_users.getAll": ((), ""),
    "community_users.getById": ((15,), "WHERE id = 15"),
    "community_users.getByUsername": (("customer_000000042",), "WHERE username = 'customer_000000042'"),
    "community_users.observeFollowing": ((), "WHERE isFollowing"),
    "gallery_items.observeAll": ((), ""),
    "gallery_items.getAll": ((), ""),
    "gallery_items.getById": ((17,), "WHERE id = 17"),
    "gallery_items.observeByUser": ((42,), "WHERE userId = 42"),
    "gallery_items.observeLiked": ((), "WHERE isLiked"),
    "gallery_items.observeByTag": (("SRC_1",), "WHERE tags ILIKE '%src_1%'"),
    "comments.observeByGalleryItem": ((3,), "WHERE galleryItemId = 3"),
    "comments.countByGalleryItem": ((3,), "SELECT count(*) AS count FROM rows WHERE galleryItemId = 3"),
    "likes.getByGalleryItem": ((5,), "WHERE galleryItemId = 5"),
    "likes.observeByUser": ((5,), "WHERE userId = 5"),
    "likes.countByGalleryItem": ((5,), "SELECT count(*) AS count FROM rows WHERE galleryItemId = 5"),
    "style_challenges.observeAll": ((), ""),
    "style_challenges.getAll": ((), ""),
    "style_challenges.observeActive": ((), "WHERE isActive"),
    "style_challenges.getById": ((8,), "WHERE id = 8"),
    "challenge_entries.observeByChallenge": ((8,), "WHERE challengeId = 8"),
    "challenge_entries.observeByUser": ((8,), "WHERE userId = 8"),
    "recent_searches.observeRecent": ((), "ORDER BY timestamp DESC NULLS LAST, query NULLS FIRST LIMIT 10"),
    "reports.observeAll": ((), ""),
    "reports.getById": ((32,), "WHERE id = 32"),
    "reports.observeByReporter": ((30,), "WHERE reporterId = 30"),
    "reports.observeByReportedUser": ((30,), "WHERE reportedUserId = 30"),
    "reports.getByContent": ((4, "POST"), "WHERE contentId = 4 AND contentType = 'POST'"),
    "reports.countPendingForContent": ((4, "POST"), "SELECT count(*) AS count FROM rows WHERE contentId = 4 AND contentType = 'POST' AND status = 'PENDING'"),
    "blocked_users.observeAll": ((), ""),
    "blocked_users.getById": ((14,), "WHERE userId = 14"),
    "blocked_users.isBlocked": ((14,), "SELECT EXISTS (SELECT 1 FROM rows WHERE userId = 14) AS exists"),
    "cached_posts.observeAll": ((), ""),
    "cached_posts.getById": ((21,), "WHERE id = 21"),
}

#: Columns of a view that the stored table has under another name, and columns made here.
_RENAMED = {"gallery_items": {"tagsCsv": "tags"}}
_MADE = {"reports": ("reportedUserId", "contentId * 3 % 150")}
#: The column that new rows of a table change, and its value: SQL that both engines know.
_CHANGED = {
    "fabrics": ("name", "name || '_2'"), "dress_styles": ("title", "title || '_2'"), "favorite_styles": ("addedAt", "addedAt + 1"), "generated_looks": ("engine", "engine || '_2'"), "history": ("kind", "kind || '_2'"),
    "usage": ("count", "count + 1"), "collections": ("name", "name || '_2'"), "collection_items": ("itemType", "itemType || '_2'"), "wardrobe_items": ("name", "name || '_2'"), "outfits": ("name", "name || '_2'"),
    "measurements": ("waistCm", "waistCm + 1"), "style_feedback": ("dismissed", "NOT dismissed"), "community_users": ("followerCount", "followerCount + 5"), "gallery_items": ("title", "title || '_2'"),
    "comments": ("text", "text || '_2'"), "likes": ("createdAt", "createdAt + 1"), "style_challenges": ("title", "title || '_2'"), "challenge_entries": ("voteCount", "voteCount + 1"), "recent_searches": ("timestamp", "timestamp + 1"),
    "reports": ("status", "'RESOLVED'"), "blocked_users": ("reason", "reason || '_2'"), "cached_posts": ("title", "title || '_2'"),
}
#: Write that sets or deletes -> its arguments, and what holds for the rows that it concerns; for a set also the values by column, as SQL.
CONDITIONS: dict[str, tuple] = {
    "fabrics.rename": (("renamed", 8), "id = 8", {"name": "'renamed'"}),
    "fabrics.setFavorite": ((True, 9), "id = 9", {"isFavorite": "true"}),
    "fabrics.updateDetails": (("soft", 120, "Ama", "WEDDING", 9), "id = 9", {"notes": "'soft'", "amountCm": "120", "intendedWearer": "'Ama'", "intendedOccasion": "'WEDDING'"}),
    "fabrics.delete": ((8,), "id = 8"),
    "favorite_styles.removeFavorite": (("kaba_day",), "styleId = 'kaba_day'"),
    "generated_looks.setFavorite": ((True, 33), "id = 33", {"isFavorite": "true"}),
    "generated_looks.delete": ((33,), "id = 33"),
    "history.delete": ((5,), "id = 5"),
    "history.prune": ((BASE + 5_500_000_000,), f"timestamp < {BASE + 5_500_000_000}"),
    "collections.delete": ((4,), "id = 4"),
    "collection_items.deleteItems": ((4,), "collectionId = 4"),
    "collection_items.removeItem": ((4, "ODD", "3"), "collectionId = 4 AND itemType = 'ODD' AND itemId = '3'"),
    "wardrobe_items.delete": ((77,), "id = 77"),
    "outfits.deleteOutfit": ((77,), "id = 77"),
    "style_feedback.delete": (("kaba_day",), "styleId = 'kaba_day'"),
    "community_users.delete": ((15,), "id = 15"),
    "gallery_items.delete": ((17,), "id = 17"),
    "comments.delete": ((3001,), "id = 3001"),
    "comments.deleteByGalleryItem": ((3,), "galleryItemId = 3"),
    "likes.delete": ((5, 7), "galleryItemId = 5 AND userId = 7"),
    "style_challenges.delete": ((8,), "id = 8"),
    "challenge_entries.delete": ((64002,), "id = 64002"),
    "recent_searches.delete": (("click_9",), "query = 'click_9'"),
    "reports.delete": ((30,), "id = 30"),
    "blocked_users.delete": ((14,), "userId = 14"),
    "cached_posts.delete": ((21,), "id = 21"),
    "cached_posts.deleteOlderThan": ((BASE + 1_000_000_000,), f"cachedAt < {BASE + 1_000_000_000}"),
}

_TEXT_KEYS = {"dress_styles", "favorite_styles", "usage", "style_feedback", "recent_searches"}
_DETAILS = {"notes": ("STRING", "VARCHAR", None), "amountCm": ("INT", "INTEGER", 0), "intendedWearer": ("STRING", "VARCHAR", None), "intendedOccasion": ("STRING", "VARCHAR", None)}


def _columns(table: str) -> list[str]:
    renamed = _RENAMED.get(table, {})
    return [renamed.get(c, c) for c in RELATIONS[table][1].split()]


def relation(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The rows that stand for a stored table."""
    name, columns = RELATIONS[table]
    renamed = _RENAMED.get(table, {})
    rows = view(spark, sf_dir, "entries" if name == "entry_rows" else name)
    if name == "entry_rows":  # entries have no key of their own: the largest vote of an order's line
        rows = rows.groupBy((F.col("orderId") * 1000 + F.col("line")).alias("id")).agg(*[F.max(c).alias(c) for c in ("challengeId", "userId", "voteCount", "submissionDate")])
    rows = rows.select(*[F.col(c).alias(renamed.get(c, c)) for c in columns.split()])
    if table in _MADE:
        rows = rows.withColumn(_MADE[table][0], F.expr(_MADE[table][1]))
    return rows


def _with_rows(table: str, body: str, more: str = "") -> str:
    """DuckDB's SQL of body over rows, the relation of a stored table."""
    name, columns = RELATIONS[table]
    renamed = _RENAMED.get(table, {})
    listed = ", ".join(f"{c} AS {renamed[c]}" if c in renamed else c for c in columns.split())
    if table in _MADE:
        listed += f", {_MADE[table][1]} AS {_MADE[table][0]}"
    source = name
    if name == "entry_rows":
        source, listed = "(SELECT orderId * 1000 + line AS id, max(challengeId) AS challengeId, max(userId) AS userId, max(voteCount) AS voteCount, max(submissionDate) AS submissionDate FROM entries GROUP BY orderId, line) e", listed
        name = "entries"
    return f"WITH {name}_ AS ({DUCK[name]}), rows AS (SELECT {listed} FROM {source.replace(name, name + '_') if source == name else source.replace('FROM entries', 'FROM entries_')}){more} {body}"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    key = "dao_" + name.replace(".", "_")
    QUERIES[key], SQL[key] = run, sql


def _register_read(name: str, arguments: tuple, sql: str) -> None:
    table = name.split(".")[0]
    body = sql if sql.startswith("SELECT") else f"SELECT * FROM rows {sql}"
    _add(name, lambda spark, sf_dir: tables.read(name, relation(spark, sf_dir, table), *arguments), _with_rows(table, body))


def _new_rows(table: str, inserted: bool) -> str:
    """SQL of the rows that a write brings: every tenth with a changed column (not for inserts), and every fiftieth with a new key."""
    key, *rest = _columns(table)
    made = [_MADE[table][0]] if table in _MADE else []
    column, value = _CHANGED[table]
    text = table in _TEXT_KEYS
    pick = (lambda n: f"length({key}) % {n // 10 + 1} = 0") if text else (lambda n: f"{key} % {n} = 0")
    fresh = f"'new_' || {key}" if text else f"CAST({key} + 10000000 AS INT)" if table == "measurements" else f"{key} + 10000000"
    added = f"SELECT {', '.join([f'{fresh} AS {key}', *rest, *made])} FROM rows WHERE {pick(50)}"
    if inserted:
        return added
    changed = ", ".join([key, *[f"{value} AS {c}" if c == column else c for c in rest], *made])
    return f"SELECT {changed} FROM rows WHERE {pick(10)} UNION ALL {added}"


def _register_write(name: str, statement: str) -> None:
    table = name.split(".")[0]
    kind = statement.partition(" ")[0]
    key = _columns(table)[0]
    if kind in ("insert", "upsert", "replace"):
        new = _new_rows(table, kind == "insert")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = relation(spark, sf_dir, table)
            return tables.write(name, rows, spark.sql(new.replace("FROM rows", "FROM {rows}"), rows=rows))

        kept = f"SELECT * FROM rows WHERE {key} NOT IN (SELECT {key} FROM fresh)"
        body = {"insert": "SELECT * FROM rows UNION ALL BY NAME SELECT * FROM fresh", "upsert": f"{kept} UNION ALL BY NAME SELECT * FROM fresh", "replace": f"{kept} UNION ALL BY NAME SELECT * FROM fresh WHERE {key} IN (SELECT {key} FROM rows)"}[kind]
        _add(name, run, _with_rows(table, body, f", fresh AS ({new})"))
        return
    if kind == "clear":
        _add(name, lambda spark, sf_dir: tables.write(name, relation(spark, sf_dir, table)), _with_rows(table, "SELECT * FROM rows WHERE false"))
        return
    arguments, condition, *values = CONDITIONS[name]
    details = [c for c in (values[0] if values else {}) if c in _DETAILS]  # columns that the view lacks, as they are before

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = relation(spark, sf_dir, table)
        return tables.write(name, rows.withColumns({c: F.lit(_DETAILS[c][2]).cast(_DETAILS[c][0]) for c in details}) if details else rows, *arguments)

    if kind == "delete":
        body = f"SELECT * FROM rows WHERE NOT ({condition})"
    else:
        listed = [f"CASE WHEN {condition} THEN {values[0][c]} ELSE {c} END AS {c}" if c in values[0] else c for c in _columns(table)]
        listed += [f"CAST(CASE WHEN {condition} THEN {values[0][c]} ELSE {'NULL' if _DETAILS[c][2] is None else _DETAILS[c][2]} END AS {_DETAILS[c][1]}) AS {c}" for c in details]
        body = f"SELECT {', '.join(listed)} FROM rows"
    _add(name, run, _with_rows(table, body))


for _name, (_arguments, _sql) in READS.items():
    _register_read(_name, _arguments, _sql)
for _name, _statement in tables.WRITES.items():
    _register_write(_name, _statement)

__all__ = ["READS", "RELATIONS", "relation", "with_views"]
