"""The parameterised reads and writes of each stored table, from one short specification.

READS: name -> (table, conditions on columns, order, limit). WRITES: name -> (table, kind, key or condition columns).
A read or write is called by name with its arguments in the order of its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import store


def contains_ci(column: Column, part: str) -> Column:
    """Whether a text contains part, ASCII case ignored; % and _ in part are wildcards."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(column).like("%" + "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in part).replace("\\", "\\\\") + "%")


_OPS: dict[str, Callable[[Column, object], Column]] = {"=": lambda c, v: c == v, "<": lambda c, v: c < v, "~": contains_ci}


def where(table: DataFrame, conditions: str, arguments: tuple) -> Column:
    """'a=? b<? c=1': each condition with its argument or a constant."""
    out, rest = F.lit(True), list(arguments)
    for c in conditions.split():
        op = next(o for o in "=<~" if o in c)
        name, value = c.split(op)
        value = rest.pop(0) if value == "?" else value.strip("'") if value.startswith("'") else int(value)
        if table.schema[name].dataType.typeName() == "boolean" and isinstance(value, int):
            value = bool(value)
        out = out & _OPS[op](F.col(name), value)
    return out


# table.name: conditions | order (- descends) | limit | result (rows, count, exists or a column)
_READS = """
fabrics.byId: id=? ||| rows
fabrics.observeAll: | -createdAt || rows
fabrics.observeFavorites: isFavorite=1 | -createdAt || rows
fabrics.count: ||| count
dress_styles.observeAll: ||| rows
dress_styles.all: ||| rows
dress_styles.byId: id=? ||| rows
dress_styles.count: ||| count
favorite_styles.isFavorite: styleId=? ||| count
favorite_styles.favoriteCount: ||| count
generated_looks.observeAll: | -createdAt || rows
generated_looks.observeFavorites: isFavorite=1 | -createdAt || rows
generated_looks.byId: id=? ||| rows
generated_looks.count: ||| count
history.observeAll: | -timestamp | 200 | rows
usage.byKey: key=? ||| rows
collections.observeAll: | -createdAt || rows
collections.byId: id=? ||| rows
collection_items.observeItems: collectionId=? | -addedAt || rows
collection_items.itemCount: itemType=? itemId=? ||| count
wardrobe_items.observeAll: | -createdAt || rows
wardrobe_items.byId: id=? ||| rows
outfits.observeOutfits: | -createdAt || rows
measurements.get: id=1 ||| rows
style_feedback.observeDismissed: dismissed=1 ||| styleId
style_feedback.byId: styleId=? ||| rows
community_users.observeAll: | username || rows
community_users.getAll: | username || rows
community_users.getById: id=? ||| rows
community_users.getByUsername: username=? ||| rows
community_users.observeFollowing: isFollowing=1 | username || rows
gallery_items.observeAll: | -createdAt || rows
gallery_items.getAll: | -createdAt || rows
gallery_items.getById: id=? ||| rows
gallery_items.observeByUser: userId=? | -createdAt || rows
gallery_items.observeLiked: isLiked=1 | -createdAt || rows
gallery_items.observeByTag: tags~? | -createdAt || rows
comments.observeByGalleryItem: galleryItemId=? | createdAt || rows
comments.countByGalleryItem: galleryItemId=? ||| count
likes.getByGalleryItem: galleryItemId=? ||| rows
likes.observeByUser: userId=? ||| rows
likes.countByGalleryItem: galleryItemId=? ||| count
style_challenges.observeAll: | -startDate || rows
style_challenges.getAll: | -startDate || rows
style_challenges.observeActive: isActive=1 | endDate || rows
style_challenges.getById: id=? ||| rows
challenge_entries.observeByChallenge: challengeId=? | -voteCount || rows
challenge_entries.observeByUser: userId=? | -submissionDate || rows
recent_searches.observeRecent: | -timestamp | 10 | rows
reports.observeAll: | -createdAt || rows
reports.getById: id=? ||| rows
reports.observeByReporter: reporterId=? | -createdAt || rows
reports.observeByReportedUser: reportedUserId=? | -createdAt || rows
reports.getByContent: contentId=? contentType=? | -createdAt || rows
reports.countPendingForContent: contentId=? contentType=? status='PENDING' ||| count
blocked_users.observeAll: | -blockedAt || rows
blocked_users.getById: userId=? ||| rows
blocked_users.isBlocked: userId=? ||| exists
cached_posts.observeAll: | -createdAt || rows
cached_posts.getById: id=? ||| rows
"""

# table.name: insert | upsert | replace | clear | delete conditions | set columns where conditions
_WRITES = """
fabrics.insert: insert
fabrics.rename: set name where id=?
fabrics.setFavorite: set isFavorite where id=?
fabrics.updateDetails: set notes,amountCm,intendedWearer,intendedOccasion where id=?
fabrics.delete: delete id=?
fabrics.deleteAll: clear
dress_styles.upsertAll: upsert
favorite_styles.addFavorite: insert
favorite_styles.removeFavorite: delete styleId=?
favorite_styles.clearFavorites: clear
generated_looks.insert: insert
generated_looks.setFavorite: set isFavorite where id=?
generated_looks.delete: delete id=?
generated_looks.deleteAll: clear
history.insert: insert
history.delete: delete id=?
history.clear: clear
history.prune: delete timestamp<?
usage.upsert: upsert
usage.clear: clear
collections.insert: insert
collections.delete: delete id=?
collection_items.deleteItems: delete collectionId=?
collection_items.addItem: insert
collection_items.removeItem: delete collectionId=? itemType=? itemId=?
wardrobe_items.insert: insert
wardrobe_items.delete: delete id=?
outfits.insertOutfit: insert
outfits.deleteOutfit: delete id=?
measurements.upsert: upsert
measurements.clear: clear
style_feedback.upsert: upsert
style_feedback.delete: delete styleId=?
style_feedback.clear: clear
community_users.insert: upsert
community_users.insertAll: upsert
community_users.update: replace
community_users.delete: delete id=?
gallery_items.insert: upsert
gallery_items.insertAll: upsert
gallery_items.update: replace
gallery_items.delete: delete id=?
gallery_items.deleteAll: clear
comments.insert: upsert
comments.delete: delete id=?
comments.deleteByGalleryItem: delete galleryItemId=?
likes.insert: upsert
likes.delete: delete galleryItemId=? userId=?
style_challenges.insert: upsert
style_challenges.insertAll: upsert
style_challenges.update: replace
style_challenges.delete: delete id=?
challenge_entries.insert: upsert
challenge_entries.update: replace
challenge_entries.delete: delete id=?
recent_searches.insert: upsert
recent_searches.delete: delete query=?
recent_searches.deleteAll: clear
reports.insert: upsert
reports.update: replace
reports.delete: delete id=?
blocked_users.insert: upsert
blocked_users.delete: delete userId=?
blocked_users.deleteAll: clear
cached_posts.insert: upsert
cached_posts.insertAll: upsert
cached_posts.delete: delete id=?
cached_posts.deleteAll: clear
cached_posts.deleteOlderThan: delete cachedAt<?
"""

READS = {line.split(": ", 1)[0]: [x.strip() for x in line.split(":", 1)[1].split("|")] for line in _READS.strip().splitlines()}
WRITES = dict(line.split(": ", 1) for line in _WRITES.strip().splitlines())


def read(name: str, table: DataFrame, *arguments) -> DataFrame:
    """The read of that name ('gallery_items.observeByTag') over its table. Ties in an order are broken by the key."""
    conditions, order, limit, result = READS[name]
    rows = table.where(where(table, conditions, arguments)) if conditions else table
    if result == "count":
        return rows.agg(F.count("*").alias("count"))
    if result == "exists":
        return rows.limit(1).agg((F.count("*") > 0).alias("exists"))
    if order:
        key = F.col(table.columns[0]).asc_nulls_first()
        rows = rows.orderBy(F.desc(order[1:]) if order.startswith("-") else F.asc(order), key)
    if limit:
        rows = rows.limit(int(limit))
    return rows if result == "rows" else rows.select(result)


def write(name: str, table: DataFrame, *arguments) -> DataFrame:
    """The table after the write of that name. New rows are a DataFrame; values to set come before the conditions' arguments."""
    kind, _, rest = WRITES[name].partition(" ")
    key = table.columns[0]
    if kind in ("insert", "upsert", "replace"):
        return {"insert": store.insert, "upsert": store.upsert, "replace": store.replace}[kind](table, arguments[0], key)
    if kind == "clear":
        return store.clear(table)
    if kind == "delete":
        return store.delete(table, where(table, rest, arguments))
    columns, conditions = rest.split(" where ")
    names = columns.split(",")
    return store.update(table, where(table, conditions, arguments[len(names) :]), **dict(zip(names, arguments, strict=False)))
