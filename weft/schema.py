"""Tables, enum names and their order, and the maps between them."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum names, in their order.
CATEGORIES = "KENTE ADINKRA WAX ANKARA BATIK TIEDYE LACE BROCADE COTTON_PLAIN LINEN SILK CHIFFON VELVET DENIM KENTE_PRINT FUGU GONJA WOOL UNKNOWN".split()
PATTERNS = "STRIPED CHECKED GEOMETRIC FLORAL ORGANIC SYMBOLIC DOTTED ABSTRACT SOLID GRADIENT".split()
TEXTURES = "WOVEN SMOOTH SLUB SHEER PILE STIFF SOFT QUILTED EMBROIDERED".split()
COLORS = "RED ORANGE GOLD YELLOW GREEN TEAL BLUE INDIGO PURPLE PINK BROWN BLACK GREY WHITE CREAM".split()
OCCASIONS = "WEDDING CHURCH MOURNING OFFICE PARTY EVERYDAY CEREMONY FESTIVAL".split()
REPORT_TYPES = "SPAM HARASSMENT INAPPROPRIATE COPYRIGHT FAKE OTHER".split()
REPORT_STATUS = "PENDING REVIEWED RESOLVED DISMISSED".split()

# Silhouettes by what they suit.
LARGE_PANEL = "KABA MODERN_KABA MAXI GOWN AGBADA KAFTAN SMOCK COVER_UP".split()
FITTED = "STRAIGHT MERMAID PEPLUM PRINT_SHIRT SENATOR SHIRT_TROUSERS FORMAL_DRESS MODERN_TRADITIONAL".split()
WAIST_DEFINED = "MERMAID PEPLUM KABA MODERN_KABA SKIRT_BLOUSE FORMAL_DRESS".split()
TALL = "AGBADA KAFTAN SMOCK MAXI GOWN SENATOR".split()
ELONGATING = "STRAIGHT MODERN_TRADITIONAL JUMPSUIT CO_ORDS SENATOR".split()
PANEL_ALIGNED = "KABA MODERN_KABA AGBADA SMOCK SENATOR STRAIGHT".split()
STRUCTURED = "STRIPED CHECKED GEOMETRIC SYMBOLIC".split()
TRADITIONAL_CLOTHS = "KENTE ADINKRA WAX ANKARA BATIK FUGU GONJA KENTE_PRINT".split()
#: How stiff a texture is.
STRUCTURE = {"WOVEN": 0.7, "STIFF": 0.9, "SLUB": 0.6, "SMOOTH": 0.4, "SOFT": 0.2, "SHEER": 0.15, "PILE": 0.8, "QUILTED": 0.9, "EMBROIDERED": 0.75}

_KINDS = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "f": T.FloatType(), "b": T.BooleanType()}


def _table(columns: str) -> T.StructType:
    """'id:l name:s?' to a schema; ? is nullable."""
    return T.StructType([T.StructField(n, _KINDS[k[0]], k.endswith("?")) for n, k in (c.split(":") for c in columns.split())])


#: The stored tables. The first column is the primary key.
TABLES = {
    "fabrics": _table("id:l imageUri:s name:s? category:s colorsJson:s pattern:s texture:s confidence:f saturation:f brightness:f contrast:f colorCount:i motifScale:f printTraits:s suggestedUses:s engine:s isFavorite:i createdAt:l notes:s? amountCm:i? intendedWearer:s? intendedOccasion:s? acquiredAt:l?"),
    "dress_styles": _table("id:s titleKey:s descriptionKey:s gender:s category:s occasions:s silhouette:s affinity:s structure:f"),
    "favorite_styles": _table("styleId:s addedAt:l"),
    "generated_looks": _table("id:l fabricId:l dressStyleId:s personImageUri:s resultImageUri:s engine:s isFavorite:i createdAt:l variationGroup:s?"),
    "history": _table("id:l kind:s labelKey:s? label:s? imageUri:s? timestamp:l"),
    "usage": _table("key:s count:i"),
    "collections": _table("id:l name:s createdAt:l"),
    "collection_items": _table("id:l collectionId:l itemType:s itemId:s addedAt:l"),
    "wardrobe_items": _table("id:l name:s category:s imageUri:s notes:s? createdAt:l"),
    "outfits": _table("id:l name:s itemIdsCsv:s createdAt:l"),
    "measurements": _table("id:i heightCm:i? chestCm:i? waistCm:i? hipCm:i? shoulderCm:i? sleeveCm:i? inseamCm:i? neckCm:i? notes:s? updatedAt:l"),
    "style_feedback": _table("styleId:s dismissed:i updatedAt:l"),
    "community_users": _table("id:s username:s displayName:s bio:s avatarUrl:s? followerCount:i followingCount:i galleryCount:i isFollowing:b createdAt:l"),
    "gallery_items": _table("id:s userId:s username:s userAvatar:s? title:s description:s imageUrl:s mediaType:s videoUrl:s? videoDuration:i? thumbnailUrl:s? fabricIds:s styleId:s? tags:s likeCount:i commentCount:i isLiked:b createdAt:l"),
    "comments": _table("id:s galleryItemId:s userId:s username:s userAvatar:s? text:s createdAt:l"),
    "likes": _table("id:s galleryItemId:s userId:s createdAt:l"),
    "style_challenges": _table("id:s title:s description:s bannerUrl:s? startDate:l endDate:l participantCount:i requiredFabricTypes:s requiredOccasions:s prizes:s isActive:b isParticipating:b"),
    "challenge_entries": _table("id:s challengeId:s userId:s username:s userAvatar:s? galleryItemId:s submissionDate:l voteCount:i isVoted:b"),
    "recent_searches": _table("query:s timestamp:l"),
    "reports": _table("id:s reporterId:s reportedUserId:s contentType:s contentId:s reportType:s description:s status:s createdAt:l resolvedAt:l? resolution:s?"),
    "blocked_users": _table("userId:s username:s displayName:s avatarUrl:s? blockedAt:l reason:s?"),
    "cached_posts": _table("id:s userId:s title:s description:s imageUrl:s? videoUrl:s? mediaType:s likeCount:i commentCount:i isLiked:b createdAt:l cachedAt:l"),
}
