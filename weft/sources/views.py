"""The catalogue's relations, derived from the star schema and the text tables.

VIEWS holds each as SQL that both Spark and DuckDB run over tables of these names; view() runs it on Spark. Names of
Spark's and DuckDB's functions that differ are given by DIALECT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.schema import CATEGORIES, COLORS, OCCASIONS, PATTERNS, TEXTURES

BASE = 1_700_000_000_000

#: Styles of our own: id, title, gender, category, silhouette, structure, occasions, affinity. A style's structure is the mean of this one and of what the sizes of its parts say, in steps of 0.05.
STYLES = [
    ("kaba_gala", "Gala Kaba", "WOMEN", "TRADITIONAL", "KABA", 0.75, "WEDDING,CEREMONY", "KENTE,ADINKRA"),
    ("kaba_day", "Day Kaba", "WOMEN", "TRADITIONAL", "MODERN_KABA", 0.6, "CHURCH,EVERYDAY", "WAX,ANKARA"),
    ("maxi_breeze", "Breeze Maxi", "WOMEN", "CASUAL", "MAXI", 0.25, "PARTY,EVERYDAY", "CHIFFON,SILK"),
    ("gown_evening", "Evening Gown", "WOMEN", "FORMAL", "GOWN", 0.55, "PARTY,WEDDING", "VELVET,SILK,LACE"),
    ("mermaid_lace", "Lace Mermaid", "WOMEN", "FORMAL", "MERMAID", 0.5, "WEDDING", "LACE,BROCADE"),
    ("peplum_office", "Office Peplum", "WOMEN", "FORMAL", "PEPLUM", 0.65, "OFFICE,CHURCH", "ANKARA,LINEN"),
    ("straight_simple", "Simple Straight Dress", "WOMEN", "CASUAL", "STRAIGHT", 0.4, "OFFICE,EVERYDAY", "COTTON_PLAIN,LINEN"),
    ("skirt_blouse", "Skirt and Blouse", "WOMEN", "CASUAL", "SKIRT_BLOUSE", 0.45, "CHURCH", "BATIK,TIEDYE"),
    ("jumpsuit_bold", "Bold Jumpsuit", "WOMEN", "CASUAL", "JUMPSUIT", 0.5, "PARTY", "DENIM,ANKARA"),
    ("beach_cover", "Beach Cover", "WOMEN", "CASUAL", "COVER_UP", 0.15, "EVERYDAY", "CHIFFON,TIEDYE"),
    ("agbada_royal", "Royal Agbada", "MEN", "TRADITIONAL", "AGBADA", 0.85, "WEDDING,FESTIVAL", "BROCADE,KENTE"),
    ("kaftan_calm", "Calm Kaftan", "MEN", "TRADITIONAL", "KAFTAN", 0.5, "CEREMONY,CHURCH", "COTTON_PLAIN,LINEN"),
    ("smock_north", "Northern Smock", "MEN", "TRADITIONAL", "SMOCK", 0.8, "FESTIVAL,CEREMONY", "FUGU,GONJA"),
    ("shirt_print", "Print Shirt", "MEN", "CASUAL", "PRINT_SHIRT", 0.3, "PARTY,EVERYDAY", "ANKARA,WAX"),
    ("senator_slim", "Slim Senator", "MEN", "FORMAL", "SENATOR", 0.65, "OFFICE,CHURCH", "WOOL,LINEN"),
    ("shirt_trousers", "Shirt and Trousers", "MEN", "FORMAL", "SHIRT_TROUSERS", 0.6, "OFFICE", "COTTON_PLAIN,WOOL"),
    ("modern_trad", "Modern Traditional", "MEN", "TRADITIONAL", "MODERN_TRADITIONAL", 0.7, "WEDDING,MOURNING", "KENTE_PRINT,ADINKRA"),
    ("coords_city", "City Co-ords", "UNISEX", "CASUAL", "CO_ORDS", 0.45, "EVERYDAY,PARTY", "DENIM,BATIK"),
    ("kaftan_free", "Free Kaftan", "UNISEX", "CASUAL", "KAFTAN", 0.3, "EVERYDAY", "SILK,BATIK"),
    ("formal_dress", "Formal Dress", "WOMEN", "FORMAL", "FORMAL_DRESS", 0.7, "OFFICE,CEREMONY", "BROCADE,VELVET"),
]

#: Wardrobe enums: fixed values.
TYPES = "SHIRT PANTS DRESS SKIRT SHOES JACKET BAG ACCESSORIES".split()
HUES = "Black White Navy Gray Beige Red Blue Brown".split()
MOODS = "Casual Formal Bohemian Minimalist Streetwear Vintage Business Sporty".split()


def _pick(names: list[str], index: str, dialect: str) -> str:
    """The name at a 0-based index."""
    items = ", ".join(f"'{n}'" for n in names)
    return f"get(array({items}), CAST({index} AS INT))" if dialect == "spark" else f"([{items}])[CAST({index} AS INT) + 1]"


def _sql(dialect: str) -> dict[str, str]:
    spark = dialect == "spark"
    pick = lambda names, index: _pick(names, index, dialect)
    text = "STRING" if spark else "VARCHAR"
    arr = lambda *x: f"array({', '.join(x)})" if spark else f"[{', '.join(x)}]"
    ms = lambda c: f"unix_millis(CAST({c} AS TIMESTAMP))" if spark else f"(epoch_us({c}) // 1000)"
    values = ", ".join(str((k, *s)) for k, s in enumerate(STYLES))
    split = lambda c: f"split({c}, ',')" if spark else f"string_split({c}, ',')"
    first_line = "split(text, '\\n')[0]" if spark else "string_split(text, chr(10))[1]"
    color = lambda k: f"named_struct('argb', CAST(4278190080 + (p_partkey * 7919 * {k + 1} * 10473) % 16777216 AS BIGINT), 'colorName', {pick(COLORS, f'(p_partkey + {k * 4}) % 15')})" if spark else f"{{'argb': CAST(4278190080 + (p_partkey * 7919 * {k + 1} * 10473) % 16777216 AS BIGINT), 'colorName': {pick(COLORS, f'(p_partkey + {k * 4}) % 15')}}}"
    colors = arr(*map(color, range(4)))
    colors = f"slice({colors}, 1, CAST(1 + p_partkey % 4 AS INT))" if spark else f"list_slice({colors}, 1, 1 + p_partkey % 4)"
    trunc = lambda e: f"CAST({e} AS INT)" if spark else f"CAST(trunc({e}) AS INT)"
    return {
        "users": f"SELECT c_custkey AS id, lower(replace(c_name, '#', '_')) AS username, c_name AS displayName, {trunc('abs(c_acctbal)')} AS followerCount, CAST(c_custkey % 100 AS INT) AS followingCount, c_custkey % 3 = 0 AS isFollowing, {BASE} + c_custkey * 60000 AS createdAt FROM customer",
        "posts": f"SELECT doc_id AS id, doc_id % 150 AS userId, {first_line} AS title, text AS description, {arr('lang', 'source')} AS tags, lang || ',' || source AS tagsCsv, CAST(n_chars % 500 AS INT) AS likeCount, CAST(n_chars % 50 AS INT) AS commentCount, doc_id % 7 = 0 AS isLiked, {BASE} + doc_id * 3600000 AS createdAt, doc_id % 17 AS fabricId FROM documents",
        "comments": f"SELECT conv_id * 1000 + turn AS id, conv_id AS galleryItemId, conv_id % 150 AS userId, role, text, {BASE} + conv_id * 86400000 + turn * 1000 AS createdAt FROM conversations",
        "history": f"SELECT event_id AS id, event_type AS kind, user_id AS userId, event_id % 200 AS target, value, {ms('ts')} AS timestamp FROM events",
        "likes": f"SELECT event_id AS id, event_id % 200 AS galleryItemId, user_id AS userId, {ms('ts')} AS createdAt FROM events WHERE event_type = 'click'",
        "challenges": f"SELECT p_partkey AS id, p_name AS title, p_type || ' ' || p_brand AS description, {BASE} + p_partkey * 86400000 AS startDate, {BASE} + (p_partkey + p_size) * 86400000 AS endDate, p_size AS participantCount, p_partkey % 2 = 0 AS isActive FROM part",
        "entries": f"SELECT l_partkey AS challengeId, l_orderkey AS orderId, l_linenumber AS line, l_suppkey AS userId, {trunc('l_quantity')} AS voteCount, {ms('l_shipdate')} AS submissionDate FROM lineitem",
        "fabrics": f"SELECT p_partkey AS id, p_name AS name, {pick(CATEGORIES[:17], 'p_partkey % 17')} AS category, {pick(PATTERNS, 'p_partkey % 10')} AS pattern, {pick(TEXTURES, 'p_partkey % 9')} AS texture, p_size / 50.0D AS motifScale, (p_partkey % 100) / 100.0D AS saturation, p_partkey % 5 = 0 AS isFavorite, {BASE} + p_partkey * 7200000 AS createdAt, {colors} AS colors, {arr(pick(OCCASIONS, 'p_partkey % 8'), pick(OCCASIONS, '(p_partkey + 3) % 8'))} AS suggestedUses FROM part".replace("50.0D", "50.0D" if spark else "CAST(50 AS DOUBLE)").replace("100.0D", "100.0D" if spark else "CAST(100 AS DOUBLE)"),
        "styles": f"SELECT ordinal, id, title, gender, category, silhouette, floor((CAST(v.structure AS DOUBLE) + mean) * 10 + CAST(0.5 AS DOUBLE)) / CAST(20 AS DOUBLE) AS structure, {split('occasions')} AS occasions, {split('affinity')} AS affinity FROM (VALUES {values}) AS v(ordinal, id, title, gender, category, silhouette, structure, occasions, affinity) JOIN (SELECT p_partkey % 20 AS k, avg(p_size) / CAST(50 AS DOUBLE) AS mean FROM part GROUP BY p_partkey % 20) pa ON pa.k = v.ordinal",
        "favorites": f"SELECT s.id AS styleId, max(h.timestamp) AS addedAt FROM ({{history}}) h JOIN ({{styles}}) s ON h.id % 20 = s.ordinal WHERE h.kind = 'purchase' AND h.userId = 7 GROUP BY s.id",
        "reports": f"SELECT d.doc_id AS id, d.doc_id % 150 AS reporterId, d.doc_id % 40 AS contentId, CASE WHEN d.doc_id % 2 = 0 THEN 'POST' ELSE 'COMMENT' END AS contentType, {pick(['SPAM', 'HARASSMENT', 'INAPPROPRIATE', 'COPYRIGHT', 'FAKE', 'OTHER'], 'd.doc_id % 6')} AS reportType, {pick(['PENDING', 'REVIEWED', 'RESOLVED', 'DISMISSED'], 'd.doc_id % 4')} AS status, {BASE} + d.doc_id * 60000 AS createdAt FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1",
        "wardrobe": f"SELECT o_orderkey AS id, o_custkey AS owner, {pick(TYPES, 'o_orderkey % 8')} AS type, {pick(HUES, '(o_orderkey * 3 + o_custkey) % 8')} AS color, {pick(MOODS, '(o_orderkey * 5 + o_custkey) % 8')} AS style FROM orders",
        "stories": f"SELECT event_id AS id, user_id AS userId, {ms('ts')} AS createdAt, {ms('ts')} + 86400000 AS expiresAt FROM events WHERE event_type = 'view'",
        "looks": f"SELECT o_orderkey AS id, o_custkey % 17 AS fabricId, 'style_' || CAST(o_orderkey % 20 AS {text}) AS dressStyleId, o_orderpriority AS engine, o_orderstatus = 'F' AS isFavorite, {BASE} + o_orderkey * 1000 AS createdAt, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'g' || CAST(o_custkey % 50 AS {text}) END AS variationGroup FROM orders",
        "usages": f"SELECT event_type || '_' || CAST(user_id AS {text}) AS key, CAST(count(*) AS INT) AS count FROM events GROUP BY event_type, user_id",
        "collections": f"SELECT s_suppkey AS id, s_name AS name, {BASE} + s_suppkey * 1000 AS createdAt FROM supplier",
        "collection_items": f"SELECT o_orderkey AS id, o_orderkey % 50 + 1 AS collectionId, {pick(['DESIGN', 'FABRIC', 'LOOK', 'ODD'], 'o_orderkey % 4')} AS itemType, CAST(o_custkey % 40 AS {text}) AS itemId, {BASE} + (o_orderkey * 7919) % 100000 AS addedAt FROM orders",
        "closet": f"SELECT p_partkey AS id, p_name AS name, {pick(['DRESS', 'TOP', 'BOTTOM', 'SHOES', 'BAG', 'ACCESSORY'], 'p_partkey % 6')} AS category, {BASE} + (p_partkey * 104729) % 1000000 AS createdAt FROM part",
        "outfits": f"SELECT c_custkey AS id, c_name AS name, CAST(c_custkey AS {text}) || ',x,' || CAST(c_custkey * 3 % 2000 AS {text}) || ', ' AS itemIdsCsv, {BASE} + c_custkey * 5000 AS createdAt FROM customer",
        "measured": f"SELECT CAST(c_custkey AS INT) AS id, CAST(140 + c_custkey % 50 AS INT) AS heightCm, CAST(60 + c_custkey % 40 AS INT) AS waistCm, CAST(80 + c_custkey % 30 AS INT) AS hipCm, {BASE} + c_custkey AS updatedAt FROM customer",
        "feedback": f"SELECT id AS styleId, ordinal % 3 = 0 AS dismissed, {BASE} + ordinal AS updatedAt FROM ({{styles}}) st",
        "searches": "SELECT kind || '_' || CAST(userId AS " + text + ") AS query, max(timestamp) AS timestamp FROM ({history}) hi GROUP BY kind, userId",
        "blocked": f"SELECT c_custkey AS userId, c_name AS username, c_mktsegment AS reason, {BASE} + (c_custkey * 31) % 5000 AS blockedAt FROM customer WHERE c_custkey % 7 = 0",
        "cached": f"SELECT doc_id AS id, doc_id % 150 AS userId, {first_line} AS title, CAST(n_chars % 500 AS INT) AS likeCount, {BASE} + doc_id * 3600000 AS createdAt, {BASE} + (doc_id * 7919) % 1000 * 3600000 AS cachedAt FROM documents",
    }


def _resolved(dialect: str) -> dict[str, str]:
    out = _sql(dialect)
    return {k: v.replace("{history}", out["history"]).replace("{styles}", out["styles"]) for k, v in out.items()}


VIEWS, DUCK = _resolved("spark"), _resolved("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the Parquet tables of sf_dir; only those it names are read."""
    import re

    query, args = VIEWS[name], {}
    for t in TABLES:
        if re.search(rf"(?:FROM|JOIN) {t}\b", query):
            query = re.sub(rf"((?:FROM|JOIN)) {t}\b", rf"\1 {{{t}}}", query)
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # braces of the SQL itself don't occur in the Spark dialect
    return spark.sql(query, **args) if args else spark.sql(query)


def with_views(body: str, *names: str) -> str:
    """body with the views it names before it, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({DUCK[n]})" for n in names) + " " + body
