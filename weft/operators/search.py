"""Search over posts, users, tags and challenges; suggestions; intents of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of an intent.
OCCASION_WORDS = {
    "wedding": "WEDDING", "bride": "WEDDING", "engagement": "WEDDING", "church": "CHURCH", "service": "CHURCH", "funeral": "MOURNING", "mourning": "MOURNING",
    "office": "OFFICE", "work": "OFFICE", "interview": "OFFICE", "party": "PARTY", "birthday": "PARTY", "date": "PARTY", "everyday": "EVERYDAY", "daily": "EVERYDAY",
    "casual wear": "EVERYDAY", "graduation": "CEREMONY", "ceremony": "CEREMONY", "naming": "CEREMONY", "outdooring": "CEREMONY", "festival": "FESTIVAL",
    "homowo": "FESTIVAL", "odwira": "FESTIVAL", "akwasidae": "FESTIVAL", "christmas": "FESTIVAL", "eid": "FESTIVAL",
}
GENDER_WORDS = {
    "MEN": "men man male him his mens men's".split(), "WOMEN": "women woman female ladies lady her hers womens women's".split(), "UNISEX": "unisex anyone".split(),
}
CATEGORY_WORDS = {"FORMAL": "formal elegant official".split(), "TRADITIONAL": "traditional culture customary".split(), "CASUAL": "casual relaxed everyday".split()}
FABRIC_WORDS = "kente adinkra wax ankara batik lace brocade linen silk denim fugu smock batakari gonja".split()
ADJECTIVES = "simple plain minimal elegant flashy bold modern contemporary classic".split()
STOP_WORDS = "show me something find search for a an the of some any suitable look looks design designs dress dresses outfit outfits to my i want need but not too".split()

_RESULT = ["kind", "id", "title", "timestamp", "likeCount", "commentCount", "branch"]


def has(c: Column, query: str) -> Column:
    """Contains, case ignored."""
    return F.contains(F.lower(c), F.lit(query.lower()))


def search_posts(posts: DataFrame, query: str, tags: list[str] | None = None, fabrics: list[int] | None = None, since: Column | int | None = None, min_likes: int = 0, min_comments: int = 0) -> DataFrame:
    """Posts whose title, description or a tag contains the query, and that pass all filters given."""
    hit = has(F.col("title"), query) | has(F.col("description"), query) | F.exists("tags", lambda t: has(t, query))
    if tags:
        hit &= F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if fabrics:
        hit &= F.col("fabricId").isin(fabrics)
    if since is not None:
        hit &= F.col("createdAt") >= since
    return posts.where(hit & (F.col("likeCount") >= min_likes) & (F.col("commentCount") >= min_comments))


def search_users(users: DataFrame, query: str) -> DataFrame:
    return users.where(has(F.col("username"), query) | has(F.col("displayName"), query))


def search_tags(posts: DataFrame, query: str) -> DataFrame:
    """tag, posts: the distinct tags that contain the query with the number of posts that have them."""
    one = posts.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    return one.where(has(F.col("tag"), query)).groupBy("tag").agg(F.count("*").alias("posts"))


def search_challenges(challenges: DataFrame, query: str) -> DataFrame:
    return challenges.where(has(F.col("title"), query) | has(F.col("description"), query))


def unified(posts: DataFrame, users: DataFrame, challenges: DataFrame, query: str, now: int, sort: str = "MOST_RELEVANT", limit: int | None = None, **filters) -> DataFrame:
    """All results of all four kinds in one order; a blank query finds nothing. Ties keep the order of kinds, then ids.

    filters: those of search_posts(), the start of a range of dates among them; they hold for posts, other kinds have none. limit is the caller's.
    """

    def part(rows: DataFrame, branch: int, kind: str, id: str, title: str, time: Column, likes: Column | None = None, comments: Column | None = None) -> DataFrame:
        none = F.lit(0)
        return rows.select(F.lit(kind).alias("kind"), F.col(id).cast("string").alias("id"), F.col(title).alias("title"), time.cast("long").alias("timestamp"), (none if likes is None else likes).cast("int").alias("likeCount"), (none if comments is None else comments).cast("int").alias("commentCount"), F.lit(branch).alias("branch"))

    if not query.strip():
        return part(users.where(F.lit(False)), 0, "POST", "id", "displayName", F.col("createdAt"))
    out = part(search_posts(posts, query, **filters), 0, "POST", "id", "title", F.col("createdAt"), F.col("likeCount"), F.col("commentCount"))
    out = out.unionByName(part(search_users(users, query), 1, "USER", "id", "displayName", F.col("createdAt")))
    out = out.unionByName(part(search_tags(posts, query).withColumn("title", F.concat(F.lit("#"), "tag")), 2, "TAG", "tag", "title", F.lit(now)))
    out = out.unionByName(part(search_challenges(challenges, query), 3, "CHALLENGE", "id", "title", F.col("startDate")))
    out = in_order(out, sort, query)
    return out.limit(limit) if limit else out


def in_order(results: DataFrame, sort: str, query: str) -> DataFrame:
    """Results by one of five orders; ties keep the order of kinds, then ids."""
    title, q = F.lower("title"), query.lower()
    relevance = F.when(title == q, 2).when(F.startswith(title, F.lit(q)), 1).otherwise(0)
    first = {"NEWEST": F.desc("timestamp"), "OLDEST": F.asc("timestamp"), "MOST_LIKED": F.desc("likeCount"), "MOST_COMMENTED": F.desc("commentCount"), "MOST_RELEVANT": relevance.desc()}[sort]
    return results.orderBy(first, "branch", "id")


def by_kind(results: DataFrame) -> DataFrame:
    """kind, results: how many of each kind there are."""
    return results.groupBy("kind").agg(F.count("*").alias("results"))


def all_tags(posts: DataFrame) -> DataFrame:
    return posts.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def suggestions(recent: DataFrame, posts: DataFrame, users: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """kind, text: five recent queries for a blank query; else up to three tags and three users that contain it."""
    if not query.strip():
        return recent.orderBy(F.desc("timestamp"), "query").limit(5).select(F.lit("RECENT").alias("kind"), F.col("query").alias("text"))
    tags = all_tags(posts).where(has(F.col("tag"), query)).orderBy("tag").limit(3).select(F.lit("TAG").alias("kind"), F.concat(F.lit("#"), "tag").alias("text"))
    people = users.where(has(F.col("username"), query)).orderBy("username").limit(3).select(F.lit("USER").alias("kind"), F.concat(F.lit("@"), "username").alias("text"))
    return tags.unionByName(people).limit(limit)


def mention_candidates(users: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Users whose username starts with the query, or whose name contains it."""
    return users.where(F.startswith(F.lower("username"), F.lit(query.lower())) | has(F.col("displayName"), query)).orderBy("username").limit(limit)


def parse_intent(phrases: DataFrame, text: str = "text") -> DataFrame:
    """phrases with intent: struct<occasions, gender, category, fabrics, adjectives, remainder>.

    Occasion, fabric and style words are looked for anywhere in the lower-cased text, in order, and each that is found is taken
    out before the next is looked for; words of gender and category are whole tokens. A blank phrase has an empty intent.
    """
    empty = F.array().cast("array<string>")
    work = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    tokens = F.filter(F.split(work, "[^a-z']+"), lambda x: x != "")
    out = phrases.withColumns({"_t": tokens, "_w": work, "_o": empty, "_f": empty, "_a": empty})

    def take(frame: DataFrame, found: str, words: list[tuple[str, str]], tokens_too: bool = False) -> DataFrame:
        # which words stand in the text depends on what was taken out before: a fold over the words
        start = F.struct(F.col("_w").alias("w"), F.col(found).alias("found"))
        pairs = F.array(*[F.struct(F.lit(a).alias("word"), F.lit(b).alias("name")) for a, b in words])

        def step(state: Column, pair: Column) -> Column:
            hit = F.contains(state["w"], pair["word"])
            named = hit | F.array_contains(F.col("_t"), pair["word"]) if tokens_too else hit
            return F.struct(F.when(hit, F.replace(state["w"], pair["word"], F.lit(" "))).otherwise(state["w"]).alias("w"), F.when(named, F.array_append(state["found"], pair["name"])).otherwise(state["found"]).alias("found"))

        return frame.withColumn("_s", F.aggregate(pairs, start, step)).withColumn("_w", F.col("_s.w")).withColumn(found, F.array_distinct("_s.found")).drop("_s")

    out = take(out, "_o", list(OCCASION_WORDS.items()))
    out = take(out, "_f", [(w, w) for w in FABRIC_WORDS])
    out = take(out, "_a", [(w, w) for w in ADJECTIVES], tokens_too=True)

    def first_of(groups: dict[str, list[str]]) -> Column:
        c = F.lit(None).cast("string")
        for name, words in reversed(groups.items()):
            c = F.when(F.arrays_overlap("_t", F.array(*map(F.lit, words))), name).otherwise(c)
        return c

    rest = F.filter(F.split("_w", "[^a-z']+"), lambda x: (F.length(x) > 2) & ~x.isin(STOP_WORDS))
    intent = F.struct(F.col("_o").alias("occasions"), first_of(GENDER_WORDS).alias("gender"), first_of(CATEGORY_WORDS).alias("category"), F.col("_f").alias("fabrics"), F.col("_a").alias("adjectives"), F.array_join(rest, " ").alias("remainder"))
    return out.withColumn("intent", intent).drop("_t", "_w", "_o", "_f", "_a")


def smart_styles(styles: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """Each phrase with the styles that suit its intent: without any structured part those whose title contains the whole
    phrase; else those that suit gender (or are UNISEX), occasion, category, fabric and what remains. Fabric words without a category don't bind."""
    asked = parse_intent(phrases, text)
    i, s = "intent", styles.alias("s")
    known = F.filter(F.transform(F.col(f"{i}.fabrics"), F.upper), lambda x: ~x.isin("SMOCK", "BATAKARI"))
    plain = (F.size(f"{i}.occasions") == 0) & F.col(f"{i}.gender").isNull() & F.col(f"{i}.category").isNull() & (F.size(f"{i}.fabrics") == 0)
    fits = (
        (F.col(f"{i}.gender").isNull() | (F.col("s.gender") == F.col(f"{i}.gender")) | (F.col("s.gender") == "UNISEX"))
        & ((F.size(f"{i}.occasions") == 0) | F.arrays_overlap("s.occasions", f"{i}.occasions")) & (F.col(f"{i}.category").isNull() | (F.col("s.category") == F.col(f"{i}.category")))
        & ((F.size(known) == 0) | F.arrays_overlap(F.col("s.affinity"), known)) & ((F.col(f"{i}.remainder") == "") | F.contains(F.lower("s.title"), F.col(f"{i}.remainder")))
    )
    whole = F.contains(F.lower("s.title"), F.lower(F.trim(F.col(text))))
    return asked.join(s, F.when(plain, whole).otherwise(fits)).select(*[asked[c] for c in phrases.columns], F.col("s.id").alias("styleId"), F.col("s.ordinal"))
