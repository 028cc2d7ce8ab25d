"""Advice: feature vectors, the server's ranker, outfits, category verdicts, hashtags, tips and the lists of the discover screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft import schema as S
from weft.functions.color import skin_harmony
from weft.operators.match import COLOR_PAIRS, STYLE_PAIRS, compatible, dealt, outfit_confidence, suits_gender

# The server's own sets of silhouettes.
SERVER_LARGE = ("KABA", "MODERN_KABA", "MAXI", "GOWN", "AGBADA", "KAFTAN", "SMOCK")
SERVER_FITTED = ("STRAIGHT", "MERMAID", "PEPLUM", "PRINT_SHIRT", "SENATOR")
SERVER_WAIST = ("MERMAID", "PEPLUM", "KABA", "MODERN_KABA")
# Styles that are shown first.
FEATURED = ("kaba_slit", "modern_kaba", "maxi_dress", "co_ords", "peplum", "african_gown")
# What a part of a label says of a cloth, the first that is found.
LABEL_WORDS = (
    ("VELVET", ("velvet",)),
    ("WOOL", ("wool", "knit", "cardigan", "sweater")),
    ("DENIM", ("jean", "denim")),
    ("LACE", ("lace", "doily", "guipure")),
    ("BROCADE", ("damask", "brocade", "jacquard", "aso-oke", "asooke")),
    ("FUGU", ("fugu", "batakari", "smock")),
    ("GONJA", ("gonja", "daboya")),
    ("KENTE_PRINT", ("kente_print",)),
    ("KENTE", ("kente", "bonwire", "agbamevo", "stole", "poncho", "tartan")),
    ("ADINKRA", ("adinkra",)),
    ("BATIK", ("batik",)),
    ("TIEDYE", ("tiedye", "tie-dye", "adire")),
    ("WAX", ("wax",)),
    ("ANKARA", ("ankara", "kitenge", "pagne", "sarong", "kimono", "abaya", "overskirt", "hoopskirt")),
    ("CHIFFON", ("chiffon", "gown", "veil", "tulle")),
    ("SILK", ("silk", "satin", "pajama", "robe", "organza")),
    ("LINEN", ("linen", "dishrag", "handkerchief", "towel")),
    ("COTTON_PLAIN", ("cotton_plain", "cotton", "calico", "poplin")),
)
# Advice by season.
TIPS = {
    "COOL": ("Try richer fabrics like Kente for the cool season", "Layer with lace or chiffon for elegance", "Deep colors work well in harmattan weather"),
    "HOT": ("Light cotton and Ankara are perfect for hot days", "Bright colors reflect the sunny weather", "Loose, flowing styles keep you cool"),
    "RAINY": ("Darker fabrics hide rain spots better", "Quick-dry fabrics are practical", "Consider indoor events with formal attire"),
    "WEDDING": ("Wedding season! Time for your finest Kente", "Formal occasion wear is in high demand", "Coordinate with wedding color schemes"),
}
# The colours and the pattern that stand for a category.
PALETTES = {
    "KENTE": (0xFFC8952B, 0xFF8C2F39, 0xFF1F5450, 0xFF14110F),
    "ADINKRA": (0xFF4A2C17, 0xFF14110F, 0xFFB0803F),
    "WAX": (0xFF2F7D4F, 0xFFC8952B, 0xFF8C2F39, 0xFFFDF8F2),
    "ANKARA": (0xFF2F7D4F, 0xFFC8952B, 0xFF8C2F39, 0xFFFDF8F2),
    "BATIK": (0xFF31556E, 0xFF7FA3BC, 0xFF1D3446),
    "TIEDYE": (0xFF274B8F, 0xFF8FB0E8, 0xFFFDF8F2),
    "LACE": (0xFFE8DED2, 0xFFC9B7A4, 0xFFFDF8F2),
    "BROCADE": (0xFF2E6E6A, 0xFFC8952B),
    "DENIM": (0xFF2B3A5C, 0xFF3E5379),
    "LINEN": (0xFFD9CDBB, 0xFFC9BCA7),
    "SILK": (0xFFB02E43, 0xFFD06A7B),
    "CHIFFON": (0xFFE7C8D2, 0xFFF6E7EC),
    "VELVET": (0xFF4A0E1C, 0xFF6E1B2C),
    "COTTON_PLAIN": (0xFFF3EFE7,),
    "FUGU": (0xFF3A4250, 0xFF14110F, 0xFFF2EFE9),
    "GONJA": (0xFFB8763A, 0xFFF2EFE9, 0xFF14110F),
    "KENTE_PRINT": (0xFFC8952B, 0xFF1F5450, 0xFF8C2F39),
    "WOOL": (0xFF8B7355, 0xFFA0826D, 0xFFD4C4B7),
    "UNKNOWN": (0xFF9A8F86,),
}
PATTERN_OF = {
    "STRIPED": ("KENTE", "KENTE_PRINT", "FUGU", "GONJA"),
    "SYMBOLIC": ("ADINKRA",),
    "ORGANIC": ("BATIK", "TIEDYE"),
    "SOLID": ("COTTON_PLAIN", "LINEN", "SILK", "VELVET", "CHIFFON"),
}
# What can be changed of a garment, by silhouette.
CONTROLS = (
    (("KABA", "MODERN_KABA", "MAXI", "GOWN", "MERMAID", "PEPLUM", "SKIRT_BLOUSE", "FORMAL_DRESS", "STRAIGHT", "COVER_UP", "CO_ORDS"), ("SLEEVE", "NECKLINE", "LENGTH", "PLACEMENT", "ACCENT")),
    (("KAFTAN", "AGBADA", "SMOCK"), ("SLEEVE", "NECKLINE", "LENGTH", "ACCENT")),
    (("PRINT_SHIRT", "SENATOR", "MODERN_TRADITIONAL", "JUMPSUIT", "SHIRT_TROUSERS", "AFRICAN_SUIT"), ("SLEEVE", "NECKLINE", "ACCENT")),
)
# What a style is worn for.
WORN_FOR = (("Work", ("Formal", "Business")), ("Everyday", ("Casual", "Sporty")), ("Date Night", ("Bohemian", "Romantic")))
# Tags that every picture has.
COMMON_TAGS = ("#fashion", "#style", "#ootd", "#outfit")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _by(c: Column, table, otherwise=None) -> Column:
    """The name whose members hold c; table: (name, members)."""
    out = F.lit(otherwise)
    for name, members in reversed(list(table)):
        out = F.when(c.isin(list(members)), F.lit(name)).otherwise(out)
    return out


def feature_vector(fabrics: DataFrame, styles: DataFrame, skin: int | None = None, measurements: tuple | None = None, anisotropy: float | None = None, favorites: list[str] = (), loved: list[str] = (), gender: str | None = None) -> DataFrame:
    """fabricId, styleId, features: the sixteen numbers of 0 to 1 that a pair is ranked by.

    measurements: height, waist, hip; loved: categories of favourite styles. The styles are a catalogue, each fabric meets all of them in place.
    """
    c = F.col
    silhouette, clamp = c("s.silhouette"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    stiff = F.element_at(F.create_map(*[F.lit(x) for k, v in S.STRUCTURE.items() for x in (k, v)]), c("f.texture"))
    known = dealt(fabrics)
    known = known if skin is None else known.withColumn("_harmony", skin_harmony(F.col("colors.argb"), F.lit(skin)))
    rows = known.alias("f").join(F.broadcast(styles.alias("s")))  # no product of partitions, which would make the styles again for each
    height, waist, hip = measurements or (None, None, None)
    waist_fit, height_fit = F.lit(0.0), F.lit(0.0)
    if waist is not None and hip:
        waist_fit = F.when(F.lit(waist / hip < 0.78) & silhouette.isin(S.WAIST_DEFINED), 1.0).when(F.lit(waist / hip >= 0.85) & silhouette.isin(S.LARGE_PANEL), 0.8).otherwise(0.3)
    if height is not None:
        height_fit = F.when(F.lit(height >= 175) & silhouette.isin(S.TALL) | F.lit(140 <= height <= 162) & silhouette.isin(S.ELONGATING), 1.0).otherwise(0.25)
    vector = [
        stiff, clamp(c("s.structure")), clamp(c("f.motifScale")), _flag(silhouette.isin(S.LARGE_PANEL)), _flag(silhouette.isin(S.FITTED)), _flag(F.array_contains("s.affinity", c("f.category"))),
        clamp(F.size(F.array_intersect("f.suggestedUses", "s.occasions")) / F.greatest(F.size("s.occasions"), F.lit(1))), clamp(c("f.saturation")),
        _flag(c("f.category").isin(S.TRADITIONAL_CLOTHS) & (c("s.category") == "TRADITIONAL")), F.lit(0.5) if skin is None else clamp(c("f._harmony")),
        F.lit(min(max(anisotropy or 0.0, 0.0), 1.0)), _flag(silhouette.isin(S.PANEL_ALIGNED)), waist_fit, height_fit,
        F.when(c("s.id").isin(list(favorites)), 1.0).when(c("s.category").isin(list(loved)), 0.5).otherwise(0.0), F.lit(0.0) if gender is None else _flag(suits_gender(c("s.gender"), gender)),
    ]
    return rows.select(c("f.id").alias("fabricId"), c("s.id").alias("styleId"), F.array(*[x.cast("double") for x in vector]).alias("features"))


def server_rank(fabrics: DataFrame, styles: DataFrame, anisotropy: float, undertone: str, waist: int, hip: int, height: int, gender: str = "ALL") -> DataFrame:
    """fabricId, styleId, title, score (48 to 98): the server's own formula, half rounded to even."""
    s = styles if gender == "ALL" else styles.where(F.col("gender").isin(gender, "UNISEX"))
    silhouette, ratio = F.col("s.silhouette"), waist / max(1.0, float(hip))
    large, fitted = silhouette.isin(list(SERVER_LARGE)), silhouette.isin(list(SERVER_FITTED))
    tone = {"WARM_GOLDEN": 0.92, "NEUTRAL_RICH": 0.86}.get(undertone, 0.83)
    score = (
        38.0 + F.when(F.array_contains("s.affinity", F.col("f.category")), 20.0).otherwise(5.0) + 10.0 * (1.0 - F.abs(0.75 - F.col("s.structure"))) + 8.0 * F.when(F.lit(ratio < 0.78) & silhouette.isin(list(SERVER_WAIST)), 1.0).otherwise(0.45)
        + 6.0 * F.when((F.lit(height >= 172) & large) | (F.lit(height < 164) & fitted), 1.0).otherwise(0.5) + 6.0 * anisotropy * _flag(silhouette.isin(S.PANEL_ALIGNED)) + 8.0 * tone
    )
    whole = F.least(F.lit(98.0), F.greatest(F.lit(48.0), F.bround(F.round(score, 6), 0))).cast("int")
    title = F.initcap(F.replace(F.col("s.id"), F.lit("_"), F.lit(" ")))
    return dealt(fabrics).alias("f").join(F.broadcast(s.alias("s"))).select(F.col("f.id").alias("fabricId"), F.col("s.id").alias("styleId"), title.alias("title"), whole.alias("score"))


def ranked_for(ranked: DataFrame, styles: DataFrame, gender: str | None = None, occasions: list[str] = ()) -> DataFrame:
    """Ranked styles (styleId) that suit a gender and one of the occasions, where these are given."""
    s = styles.select(F.col("id").alias("styleId"), F.col("gender").alias("_g"), F.col("occasions").alias("_o"))
    ok = suits_gender(F.col("_g"), gender)
    if occasions:
        ok &= F.arrays_overlap("_o", F.array(*map(F.lit, occasions)))
    return ranked.join(s, "styleId").where(ok).drop("_g", "_o")


def inspiration(looks: DataFrame, category: str | None, gender: str | None) -> DataFrame:
    """Looks (fabrics, gender) for a category (none and UNKNOWN take all) and a gender, which must be equal."""
    ok = F.lit(True) if category in (None, "UNKNOWN") else F.array_contains("fabrics", category)
    return looks.where(ok if gender is None else ok & (F.col("gender") == gender))


def outfits(items: DataFrame, seed: str, n: int = 5) -> DataFrame:
    """owner, number, items (ids), style, occasion, confidence: n outfits for each owner of three items or more, a top and a bottom among them.

    An outfit is a top, a bottom, and shoes and an accessory where there are; each is the one with the smallest md5 of id, seed and the outfit's number. The
    style is the most frequent of its items, the first of equally frequent ones; of all picks the surest come first.
    """
    part = F.when(F.col("type").isin("SHIRT", "JACKET"), 0).when(F.col("type").isin("PANTS", "SKIRT"), 1).when(F.col("type") == "SHOES", 2).when(F.col("type").isin("BAG", "ACCESSORIES"), 3)
    numbered = items.withColumn("part", part).withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = F.md5(F.concat(F.col("id").cast("string"), F.lit(seed), F.col("number").cast("string")))
    picks = numbered.where(F.col("part").isNotNull()).groupBy("owner", "number", "part").agg(F.min(F.struct(order.alias("o"), "id", "style", "color")).alias("p"))
    sizes = items.groupBy("owner").agg(F.count("*").alias("_n")).where("_n >= 3")
    sets = picks.groupBy("owner", "number").agg(F.sort_array(F.collect_list(F.struct("part", "p"))).alias("l")).where(F.col("l")[0]["part"] == 0).where(F.get("l", F.lit(1))["part"] == 1).join(sizes, "owner", "left_semi")
    part_of = lambda name: F.transform("l", lambda x: x["p"][name]).alias(name)
    sets = sets.select("owner", "number", part_of("id"), part_of("style"), part_of("color"))
    votes = F.transform("style", lambda s: F.size(F.filter("style", lambda t: t == s)))
    style = F.element_at("style", F.array_position(votes, F.array_max(votes)).cast("int"))
    out = sets.withColumn("main", style)
    return out.select("owner", "number", F.col("id").alias("items"), F.col("main").alias("style"), occasion_of(F.col("main")).alias("occasion"), outfit_confidence(F.col("style"), F.col("color")).alias("confidence"))


def occasion_of(style: Column) -> Column:
    return _by(style, WORN_FOR, "Casual Outing")


def style_match(style: Column, color: Column, styles: Column, colors: Column) -> Column:
    """Whole part of the share of suggested items (styles and colours) that go with an item: 1 if all do, else 0; 0 for none."""
    fits = lambda a, c, table: F.size(F.filter(c, lambda b: compatible(a, b, table)))
    n = F.size(styles)
    return F.when(n == 0, 0.0).otherwise(F.floor((fits(style, styles, STYLE_PAIRS) + fits(color, colors, COLOR_PAIRS)) / (n * 2)).cast("double"))


def label_category(label: Column) -> Column:
    """The cloth that a classifier's label names: a category's own name, else the first of LABEL_WORDS that is found in it; null for no cloth."""
    low = F.lower(F.trim(label))
    out = F.when(F.upper(low).isin([c for c in S.CATEGORIES if c != "UNKNOWN"]), F.upper(low))
    for name, words in LABEL_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, name)
    return out


def top_hints(scores: Column, labels: list[str], n: int = 3) -> Column:
    """array<struct<score, label>>: the n largest scores of a row with their labels in lower case; of equal ones the first."""
    names = F.array(*map(F.lit, labels))
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -p["k"].cast("double"))).alias("score"), F.lower(F.get(names, p["i"])).alias("label")))


def category_boost(hints: Column) -> Column:
    """struct<category, score> of the first hint, if it is sure enough and names a cloth; else null."""
    best = F.get(hints, F.lit(0))
    return F.when((best["score"] >= 0.20) & label_category(best["label"]).isNotNull(), F.struct(label_category(best["label"]).alias("category"), best["score"].alias("score")))


def verdict_reason(top: Column, entropy: Column, margin: Column, first: Column, any_of: Column) -> Column:
    """Why a verdict isn't sure, the first rule that holds; CONFIDENT_TEXTILE otherwise. first, any_of: the cloth that the best label, and any of the best three, name."""
    return F.when(first.isNull() & any_of.isNull(), "NON_TEXTILE_DOMINANT").when(top < 0.22, "LOW_TOP1_CONFIDENCE").when(entropy > 0.88, "HIGH_ENTROPY").when(margin < 0.06, "SMALL_TOP1_TOP2_MARGIN").otherwise("CONFIDENT_TEXTILE")


def fused(verdicts: DataFrame) -> DataFrame:
    """verdicts with category and confidence, from a classifier of local cloths (ownCategory, ownScore), one of all things (gateCategory,
    gateConfidence, gateReason) and the picture's signature (signCategory, signConfidence, anisotropy). Any of them may be null."""
    c = F.col
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    no_cloth = F.coalesce(c("gateReason") == "NON_TEXTILE_DOMINANT", F.lit(False)) & F.coalesce(c("anisotropy") < 0.22, F.lit(True))
    sure = F.coalesce(c("gateReason") == "CONFIDENT_TEXTILE", F.lit(False))
    own = F.coalesce(c("ownCategory").isNotNull() & (c("ownScore") >= 0.38), F.lit(False))
    woven = F.coalesce((c("anisotropy") > 0.45) & c("signCategory").isin("KENTE", "FUGU", "GONJA"), F.lit(False))
    category = F.when(no_cloth, F.coalesce("signCategory", F.lit("UNKNOWN"))).when(sure & c("gateCategory").isNotNull(), c("gateCategory")).when(own & woven, c("signCategory")).when(own, c("ownCategory")).otherwise(c("signCategory"))
    sign = F.coalesce("signConfidence", F.lit(0.55))
    confidence = (
        F.when(no_cloth, F.least(F.coalesce("signConfidence", F.lit(0.35)), F.lit(0.42))).when(own, clamp(c("ownScore") * 0.5 + sign * 0.5, 0.35, 0.80)).when(sure, clamp(c("gateConfidence") * 0.55 + sign * 0.45, 0.35, 0.80))
        .otherwise(clamp(F.coalesce("signConfidence", F.lit(0.35)), 0.30, 0.72))
    )
    return verdicts.withColumns({"category": category, "confidence": confidence})


def final_verdict(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local (id, category, confidence, pattern, texture, mlCategory, mlConfidence) with what a service says of it (id, category, confidence, pattern, texture),
    else with its classifier's verdict, whose confidence is kept between 0.3 and 0.8."""
    r = remote.select(F.col("id").alias("_i"), *[F.col(c).alias(f"_{c}") for c in ("category", "confidence", "pattern", "texture")])
    both, has = local.join(r, F.col("id") == F.col("_i"), "left"), F.col("_i").isNotNull()
    kept = F.greatest(F.lit(0.3), F.least(F.lit(0.8), F.col("mlConfidence")))
    return both.select(
        "id", F.when(has, F.col("_category")).otherwise(F.coalesce("mlCategory", "category")).alias("category"), F.when(has, F.col("_confidence")).otherwise(kept).alias("confidence"),
        F.coalesce("_pattern", "pattern").alias("pattern"), F.coalesce("_texture", "texture").alias("texture"), F.when(has, "CLOUD").otherwise("LOCAL").alias("engine"),
    )


def palette_of(category: Column) -> Column:
    out = F.lit(None).cast("array<bigint>")
    for name, colors in PALETTES.items():
        out = F.when(category == name, F.array(*[F.lit(x).cast("long") for x in colors])).otherwise(out)
    return out


def pattern_of(category: Column) -> Column:
    return _by(category, PATTERN_OF.items(), "GEOMETRIC")


def controls_of(silhouette: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for names, controls in CONTROLS:
        out = F.when(silhouette.isin(list(names)), F.array(*map(F.lit, controls))).otherwise(out)
    return out


def swatch_profiles(paths: DataFrame, profiles: DataFrame, labels: list[str]) -> DataFrame:
    """path, stem, category, confidence of swatches by the stem of their file: a known profile (stem, category, confidence), else its own name if that is a
    label, else KENTE, with a confidence of 0.96."""
    stem = F.lower(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))
    p = profiles.select(F.col("stem").alias("_s"), F.col("category").alias("_c"), F.col("confidence").alias("_k"))
    both = paths.withColumn("stem", stem).join(p, F.col("stem") == F.col("_s"), "left")
    own = F.when(F.upper("stem").isin(labels), F.upper("stem")).otherwise("KENTE")
    return both.select("path", "stem", F.coalesce("_c", own).alias("category"), F.coalesce("_k", F.lit(0.96)).alias("confidence"))


def hashtags(pictures: DataFrame, n: int = 10) -> DataFrame:
    """id, hashtags: the common tags, then each item's type and its attributes of colour, pattern and style in order, then two colours; each once, the first n.

    pictures: id, items array<struct<type, attributes array<struct<type, value>>>>, colors array<string>.
    """
    tag = lambda c: F.concat(F.lit("#"), F.lower(c))
    kinds = lambda item: F.transform(F.filter(item["attributes"], lambda a: a["type"].isin("COLOR", "PATTERN", "STYLE")), lambda a: tag(a["value"]))
    own = F.flatten(F.transform("items", lambda i: F.concat(F.array(tag(i["type"])), kinds(i))))
    two = F.transform(F.slice("colors", 1, 2), lambda c: F.replace(tag(c), F.lit(" "), F.lit("")))
    return pictures.select("id", F.slice(F.array_distinct(F.concat(F.array(*map(F.lit, COMMON_TAGS)), own, two)), 1, n).alias("hashtags"))


def picture_summary(items: DataFrame) -> DataFrame:
    """id, confidence, style: the mean confidence of a picture's items (id, ordinal, confidence, styles) and their most frequent style, the first of equal ones."""
    mean = items.groupBy("id").agg(F.avg("confidence").alias("confidence"))
    each = items.select("id", "ordinal", F.posexplode("styles").alias("at", "style")).groupBy("id", "style").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "at")).alias("first"))
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first"))).where("_r = 1").select("id", "style")
    return mean.join(best, "id", "left")


def season_tips(month: Column) -> Column:
    from weft.functions.text import season

    out = F.lit(None).cast("array<string>")
    for name, tips in TIPS.items():
        out = F.when(season(month) == name, F.array(*map(F.lit, tips))).otherwise(out)
    return out


# the discover and collection screens


def by_chip(styles: DataFrame, chip: str) -> DataFrame:
    """Styles of a category chip: OCCASION shows the traditional ones, ALL and FABRICS all."""
    name = {"OCCASION": "TRADITIONAL", "CASUAL": "CASUAL", "FORMAL": "FORMAL"}.get(chip)
    return styles if name is None else styles.where(F.col("category") == name)


def featured_first(styles: DataFrame, featured: tuple[str, ...] = FEATURED) -> DataFrame:
    """The featured styles in their order, then the others in theirs."""
    place = F.array_position(F.array(*map(F.lit, featured)), F.col("id"))
    return styles.orderBy(F.when(place > 0, place).otherwise(len(featured) + 1), "ordinal")


def with_name_like(rows: DataFrame, column: str, part: str) -> DataFrame:
    return rows.where(F.contains(F.lower(column), F.lit(part.lower())))


def preview_list(styles: DataFrame, query: str, sort: str = "score") -> DataFrame:
    """Ranked styles whose title, silhouette or category contains the query, by title or by score."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("title"), q) | F.contains(F.lower("silhouette"), q) | F.contains(F.lower("category"), q)
    return styles.where(hit).orderBy(*([F.col("title")] if sort == "title" else [F.desc("score"), F.col("title")]))


def members(sets: DataFrame, ids: str, items: DataFrame, set_key: str = "id") -> DataFrame:
    """set, and the columns of the items whose id is in its array of ids."""
    one = sets.select(F.col(set_key).alias("set"), F.explode(F.array_distinct(ids)).alias("_m"))
    return one.join(items, F.col("_m") == F.col("id")).drop("_m")
