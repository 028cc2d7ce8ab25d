"""Which styles suit a fabric, and which pieces go together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft import schema as S
from weft.functions.color import skin_harmony

# What goes with a style, a colour, a type of clothing.
STYLE_PAIRS = {
    "Casual": "Casual Sporty Streetwear", "Formal": "Formal Business Classic", "Bohemian": "Bohemian Vintage Romantic",
    "Minimalist": "Minimalist Modern Classic", "Streetwear": "Streetwear Casual Sporty", "Vintage": "Vintage Bohemian Classic",
}
COLOR_PAIRS = {"Black": "White Gray Red Blue Pink", "White": "Black Blue Navy Gray Pastel", "Navy": "White Beige Gray Red", "Gray": "Black White Blue Pink", "Beige": "Navy Brown White Green"}
TYPE_PAIRS = {"SHIRT": "PANTS SKIRT SHOES", "PANTS": "SHIRT SHOES JACKET", "DRESS": "SHOES BAG ACCESSORIES", "SHOES": "PANTS SKIRT DRESS"}


def _of(c: Column, names: list[str]) -> Column:
    return c.isin(names)


def _lookup(c: Column, table: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def _fit(f: Callable[[str], Column], s: Callable[[str], Column], harmony: Column | None, loved: list[str], measurements: tuple | None, anisotropy: float | None, favorites: list[str], gender: str | None) -> Column:
    """The score, 5 to 98, of a fabric with a style, whose fields f and s give; stiff is the fabric's texture as a number."""
    silhouette = s("silhouette")
    common = F.size(F.array_intersect(f("suggestedUses"), s("occasions")))
    score = (
        F.lit(30.0) + F.when(F.array_contains(s("affinity"), f("category")), 18.0).otherwise(0.0) + 10.0 * (1.0 - F.abs(f("stiff") - s("structure"))) + F.when(_of(f("pattern"), S.STRUCTURED), 6.0).otherwise(4.0)
        + F.when((f("motifScale") > 0.55) & _of(silhouette, S.LARGE_PANEL), 8.0).when((f("motifScale") < 0.35) & _of(silhouette, S.FITTED), 8.0).otherwise(0.0)
        + 12.0 * common / F.greatest(F.size(s("occasions")), F.lit(1)) + F.when((f("saturation") > 0.5) | (f("saturation") < 0.3), 6.0).otherwise(0.0)
        + F.when(_of(f("category"), S.TRADITIONAL_CLOTHS) & (s("category") == "TRADITIONAL"), 8.0).otherwise(0.0)
    )
    if harmony is not None:
        score += (harmony - 0.5) * 10.0
    if anisotropy is not None and anisotropy >= 0.35:
        score += F.when(_of(silhouette, S.PANEL_ALIGNED), 5.0 * min(anisotropy, 1.0)).otherwise(0.0)
    if measurements:
        score += measurement_bonus(silhouette, *measurements)
    if favorites:
        score += F.when(s("id").isin(list(favorites)), 5.0).when(s("category").isin(loved), 2.5).otherwise(0.0)
    if gender:
        score += F.when(suits_gender(s("gender"), gender), 3.0).otherwise(0.0)
    return F.greatest(F.lit(5), F.least(F.lit(98), F.round(score, 4).cast("int")))


def dealt(fabrics: DataFrame) -> DataFrame:
    """Fabrics in a few parts for each core: their table is short, so one or two tasks would read it and make all pairs."""
    return fabrics.repartition(4 * fabrics.sparkSession.sparkContext.defaultParallelism, "id")


def _fabrics(fabrics: DataFrame, skin: int | None) -> DataFrame:
    """Fabrics with what follows from each alone: stiff, and harmony with a skin tone if there is one."""
    out = dealt(fabrics).withColumn("stiff", _lookup(F.col("texture"), S.STRUCTURE, None).cast("double"))
    return out if skin is None else out.withColumn("harmony", skin_harmony(F.col("colors.argb"), F.lit(skin)))


def _shown(styles: DataFrame, dismissed: DataFrame | None) -> DataFrame:
    return styles if dismissed is None else styles.join(dismissed, styles.id == dismissed.styleId, "left_anti")


def _loved(styles: DataFrame, favorites: list[str]) -> list[str]:
    """The categories of the favourites."""
    return [r[0] for r in styles.where(F.col("id").isin(list(favorites))).select("category").distinct().collect()] if favorites else []


def measurement_bonus(silhouette: Column, height: int | None, waist: int | None, hip: int | None) -> Column:
    out = F.lit(0.0)
    if waist is not None and hip:
        ratio = waist / hip
        if ratio < 0.78:
            out += F.when(_of(silhouette, S.WAIST_DEFINED), 4.5).otherwise(0.0)
        elif ratio >= 0.85:
            out += F.when(_of(silhouette, S.LARGE_PANEL), 3.5).otherwise(0.0)
    if height is not None:
        if height >= 175:
            out += F.when(_of(silhouette, S.TALL), 3.5).otherwise(0.0)
        elif 140 <= height <= 162:
            out += F.when(_of(silhouette, S.ELONGATING), 3.5).otherwise(0.0)
    return out


def rank_styles(fabrics: DataFrame, styles: DataFrame, dismissed: DataFrame | None = None, skin: int | None = None, measurements: tuple | None = None, anisotropy: float | None = None, favorites: list[str] = (), gender: str | None = None) -> DataFrame:
    """fabricId, styleId, ordinal, score (5 to 98) of each fabric with each style that isn't dismissed.

    The catalogue of styles has a few dozen rows, so each fabric is scored against all of them in place, without a shuffle. The sum is rounded to four places
    before it is cut to a whole number, so engines agree on scores that are whole.
    """
    f, s = _fabrics(fabrics, skin).alias("f"), F.broadcast(_shown(styles, dismissed).alias("s"))
    c = F.col
    score = _fit(lambda k: c(f"f.{k}"), lambda k: c(f"s.{k}"), None if skin is None else c("f.harmony"), _loved(styles, favorites), measurements, anisotropy, favorites, gender)
    return f.join(s).select(c("f.id").alias("fabricId"), c("s.id").alias("styleId"), c("s.ordinal").alias("ordinal"), score.alias("score"))


def suits_gender(c: Column, gender: str | None) -> Column:
    return F.lit(True) if gender is None else (c == gender) | (c == "UNISEX")


def best_styles(ranked: DataFrame, n: int = 3) -> DataFrame:
    """The n best styles of each fabric with their place; ties in the order of styles."""
    place = F.row_number().over(Window.partitionBy("fabricId").orderBy(F.desc("score"), "ordinal"))
    return ranked.withColumn("place", place).where(F.col("place") <= n)


def top_styles(fabrics: DataFrame, styles: DataFrame, n: int = 3, dismissed: DataFrame | None = None, skin: int | None = None, measurements: tuple | None = None, anisotropy: float | None = None, favorites: list[str] = (), gender: str | None = None) -> DataFrame:
    """best_styles() of rank_styles(), for a row a fabric: each is scored against the whole catalogue, which is one broadcast row of a few dozen styles, and its best are
    kept where it is, so that no pair is shuffled or sorted."""
    fields = ["id", "ordinal", "category", "silhouette", "structure", "occasions", "affinity", "gender"]
    whole = _shown(styles, dismissed).agg(F.collect_list(F.struct(*fields)).alias("_styles"))
    loved = _loved(styles, favorites)
    kept = ["id", "category", "pattern", "stiff", "motifScale", "saturation", "suggestedUses", *(["harmony"] if skin is not None else [])]
    rows = _fabrics(fabrics, skin).select(F.struct(*kept).alias("f")).crossJoin(F.broadcast(whole))
    score = lambda s: _fit(lambda k: F.col(f"f.{k}"), lambda k: s[k], None if skin is None else F.col("f.harmony"), loved, measurements, anisotropy, favorites, gender)
    place = F.array_sort(F.transform("_styles", lambda s: F.struct((-score(s)).alias("less"), s["ordinal"].alias("ordinal"), s["id"].alias("styleId"))))
    best = rows.select(F.col("f.id").alias("fabricId"), F.posexplode(F.slice(place, 1, n)).alias("at", "s"))
    return best.select("fabricId", "s.styleId", "s.ordinal", (-F.col("s.less")).alias("score"), (F.col("at") + 1).alias("place"))


def features(fabrics: DataFrame, styles: DataFrame) -> DataFrame:
    """fabricId, styleId and target: the closed form over a pair's features, 0.05 to 0.98, without a wearer."""
    c = F.col
    stiff = _lookup(c("f.texture"), S.STRUCTURE, None).cast("double")
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    fit = F.when(((c("f.motifScale") > 0.55) & _of(c("s.silhouette"), S.LARGE_PANEL)) | ((c("f.motifScale") < 0.35) & _of(c("s.silhouette"), S.FITTED)), 1.0).otherwise(0.35)
    raw = (
        0.30 + 0.18 * flag(F.array_contains("s.affinity", c("f.category"))) + 0.10 * (1.0 - F.abs(stiff - c("s.structure"))) + 0.08 * fit
        + 0.12 * (F.size(F.array_intersect("f.suggestedUses", "s.occasions")) / F.greatest(F.size("s.occasions"), F.lit(1))) + 0.06 * F.abs(c("f.saturation") - 0.4)
        + 0.08 * flag(_of(c("f.category"), S.TRADITIONAL_CLOTHS) & (c("s.category") == "TRADITIONAL"))
    )
    return dealt(fabrics).alias("f").join(F.broadcast(styles.alias("s"))).select(c("f.id").alias("fabricId"), c("s.id").alias("styleId"), F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.98), raw)), 4).alias("target"))


def compatible(a: Column, b: Column, table: dict[str, str]) -> Column:
    """Whether b goes with a: a key that isn't in the table goes with everything."""
    out = F.lit(True)
    for key, names in table.items():
        out = F.when(a == key, b.isin([key, *names.split()])).otherwise(out)
    return out


def complements(a: Column, b: Column) -> Column:
    """Whether clothing of type b completes one of type a: the listed types, or any other type."""
    out = a != b
    for key, names in TYPE_PAIRS.items():
        out = F.when(a == key, b.isin(names.split())).otherwise(out)
    return out


def complete_the_look(items: DataFrame, n: int = 3) -> DataFrame:
    """id, suggested, place: for each item the first n others of the same owner that complete it and go with its style and colour."""
    a, b = items.alias("a"), items.alias("b")
    ok = (F.col("a.owner") == F.col("b.owner")) & (F.col("a.id") != F.col("b.id")) & complements(F.col("a.type"), F.col("b.type"))
    ok = ok & compatible(F.col("a.style"), F.col("b.style"), STYLE_PAIRS) & compatible(F.col("a.color"), F.col("b.color"), COLOR_PAIRS)
    place = F.row_number().over(Window.partitionBy("a.id").orderBy("b.id"))
    return a.join(b, ok).select(F.col("a.id").alias("id"), F.col("b.id").alias("suggested"), place.alias("place")).where(F.col("place") <= n)


def outfit_confidence(styles: Column, colors: Column) -> Column:
    """Half the share of neighbours whose styles go together, half that of colours; 1 for a single piece."""

    def share(c: Column, table: dict[str, str]) -> Column:
        pairs = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: compatible(a, b, table).cast("int"))
        return F.when(F.size(c) < 2, 1.0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(c) - 1, F.lit(1)))

    return 0.5 * share(colors, COLOR_PAIRS) + 0.5 * share(styles, STYLE_PAIRS)


def surprise_outfit(items: DataFrame, seed: str) -> DataFrame:
    """owner, type, id: for each owner a dress, else a shirt with pants, else nothing; and shoes, a bag and accessories
    where there are. Of several the one with the smallest md5 of id and seed."""
    order = F.struct(F.md5(F.concat(F.col("id").cast("string"), F.lit(seed))).alias("o"), "id")
    one = items.groupBy("owner", "type").agg(F.min(order).alias("pick")).select("owner", "type", F.col("pick.id").alias("id"))
    owned = one.groupBy("owner").agg(F.bool_or(F.col("type") == "DRESS").alias("dress"), (F.count_if(F.col("type").isin("SHIRT", "PANTS")) == 2).alias("pair"))
    extra = F.col("type").isin("SHOES", "BAG", "ACCESSORIES") & (F.col("dress") | F.col("pair"))
    main = F.when(F.col("dress"), F.col("type") == "DRESS").otherwise(F.col("pair") & F.col("type").isin("SHIRT", "PANTS"))
    return one.join(owned, "owner").where(main | extra).select("owner", "type", "id")
